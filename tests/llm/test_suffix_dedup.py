"""Repeated strings of bytes against brute force, in the suffix array and beyond its cap."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import suffix_dedup as S
from weftgraph.llm.suffix_dedup import intervals, maximal_repeats, remove_repeated_bytes


def brute(rows, n):
    count = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        count.update(t[p : p + n] for p in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                cover[p : p + n] = b"\1" * n
        spans = []
        at = 0
        for hit, g in itertools.groupby(cover):
            size = len(list(g))
            if hit:
                spans.append((at, size))
            at += size
        out.append((i, len(t), sum(cover), bytes(b for b, c in zip(t, cover) if not c), tuple(spans)))
    return out


def corpus(seed=2):
    """Copies, near copies, passages with different ends, a line in many documents, runs of one byte, odd rows."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ß€\n") for _ in range(n))
    passage, line = text(90), text(26)
    out = [text(rng.randrange(300)) for _ in range(40)]
    out += [rng.choice(out) for _ in range(15)]
    for _ in range(60):
        t = rng.choice(out)
        a = rng.randrange(len(t) + 1)
        out.append(t[:a] + rng.choice(["", "x", text(30)]) + t[a + rng.randrange(3) :])
    out += [text(rng.randrange(40)) + passage[rng.randrange(20) : 90 - rng.randrange(20)] + text(rng.randrange(40)) for _ in range(80)]
    out += [text(20) + line + text(20) for _ in range(80)]
    out += ["a" * 150, "ab" * 60, "a" * 37, "", "\n", "y" + "a" * 41 + "z", text(9_000), None, None, "abcdefgh" * 30, "a", "\0" * 90, "\0" * 30 + "b"]
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + rows[5:8] + [(None, passage), (None, text(50))]


SCHEMA = "doc_id long, text string, kind int, shard int, unit int, n_bytes int, spans string"


@pytest.mark.parametrize("n, k, unit_bytes, most, slice_bytes, fan", [(40, 16, None, 4096, 1 << 20, 1024), (40, 12, 4_000, 4096, 700, 1024), (40, 16, 3_000, 3, 1 << 20, 1024), (33, 8, 3_000, 2, 500, 8)])
def test_against_brute_force(spark, n, k, unit_bytes, most, slice_bytes, fan):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, "x") for i, t in rows], SCHEMA)
    got = remove_repeated_bytes(docs, n=n, k=k, unit_bytes=unit_bytes, fan=fan, most=most, slice_bytes=slice_bytes).collect()
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, bytes(r.kept), tuple((s["first"], s["bytes"]) for s in r.spans)) for r in got)
    assert found == sorted(((i is None, i or 0), *rest) for i, *rest in brute(rows, n))
    assert sum(r.n_removed for r in got) > 5_000


def test_without_rows(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = remove_repeated_bytes(spark.createDataFrame([(1, "x" * 199, 1, 2, 3, 4, "x"), (2, None, 1, 2, 3, 4, "x")], SCHEMA)).collect()
    assert {(r.doc_id, r.n_removed) for r in one} == {(1, 0), (2, 0)}


def test_intervals_and_maximal_repeats():
    assert list(intervals([0, 1, 3, 0, 0, 2], 1)) == [(3, 1, 2), (1, 0, 2), (2, 4, 5)]
    rng = random.Random(7)
    for _ in range(60):
        k, n = 3, 7
        run = "".join(rng.choice("ab") for _ in range(k))
        words = [("".join(rng.choice("ab") for _ in range(rng.randrange(9))), run + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(2, 14))]
        lefts, rights = [a[::-1].encode() for a, _ in words], [b.encode() for _, b in words]
        got = {(back, length, tuple(sorted(m))) for back, length, m in maximal_repeats(lefts, rights, n, k)}
        share = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        want = set()
        for i, j in itertools.combinations(range(len(words)), 2):
            back, length = share(lefts[i], lefts[j]), share(rights[i], rights[j])
            if back + length >= n:
                own = tuple(m for m in range(len(words)) if lefts[m][:back] == lefts[i][:back] and len(lefts[m]) >= back and rights[m][:length] == rights[i][:length])
                want.add((back, length, own))
        assert got == want


def test_least_of_neighbours():
    rng = np.random.default_rng(1)
    for size, width in ((5, 5), (17, 4), (100, 7), (8, 1)):
        v = rng.integers(0, 50, size).astype(np.uint64)
        assert (S._least(v, width) == np.lib.stride_tricks.sliding_window_view(v, width).min(axis=1)).all()


@pytest.mark.parametrize("unit_bytes", [None, 4_000])
def test_groups_list_all_occurrences(spark, unit_bytes):
    rows = [(i, t) for i, t in corpus(4) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    n = 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for r in S.repeat_groups(docs, n=n, k=16, unit_bytes=unit_bytes).collect():
        got.setdefault((r.group, r.n_bytes), set()).add((r.doc_id, r.first))
    texts = {i: (t or "").encode() for i, t in rows}
    assert len(got) > 50
    for (name, size), places in got.items():
        doc, first = min(places)
        text = texts[doc][first : first + size]
        assert size >= n and len(text) == size and hashlib.sha256(text).hexdigest() == name
        assert places == {(i, p) for i, t in texts.items() for p in range(len(t) - size + 1) if t.startswith(text, p)} and len(places) > 1
    # what the groups cover is what is removed
    cover = {i: bytearray(len(t)) for i, t in texts.items()}
    for (_, size), places in got.items():
        for i, p in places:
            cover[i][p : p + size] = b"\1" * size
    assert {i: sum(c) for i, c in cover.items()} == {i: removed for i, _, removed, _, _ in brute(rows, n)}
