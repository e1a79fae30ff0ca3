"""The exact step of the Jaccard join over many fragments of the n-gram order."""

import itertools
import random

import numpy as np
import pytest

from weftgraph.llm import ngram_join as J


def brute(sets, percent):
    reach = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    return {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if reach(sets[i], sets[j])}


@pytest.mark.parametrize("fragments", [1, 7, 64])
def test_all_links(spark, fragments):
    """Each component has a second text that holds segments in some fragments only, so that the order
    of the components by size differs from one fragment to the next."""
    rng = random.Random(5)
    draw = lambda n: {rng.randrange(2**64) for _ in range(n)}
    sets, comp = {}, {}
    for group in range(8):
        base = draw(40)
        for k in range(6):
            i = len(sets)
            sets[i], comp[i] = (base - set(rng.sample(sorted(base), 4))) | draw(4), i
            sets[i + 1], comp[i + 1] = draw(40), i
    rows = []
    for i, s in sets.items():
        own = np.array(sorted(s), np.uint64)
        frag = ((own >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        rows += [(int(f), i, 1000 - i, len(own), len(own), bytearray(own[frag == f].tobytes()), comp[i]) for f in np.unique(frag)]
    segments = spark.createDataFrame(rows, J.SEGMENT + ", comp long")
    found = {(min(r.src, r.dst), max(r.src, r.dst)) for r in J._all_links(segments, 60).collect()}
    want = {p for p in brute(sets, 60) if comp[p[0]] != comp[p[1]]}
    assert found == want and len(want) > 50


def test_near_duplicates_in_fragments(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = {}
    for group in range(20):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
            texts[len(texts)] = w
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in texts.items()}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in brute(sets, 75):
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    for fragments in (1, 50):
        got = {r.doc_id: r.component_id for r in J.near_duplicates(docs, fragments=fragments).collect()}
        assert got == least
