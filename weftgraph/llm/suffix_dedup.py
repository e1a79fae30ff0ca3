"""Suffix-array dedup: bytes of every string of n bytes that also starts elsewhere.

Suffixes start at *anchors* only: in each window of ``n`` bytes the run of ``k`` bytes with the least hash. Two
windows alike have their anchor at the same place, so repeats show among suffixes of anchors alike.
An anchor stands for the windows that chose it; its *context* is all bytes of those. The suffixes of a
range of anchors meet in one task as an enhanced suffix array: sorted, with the common prefixes of
neighbours, whose interval tree a stack scan walks. The members of an interval are sorted again by what lies left of
them, and each common-prefix interval there whose members extend to the right in different ways is a maximal repeat:
with all its members, not just neighbours.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from . import kernels as K
from .memory import tidy
from .units import deal, load, prepared, raw_text, text_bytes, unit_count

#: Bytes looked at at once; low bits of a window's least hash that hold its place there.
SLICE_BYTES, PLACE_BITS = 256 << 10, 22
#: Different contexts of one anchor that a task takes; beyond, their windows are counted by digest over all tasks.
MOST_CONTEXTS = 4096
RESOLVED, SHIP, HOT = 1, 2, 4


def _slices(offsets: np.ndarray, n: int, most: int):
    """Texts laid end to end in slices ``(first byte, offsets)``; a longer text is cut so that each window lies in one slice."""
    for a, b in K.chunks(np.diff(offsets), most):
        first, last = int(offsets[a]), int(offsets[b])
        if last - first > most:
            for at in range(first, last - n + 1, most):
                yield at, np.array([0, min(most + n - 1, last - at)], np.int64)
        else:
            yield first, offsets[a : b + 1] - first


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    rows = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


class Anchors:
    """The anchors of a unit: ``at``, first and last window start, and hashes of the anchor's run and of its context."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int, k: int, slice_bytes: int = SLICE_BYTES):
        found: list[tuple] = []
        for base, local in _slices(offsets, n, slice_bytes):
            counts = np.maximum(np.diff(local) - (n - 1), 0)
            total = int(counts.sum())
            if not total:
                continue
            part = data[base : base + local[-1]]
            spans = K.Spans(part, 1)
            hashes = spans.runs(k)
            places = np.arange(len(hashes), dtype=K.U64)
            low = K.U64((1 << PLACE_BITS) - 1)
            least = _least((hashes & ~low) | places, n - k + 1)
            starts = np.arange(total) + np.repeat(local[:-1] - (np.cumsum(counts) - counts), counts)
            chosen = (least[starts] & low).astype(np.int64)
            turn = np.ones(total, bool)
            turn[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
            first = np.flatnonzero(turn)
            p0, p1, at = starts[first], starts[np.append(first[1:], total) - 1], chosen[first]
            context = K.Spans(part, 2).of(p0, p1 + n)
            with np.errstate(over="ignore"):
                context = K.mix64(context + (at - p0).astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
            run = K.mix64(hashes[at] ^ K.seeded(97, 1)[0])  # hashes of anchors are small, as least ones; as keys they are to be spread
            found.append((at + base, p0 + base, p1 + base, run, context))
        kinds = (np.int64, np.int64, np.int64, K.U64, K.U64)
        self.at, self.p0, self.p1, self.run, self.context = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in kinds)
        # the distinct (run, context), ascending, and which of them each anchor is
        order = np.lexsort((self.context, self.run))
        run, context = self.run[order], self.context[order]
        new = np.ones(len(order), bool)
        new[1:] = (run[1:] != run[:-1]) | (context[1:] != context[:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.shown = order[new]
        self.many = np.diff(np.append(np.flatnonzero(new), len(order))) > 1

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.run[self.shown], self.context[self.shown], self.many


def verdicts(keys: np.ndarray, extra: list[np.ndarray], most: int = MOST_CONTEXTS, every: bool = False) -> np.ndarray:
    """For each entry: its context occurs twice (all its windows repeat); it is to be compared with other contexts of its
    run, as the first of those alike, in the suffix array or, if they are too many for a task, by windows. ``every``: also where
    all contexts occur twice."""
    context, many, unit = extra
    order = np.lexsort((unit, context, keys))
    run, context, many = keys[order], context[order], many[order]
    group = np.ones(len(order), bool)
    group[1:] = run[1:] != run[:-1]
    kind = group.copy()
    kind[1:] |= context[1:] != context[:-1]
    kind_no, at = np.cumsum(kind) - 1, np.flatnonzero(kind)
    twice = (np.diff(np.append(at, len(order))) > 1) | np.logical_or.reduceat(many, at) if len(at) else np.zeros(0, bool)
    group_of_kind = np.cumsum(group[at]) - 1
    kinds = np.bincount(group_of_kind)
    open_ones = np.bincount(group_of_kind, weights=~twice)
    compare = (kinds > 1) & ((open_ones > 0) | every)
    mark = np.where(compare, np.where(kinds > most, HOT, SHIP), 0)[group_of_kind][kind_no]
    out = np.empty(len(order), np.uint8)
    out[order] = np.where(twice[kind_no], RESOLVED, 0) | np.where(kind, mark, 0)
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - (-(-(int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() // 8))


def intervals(lcp: list[int], least: int):
    """The common-prefix intervals ``(length, first, last)`` of an enhanced suffix array, children before parents; ``lcp[i]``
    is what entries i - 1 and i share. Lengths below ``least`` are left out."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = lcp[i] if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], n: int, k: int):
    """Of suffixes ``rights`` with the bytes before them, backwards, in ``lefts``: each maximal repeat of ``n`` bytes or more
    that covers the first ``k`` bytes, as ``(bytes before, bytes from the start on, members)``."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for length, first, last in intervals(lcp, k):
        child, kinds = {order[first]: 0}, 0
        for i in range(first + 1, last + 1):
            kinds += lcp[i] == length
            child[order[i]] = kinds
        members = sorted(child, key=lefts.__getitem__)
        before = [0] + [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        if max(before) + length < n:
            continue
        for back, a, b in intervals(before, max(0, n - length)):
            own = members[a : b + 1]
            if any(child[m] != child[own[0]] for m in own):  # else all extend alike to the right, and a longer repeat lists them
                yield back, length, own


def _context_rows(unit: int, anchors: Anchors, data: np.ndarray, answer: np.ndarray, n: int, shards: int) -> list[tuple]:
    ship = np.flatnonzero(answer & SHIP)
    rows = []
    run = anchors.run[anchors.shown[ship]]
    shard = [int(x) * shards >> 64 for x in run.tolist()]
    cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(ship)] if len(ship) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        own = anchors.shown[ship[a:b]]
        texts = [data[x:y].tobytes() for x, y in zip(anchors.p0[own].tolist(), (anchors.p1[own] + n).tolist())]
        table = pa.table({
            "entry": pa.array(ship[a:b].astype(np.int32)), "solved": pa.array((answer[ship[a:b]] & RESOLVED) > 0), "back": pa.array((anchors.at[own] - anchors.p0[own]).astype(np.int32)),
            "run": pa.array(anchors.run[own]), "context": pa.array(anchors.context[own]), "text": pa.array(texts, pa.binary()),
        })
        rows.append((shard[a], unit, b - a, _packed(table)))
    return rows


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(piece: pa.Table) -> pa.Table:
    piece = piece.sort_by("unit")
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in piece.column("blob").combine_chunks()]
    units = np.repeat(piece.column("unit").to_numpy(), piece.column("n").to_numpy())
    return pa.concat_tables(parts).append_column("unit", pa.array(units, pa.int32()))


def _split(contexts: pa.Table) -> tuple[list[bytes], list[bytes]]:
    texts, back = contexts.column("text").to_pylist(), contexts.column("back").to_pylist()
    return [t[:b][::-1] for t, b in zip(texts, back)], [t[b:] for t, b in zip(texts, back)]


SHIPPED = "shard int, unit int, n int, blob binary"
TOLD = "unit int, kind int, shard int, answer binary"
#: ``kind`` of an answer: about an entry, stretches of windows from the suffix array, about a hot window's digest.
ENTRY, STRETCH, WINDOW = 0, 1, 2


@dataclass(frozen=True)
class Shape:
    """What all passes over a unit know."""

    n: int
    k: int
    slice_bytes: int
    ranges: exchange.Ranges
    shards: int

    def look(self, unit: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Anchors]:
        table = load(unit)
        data, offsets = raw_text(table.column("text"))
        return table, data, offsets, Anchors(data, offsets, self.n, self.k, self.slice_bytes)

    def answers(self, anchors: Anchors, told: pa.Table) -> np.ndarray:
        own = told.filter(pc.equal(told.column("kind"), ENTRY))
        return exchange.told_values(own, anchors.run[anchors.shown], self.ranges, 0, np.uint8)

    def hot_windows(self, anchors: Anchors, data: np.ndarray, answer: np.ndarray):
        """Windows of contexts of runs with too many: their places, distinct digests (64 + 32 bits), and each one's number."""
        chosen = np.flatnonzero((answer[anchors.entry] & HOT) > 0)
        # one anchor shows for all of a resolved entry, whose windows need no answer
        chosen = chosen[(anchors.shown[anchors.entry[chosen]] == chosen) | ((answer[anchors.entry[chosen]] & RESOLVED) == 0)]
        starts, first, second = [np.zeros(0, np.int64)], [np.zeros(0, K.U64)], [np.zeros(0, K.U64)]
        for i in chosen.tolist():
            a, b = int(anchors.p0[i]), int(anchors.p1[i])
            part = data[a : b + self.n]
            starts.append(np.arange(a, b + 1))
            first.append(K.Spans(part, 1).runs(self.n))
            second.append(K.Spans(part, 2).runs(self.n))
        places, hi, lo = np.concatenate(starts), np.concatenate(first), (np.concatenate(second) >> K.U64(32)).astype(np.uint32)
        order = np.lexsort((lo, hi))
        new = np.ones(len(order), bool)
        new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        at = order[new]
        return places, number, hi[at], lo[at], np.diff(np.append(np.flatnonzero(new), len(order))) > 1


class Plan:
    """The passes over dealt texts that come before bytes are removed."""

    def __init__(self, docs: DataFrame, n: int, k: int, id_col: str, text_col: str, unit_bytes: int | None, fan: int, most: int, slice_bytes: int, every: bool = False):
        if not 8 <= k < n:
            raise ValueError("k must lie between 8 and n - 1")
        units = unit_count(text_bytes(docs, text_col), unit_bytes)
        self.shape = Shape(n, k, slice_bytes, exchange.Ranges(units, 64, fan), max(exchange.LEAST, units // 2))
        self.dealt = deal(prepared(docs, id_col, text_col), units)
        answers = exchange.ask(self._entries(), self.shape.ranges, lambda keys, extra: verdicts(keys, extra, most, every))
        self.told = answers.select("unit", F.lit(ENTRY).alias("kind"), "shard", "answer")

    def _entries(self) -> DataFrame:
        shape = self.shape

        @tidy
        def entries(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
            run, context, many = shape.look(unit)[3].entries()
            return exchange.sent(exchange.send(key[0].as_py(), run, [context, many, np.full(len(run), key[0].as_py(), np.int64)], shape.ranges))

        return self.dealt.groupBy("unit").applyInArrow(entries, exchange.SENT)

    def contexts(self) -> DataFrame:
        """Contexts to compare, packed by range of anchors."""
        shape = self.shape

        @tidy
        def ship(key: tuple[pa.Scalar, ...], unit: pa.Table, told: pa.Table) -> pa.Table:
            _, data, _, anchors = shape.look(unit)
            rows = _context_rows(key[0].as_py(), anchors, data, shape.answers(anchors, told), shape.n, shape.shards)
            kinds = [("shard", pa.int32()), ("unit", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())]
            return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

        return self.dealt.groupBy("unit").cogroup(self.told.groupBy("unit")).applyInArrow(ship, SHIPPED)

    def stretches(self) -> DataFrame:
        """To each unit which windows of its unresolved contexts the suffix array found repeated."""
        n, k = self.shape.n, self.shape.k

        @tidy
        def scan(piece: pa.Table) -> pa.Table:
            contexts = _unpacked(piece)
            found: dict[int, list] = {}
            unit, entry, solved = (contexts.column(c).to_pylist() for c in ("unit", "entry", "solved"))
            for back, length, members in maximal_repeats(*_split(contexts), n, k):
                for m in members:
                    if not solved[m]:
                        found.setdefault(unit[m], []).append((entry[m], n - length, back))
            shard = piece.column("shard")[0].as_py()
            rows = [(u, STRETCH, shard, np.array(x, np.int32).tobytes()) for u, x in sorted(found.items())]
            return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["unit", "kind", "shard", "answer"])

        return self.contexts().groupBy("shard").applyInArrow(scan, TOLD)

    def groups(self) -> DataFrame:
        """Each maximal repeat that the suffix array finds, and the contexts that hold it: ``group`` (SHA-256 of its bytes), its length, the
        context's two hashes, and how many bytes before the anchor it begins."""
        n, k = self.shape.n, self.shape.k

        @tidy
        def scan(piece: pa.Table) -> pa.Table:
            contexts = _unpacked(piece)
            lefts, rights = _split(contexts)
            run, context = (contexts.column(c).to_numpy().view(np.int64).tolist() for c in ("run", "context"))
            rows: tuple[list, ...] = ([], [], [], [], [])
            for back, length, members in maximal_repeats(lefts, rights, n, k):
                text = lefts[members[0]][:back][::-1] + rights[members[0]][:length]
                name = hashlib.sha256(text).hexdigest()
                for m in members:
                    for store, value in zip(rows, (name, back + length, run[m], context[m], back)):
                        store.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.table([pa.array(x, t) for x, t in zip(rows, kinds)], ["group", "n_bytes", "run", "context", "back"])

        return self.contexts().groupBy("shard").applyInArrow(scan, "group string, n_bytes long, run long, context long, back long")

    def occurrences(self) -> DataFrame:
        """The anchors of runs that occur more than once: ``doc_id``, the context's two hashes, where the anchor lies (``at``), and of a
        context that occurs twice its own ``group``, length and first byte."""
        shape = self.shape

        @tidy
        def list_all(key: tuple[pa.Scalar, ...], unit: pa.Table, told: pa.Table) -> pa.Table:
            table, data, offsets, anchors = shape.look(unit)
            answer = shape.answers(anchors, told)
            chosen = np.flatnonzero((answer[anchors.entry] & (SHIP | RESOLVED)) > 0)
            own = np.searchsorted(offsets, anchors.at[chosen], side="right") - 1
            solved = (answer[anchors.entry[chosen]] & RESOLVED) > 0
            names = [hashlib.sha256(data[a : b + shape.n]).hexdigest() if s else None for a, b, s in zip(anchors.p0[chosen].tolist(), anchors.p1[chosen].tolist(), solved.tolist())]
            doc, null = table.column("doc_id").to_numpy()[own], table.column("null_id").to_numpy(zero_copy_only=False)[own]
            start = offsets[own]
            return pa.table({
                "doc_id": pa.array(doc, mask=null), "run": pa.array(anchors.run[chosen].view(np.int64)), "context": pa.array(anchors.context[chosen].view(np.int64)), "at": pa.array(anchors.at[chosen] - start),
                "group": pa.array(names, pa.string()), "n_bytes": pa.array(anchors.p1[chosen] - anchors.p0[chosen] + shape.n), "first": pa.array(anchors.p0[chosen] - start),
            })

        schema = "doc_id long, run long, context long, at long, group string, n_bytes long, first long"
        return self.dealt.groupBy("unit").cogroup(self.told.groupBy("unit")).applyInArrow(list_all, schema)

    def windows(self) -> DataFrame:
        """To each unit which of its hot windows occur twice."""
        shape = self.shape

        @tidy
        def send(key: tuple[pa.Scalar, ...], unit: pa.Table, told: pa.Table) -> pa.Table:
            _, data, _, anchors = shape.look(unit)
            _, _, hi, lo, many = shape.hot_windows(anchors, data, shape.answers(anchors, told))
            return exchange.sent(exchange.send(key[0].as_py(), hi, [lo, many], shape.ranges))

        def twice(hi: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
            lo, many = extra
            order = np.lexsort((lo, hi))
            new = np.ones(len(order), bool)
            new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(order)))
            out = np.empty(len(order), bool)
            out[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], at), size)
            return out

        sent = self.dealt.groupBy("unit").cogroup(self.told.groupBy("unit")).applyInArrow(send, exchange.SENT)
        return exchange.ask(sent, shape.ranges, twice).select("unit", F.lit(WINDOW).alias("kind"), "shard", "answer")


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, not touching spans that cover the same."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def remove_repeated_bytes(
    docs: DataFrame, n: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int | None = None, fan: int = exchange.FAN,
    most: int = MOST_CONTEXTS, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_removed, kept, spans``: each text's UTF-8 bytes without those covered by a string of ``n`` bytes
    that also starts at another place of any text, its own included. ``spans`` are the removed runs, as
    (first byte, bytes); what is kept may cut a code point, so it is binary.

    (1) The anchors of a unit, as hashes of their run and of their context, meet by ranges of runs. Runs
    that occur once are done; contexts that occur twice are repeated whole. (2) Where a run has other contexts, one of each is
    sent to the suffix array of its range, which answers the stretches of windows that are repeated.
    A run with more than ``most`` contexts, such as the edge of a passage in a third of all
    documents, is not gathered: its windows are counted by 96-bit digests over all tasks. (3) Bytes are
    removed. No step gathers more rows of a run than that, and texts are exchanged once.

    Null text: empty. Null id: null. Texts shorter than ``n`` stay whole, very long ones are read in slices. Repeated rows remove
    each other. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    plan = Plan(docs, n, k, id_col, text_col, unit_bytes, fan, most, slice_bytes)
    shape = plan.shape

    @tidy
    def cut(key: tuple[pa.Scalar, ...], unit: pa.Table, told: pa.Table) -> pa.Table:
        table, data, offsets, anchors = shape.look(unit)
        answer = shape.answers(anchors, told)
        solved = (answer[anchors.entry] & RESOLVED) > 0
        starts, ends = [anchors.p0[solved]], [anchors.p1[solved] + n]
        blobs = told.filter(pc.equal(told.column("kind"), STRETCH)).column("answer").to_pylist()
        found = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 3).astype(np.int64)
        at = anchors.at[anchors.shown[found[:, 0]]]
        starts.append(at - found[:, 2])
        ends.append(at - found[:, 1] + n)
        places, number, hi, _, _ = shape.hot_windows(anchors, data, answer)
        twice = exchange.told_values(told.filter(pc.equal(told.column("kind"), WINDOW)), hi, shape.ranges, 0, bool)
        hit = places[twice[number]] if len(places) else places
        a, b = merged_spans(np.concatenate([*starts, hit]), np.concatenate([*ends, hit + n]))
        # spans never cross documents, but may touch at their border
        border = np.unique(offsets[1:-1])
        before = np.searchsorted(a, border, side="left") - 1
        inner = border[(before >= 0) & (border < b[before])] if len(a) else border[:0]
        a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
        own = np.searchsorted(a, offsets)
        raw, rows = data.tobytes(), []
        for i in range(table.num_rows):
            x, y = a[own[i] : own[i + 1]].tolist(), b[own[i] : own[i + 1]].tolist()
            edges = [int(offsets[i]), *(e for pair in zip(x, y) for e in pair), int(offsets[i + 1])]
            kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))
            rows.append((int(offsets[i + 1] - offsets[i]), sum(y) - sum(x), kept, [{"first": s - int(offsets[i]), "bytes": e - s} for s, e in zip(x, y)]))
        sizes, removed, kept, spans = zip(*rows) if rows else ((), (), (), ())
        return pa.table(
            [pa.array(table.column("doc_id").to_numpy(), mask=table.column("null_id").to_numpy(zero_copy_only=False)), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "kept", "spans"],
        )

    told = plan.told.unionByName(plan.stretches()).unionByName(plan.windows())
    return plan.dealt.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<first:bigint,bytes:bigint>>")


def repeat_groups(
    docs: DataFrame, n: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int | None = None, fan: int = exchange.FAN,
    most: int = MOST_CONTEXTS, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Rows ``group, n_bytes, doc_id, first``: all occurrences of each maximal repeat of ``n`` bytes or more, by first byte in the text's
    UTF-8; ``group`` is the SHA-256 of its bytes. A repeat is looked at within the context of one anchor: one longer than that is listed
    as the contexts it runs through. The suffix array takes one of each context; occurrences are joined to what it finds, so a group
    of any size is never in one task. Contexts of runs that have more than ``most`` of them are listed as far as they occur twice
    whole. Nulls, ties and other columns as in ``remove_repeated_bytes``."""
    plan = Plan(docs, n, k, id_col, text_col, unit_bytes, fan, most, slice_bytes, every=True)
    all_ = plan.occurrences()
    whole = all_.where("group is not null").select("group", "n_bytes", "doc_id", "first")
    found = plan.groups().join(all_.select("run", "context", "doc_id", "at"), ["run", "context"]).select("group", "n_bytes", "doc_id", (F.col("at") - F.col("back")).alias("first"))
    return whole.unionByName(found).distinct()
