"""N-gram Jaccard self-join: documents whose shingle sets overlap, by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.order import numbered
from ..storage import discard, materialize
from . import exchange, sketch
from . import kernels as K
from .joins import spread_join
from .memory import tidy
from .units import deal, load, prepared, raw_text, text_bytes, text_chunks, unit_count, unit_of

#: Seeds whose hubs a task keeps for each incidence; incidences that it looks at, and pairs that it sends, at once.
SEEDS_AT_ONCE, AT_ONCE = 4, 1 << 20
#: Text of a fragment; where all of it goes on, a task holds some twenty times as much.
FRAGMENT_BYTES = 32 << 20
SEGMENT = "frag int, doc long, tag long, size int, have int, tokens binary"
LINK = "a long, atag long, asize int, b long, btag long, bsize int, partial int"


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles (64-bit, A-Z lower-cased) of each document, ascending in each, and
    their number. Fewer words than n: the whole sequence as one; no words: none."""
    sets, sizes = [], []
    for _, chunk in text_chunks(column, lower=True):
        hashes = chunk.hashes()
        lengths = np.diff(chunk.first)
        full = K.ngrams(hashes, n)
        short = {m: K.ngrams(hashes, m) for m in range(1, n) if (lengths == m).any()}
        for a, m in zip(chunk.first[:-1].tolist(), lengths.tolist()):
            if m < n:
                own = short[m][a : a + 1] if m else full[:0]
            else:
                own = np.sort(full[a : a + m - n + 1])
                if len(own) > 1:
                    keep = np.ones(len(own), bool)
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    own = own[keep]
            sets.append(own)
            sizes.append(len(own))
    return (np.concatenate(sets) if sets else np.zeros(0, K.U64)), np.array(sizes, np.int64)


def measured_sets(column: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and ``_digests`` of each document's set, a chunk of text at a time, so that a long batch holds no more than its texts."""
    ends, found = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), []
    for a, b in K.chunks(np.diff(ends, prepend=0)):
        shingles, sizes = shingle_sets(column.slice(a, b - a), n)
        found.append((sizes, *_digests(shingles, sizes)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _digests(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of mixed shingles."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (61, 62):
            sums = np.concatenate((np.zeros(1, K.U64), np.cumsum(K.mix64(shingles ^ K.seeded(seed, 1)[0]), dtype=K.U64)))
            ends = np.cumsum(sizes)
            out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return out[0], out[1]


def _reaches(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


class _Fragment:
    """The segments of one fragment: incidences by token, tokens of one component left out."""

    def __init__(self, table: pa.Table):
        self.doc, self.tag = (table.column(c).to_numpy() for c in ("doc", "tag"))
        alone = pa.array(-1 - np.arange(len(self.doc)))  # a record that is linked with none is its own component
        self.comp = pc.coalesce(table.column("comp").combine_chunks(), alone).to_numpy(zero_copy_only=False)
        self.size, self.have = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "have"))
        data, ends = raw_text(table.column("tokens"))  # no object for each record: a fragment has the more of them, the more documents there are
        self.length = np.diff(ends) // 8
        token, rec = data.view(K.U64), np.repeat(np.arange(len(self.doc), dtype=np.int32), self.length)
        blocks = -(-len(token) // AT_ONCE)
        block = (token.astype(np.uint32) % np.uint32(max(blocks, 1))).astype(np.uint16)  # equal tokens meet in a block
        recs, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(blocks):
            here = np.flatnonzero(block == k) if blocks > 1 else np.arange(len(token))
            if not len(here):
                continue
            own = token[here]
            order = np.argsort(own, kind="stable")
            own, who = own[order], rec[here[order]]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            comp = self.comp[who]
            cross = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
            size = np.diff(np.append(at, len(who)))
            recs.append(who[np.repeat(cross, size)])
            counts.append(size[cross])
        self.rec, self.counts = np.concatenate(recs), np.concatenate(counts)
        self.starts = np.cumsum(self.counts) - self.counts

    def pieces(self) -> Iterator["_Piece"]:
        """The incidences some tokens at a time, ``AT_ONCE`` about."""
        ends = np.cumsum(self.counts)
        a = 0
        while a < len(ends):
            first = self.starts[a]
            b = max(a + 1, int(np.searchsorted(ends, first + AT_ONCE, side="right")))
            yield _Piece(self.rec[first : ends[b - 1]].astype(np.int64), self.counts[a:b])
            a = b

    def can_reach(self, a: np.ndarray, b: np.ndarray, partial: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of records can still reach the threshold with all that lies outside this fragment."""
        rest = np.minimum(self.have[a] - self.length[a], self.have[b] - self.length[b])
        return _reaches(partial + rest, self.size[a], self.size[b], percent)

    def links(self, a: np.ndarray, b: np.ndarray, partial: np.ndarray, percent: int) -> pa.Table:
        """Pairs of records that can still reach the threshold with all that lies outside this fragment."""
        open_pairs = self.can_reach(a, b, partial, percent)
        a, b, partial = a[open_pairs], b[open_pairs], partial[open_pairs]
        arrays = [self.doc[a], self.tag[a], self.size[a].astype(np.int32), self.doc[b], self.tag[b], self.size[b].astype(np.int32), partial.astype(np.int32)]
        return pa.table([pa.array(x) for x in arrays], ["a", "atag", "asize", "b", "btag", "bsize", "partial"])


class _Piece:
    """The incidences of some tokens: records, and where each token's begin."""

    def __init__(self, rec: np.ndarray, counts: np.ndarray):
        self.rec, self.starts = rec, np.cumsum(counts) - counts
        self.group = np.repeat(np.arange(len(counts)), counts)


def _no_links() -> pa.Table:
    return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())], ["a", "atag", "asize", "b", "btag", "bsize", "partial"])


def _hub_links(segments: DataFrame, seeds: tuple[int, ...], percent: int) -> DataFrame:
    """Links between records and hubs of other components. For each seed a token's hub is its holder
    of highest priority; a record counts the tokens it shares with each of its hubs, a token once
    however many of a few seeds give it the same hub. Those counts never exceed the overlap, so what
    reaches the threshold is a link; a row for each record and hub."""

    @tidy
    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Fragment(pa.Table.from_batches(list(batches)))
        n = len(part.doc)
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in range(0, len(seeds), SEEDS_AT_ONCE):
            shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for piece in part.pieces():
                comp = part.comp[piece.rec]
                before, found = [], [shared]
                for k in seeds[block : block + SEEDS_AT_ONCE]:
                    own = K.mix64((part.doc ^ part.tag).view(K.U64) ^ K.seeded(700 + k, 1)[0])
                    if k == 0:  # the least edited text first: the largest share of tokens that others have
                        own = ((part.have * 65535 // np.maximum(part.size, 1)).astype(K.U64) << K.U64(47)) | (own >> K.U64(17))
                    own |= K.U64(1)
                    priority = own[piece.rec]
                    hub = _top(piece, priority)
                    same = comp == part.comp[hub][piece.group]
                    other = _top(piece, np.where(same, K.U64(0), priority))
                    chosen = np.where(same, other[piece.group], hub[piece.group])
                    ok = part.comp[chosen] != comp
                    for earlier in before:
                        ok &= chosen != earlier
                    before.append(chosen.astype(np.int32))
                    found.append(_tallied(piece.rec[ok] * n + chosen[ok], None, np.add))
                shared = _tallied(*(np.concatenate(x) for x in zip(*found)), np.add)
            hopeful = part.can_reach(shared[0] // n, shared[0] % n, shared[1], percent)  # a greater count of another block reaches by itself
            shared = shared[0][hopeful], shared[1][hopeful]
            pairs, counts = _tallied(np.concatenate((pairs, shared[0])), np.concatenate((counts, shared[1])), np.maximum)
        for at in range(0, len(pairs), AT_ONCE):
            here = pairs[at : at + AT_ONCE]
            yield from part.links(here // n, here % n, counts[at : at + AT_ONCE], percent).to_batches()

    return _summed(segments.groupBy("frag").applyInArrow(star, LINK), percent)


def _tallied(pairs: np.ndarray, counts: np.ndarray | None, how: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, and their counts put together; without counts, how often each occurs."""
    order = None if counts is None else np.argsort(pairs)
    pairs = np.sort(pairs) if counts is None else pairs[order]
    at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
    if counts is None:
        return pairs[at], np.diff(np.append(at, len(pairs)))
    return pairs[at], how.reduceat(counts[order], at) if len(at) else counts


def _top(part: _Piece, priority: np.ndarray) -> np.ndarray:
    """Record of the highest priority among each token's holders."""
    best = np.maximum.reduceat(priority, part.starts)
    hub = np.zeros(len(part.starts), np.int64)
    top = priority == best[part.group]
    hub[part.group[top]] = part.rec[top]
    return hub


def _all_links(segments: DataFrame, percent: int) -> DataFrame:
    """All links between records of different components: full partial overlaps, summed over fragments."""

    @tidy
    def count(piece: pa.Table) -> pa.Table:
        part = _Fragment(piece)
        if not len(part.rec):
            return _no_links()
        comps, number, members = np.unique(part.comp, return_inverse=True, return_counts=True)
        place = np.empty(len(comps), np.int64)
        place[np.lexsort((comps, members))] = np.arange(len(comps))
        rank = place[number]  # records of small components look for those of larger ones
        order = np.argsort(part.rec, kind="stable")
        groups = np.repeat(np.arange(len(part.counts)), part.counts)[order]
        ends = np.cumsum(np.bincount(part.rec, minlength=len(part.doc)))
        begin, out = 0, []
        for a, end in enumerate(ends.tolist()):
            mine = groups[begin:end]
            begin = end
            if not len(mine) or rank[a] == len(comps) - 1:
                continue
            lengths = part.counts[mine]
            steps = np.arange(int(lengths.sum())) + np.repeat(part.starts[mine] - (np.cumsum(lengths) - lengths), lengths)
            b, seen = np.unique(part.rec[steps], return_counts=True)
            ok = (rank[b] > rank[a]) & (100 * np.minimum(part.size[b], part.size[a]) >= percent * np.maximum(part.size[b], part.size[a]))
            b, seen = b[ok], seen[ok]
            ok = part.can_reach(np.full(len(b), a), b, seen, percent)
            if ok.any():
                out.append((np.full(int(ok.sum()), a), b[ok], seen[ok]))
        if not out:
            return _no_links()
        a, b, seen = (np.concatenate(x) for x in zip(*out))
        # ranks differ between fragments: the ends of a pair stand by (doc, tag), the same in all
        ahead = (part.doc[b] > part.doc[a]) | ((part.doc[b] == part.doc[a]) & (part.tag[b] > part.tag[a]))
        return part.links(np.where(ahead, a, b), np.where(ahead, b, a), seen, percent)

    return _summed(segments.groupBy("frag").applyInArrow(count, LINK), percent)


def _summed(partial: DataFrame, percent: int) -> DataFrame:
    """Sum the partial overlaps of each pair; pairs that reach the threshold."""
    total = partial.groupBy("a", "atag", "asize", "b", "btag", "bsize").agg(F.sum("partial").alias("overlap"))
    return total.where(_reaches(F.col("overlap"), F.col("asize"), F.col("bsize"), percent)).select(F.col("a").alias("src"), "atag", F.col("b").alias("dst"), "btag").distinct()


def _joined(links: DataFrame) -> DataFrame:
    """``doc, tag, component`` of all records that a link names. Rows that share an id, or have none, are one record only if their
    shingle sets are equal. Records are numbered in their order, so no two of them can meet in one number."""
    both = links.select(F.explode(F.array(F.struct(F.col("src").alias("doc"), F.col("atag").alias("tag")), F.struct(F.col("dst").alias("doc"), F.col("btag").alias("tag")))).alias("r"))
    ids = materialize(numbered(both.select("r.doc", "r.tag").distinct(), "doc", "tag", name="node"), "records")
    end = lambda doc, tag, name: ids.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("node").alias(name))
    pairs = links.join(end("src", "atag", "a"), ["src", "atag"]).join(end("dst", "btag", "b"), ["dst", "btag"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(pairs).select("node", "component")
    return ids.join(found, "node").select("doc", "tag", "component")


def _in_components(segments: DataFrame, components: DataFrame | None) -> DataFrame:
    """Segments with ``comp``, null for records without a link."""
    if components is None:
        return segments.withColumn("comp", F.lit(None).cast("long"))
    return segments.join(components, ["doc", "tag"], "left").withColumnRenamed("component", "comp")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int | None = None, fragments: int | None = None, fan: int = exchange.FAN) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id`` for each document: the size of its set of distinct
    n-word shingles (A-Z lower-cased) and the smallest id reachable over links. Two documents link
    when ``100 * |intersection| >= percent * |union|``.

    1. Equal sets form a class; only its smallest id goes on. Copies are never paired.
    2. A merged sketch (``sketch``) drops documents too few of whose shingles occur elsewhere: a link
       needs ``percent`` % of either set in common. Overestimates only keep more.
    3. Vertical partitioning: the global n-gram order (that of the 64-bit hashes, so equal ranges
       hold equal parts) is cut into fragments; each remaining set is cut into segments there.
       Overlaps are counted in each fragment apart and summed for each pair. First with hubs, which
       takes a row for each incidence at most and joins whole groups of copies; then exactly for the
       pairs of documents that are still in different components and share enough across them.

    Every link between different components is found; links inside a component that is already
    connected are not listed, as they change no result. The exact step is quadratic only in documents
    that share three quarters of their shingles with other components and yet have not joined them.

    Null or word-less text: size 0, linked with nothing. Null id: after the greatest id, returned
    as null. Rows that share an id, or have none, are documents of their own where links are followed,
    unless their shingle sets are equal. Repeated rows get the same class each. Texts of any length are
    read whole. Empty table: no rows. Columns other than the two read are ignored, whatever their names.
    """
    return representatives_of_rows(docs, n, percent, id_col, text_col, unit_bytes, fragments, fan).drop("mark", "first")


def representatives_of_rows(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int | None = None, fragments: int | None = None, fan: int = exchange.FAN) -> DataFrame:
    """``near_duplicates`` with ``mark``, a hash of the text that tells rows of one id apart, and
    ``first``: whether the row's (id, mark) is the smallest of its component."""
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    units = unit_count(total, unit_bytes)
    ranges, fragments = exchange.Ranges(units, sketch.bits_for(total), fan), fragments or max(1, -(-total // FRAGMENT_BYTES))
    source = prepared(docs, id_col, text_col)

    @tidy
    def measure(batches):
        for batch in batches:
            sizes, c1, c2 = measured_sets(batch.column("text"), n)
            columns = [batch.column("doc_id"), batch.column("null_id"), batch.column("mark"), pa.array(sizes), pa.array(c1), pa.array(c2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "null_id", "mark", "n", "c1", "c2"])

    marked = source.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    measured = materialize(marked.mapInArrow(measure, "doc long, null_id boolean, mark long, n long, c1 long, c2 long"), "sets")
    classes = measured.where("n > 0").groupBy("n", "c1", "c2").agg(F.min(F.struct("doc", "null_id", "mark")).alias("least")).select("n", "c1", "c2", F.col("least.doc").alias("rep"), "least")
    chosen = classes.select(unit_of(F.col("rep"), units).alias("unit"), F.col("rep").alias("doc"), "c1", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("answer"))
    dealt = deal(source, units)

    def representatives(table: pa.Table, side: pa.Table):
        """Shingles, sizes, ids and tags of the unit's class representatives."""
        wanted = set(zip(side.column("doc").to_pylist(), side.column("c1").to_pylist())) - {(None, None)}
        near = table.filter(pa.array(np.isin(table.column("doc_id").to_numpy(), np.array([d for d, _ in wanted], np.int64))))
        shingles, sizes = shingle_sets(near.column("text"), n)
        tags, _ = _digests(shingles, sizes)
        doc = near.column("doc_id").to_numpy()
        keep = np.zeros(len(doc), bool)
        for i, key in enumerate(zip(doc.tolist(), tags.tolist())):
            if key in wanted:
                wanted.discard(key)
                keep[i] = True
        return shingles[np.repeat(keep, sizes)], sizes[keep], doc[keep], tags[keep]

    @tidy
    def first_pass(key: tuple[pa.Scalar, ...], unit: pa.Table, side: pa.Table) -> pa.Table:
        shingles, sizes, _, _ = representatives(load(unit), side)
        return sketch.send(key[0].as_py(), shingles, np.repeat(np.arange(len(sizes)), sizes), 1, ranges)

    @tidy
    def second_pass(key: tuple[pa.Scalar, ...], unit: pa.Table, side: pa.Table) -> pa.Table:
        is_told = side.column("shard").is_valid()
        told = side.filter(is_told)
        shingles, sizes, doc, tags = representatives(load(unit), side.filter(pc.invert(is_told)))
        high = sketch.estimated_repeats(shingles, told, 1, ranges)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        have = np.bincount(owner[high], minlength=len(sizes))
        wanted = high & (100 * have >= percent * sizes)[owner]
        own, owner = shingles[wanted], owner[wanted]
        frag = (((own >> K.U64(32)) * K.U64(fragments)) >> K.U64(32)).astype(np.int32)
        at = np.flatnonzero((np.diff(frag, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        ends = pa.py_buffer((np.append(at, len(own)) * 8).astype(np.int32))
        tokens = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(own)])
        i = owner[at]
        columns = [frag[at], doc[i], tags[i], sizes[i].astype(np.int32), have[i].astype(np.int32)]
        return pa.table([*(pa.array(x) for x in columns), tokens], ["frag", "doc", "tag", "size", "have", "tokens"])

    told = sketch.merge(dealt.groupBy("unit").cogroup(chosen.groupBy("unit")).applyInArrow(first_pass, exchange.SENT), ranges)
    side = chosen.unionByName(told.select("unit", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("c1"), "shard", "answer"))
    segments = materialize(dealt.groupBy("unit").cogroup(side.groupBy("unit")).applyInArrow(second_pass, SEGMENT), "segments")

    first = materialize(_hub_links(_in_components(segments, None), tuple(range(8)), percent), "links")
    few = materialize(_joined(first), "components")
    more = materialize(_hub_links(_in_components(segments, few), tuple(range(8, 24)), percent), "links")
    links = first.unionByName(more)
    components = materialize(_joined(links), "components")

    @tidy
    def crossing(piece: pa.Table) -> pa.Table:
        part = _Fragment(piece)
        return pa.table([pa.array(part.doc), pa.array(part.tag), pa.array(part.size.astype(np.int32)), pa.array(np.bincount(part.rec, minlength=len(part.doc)).astype(np.int32))], ["doc", "tag", "size", "cross"])

    placed = _in_components(segments, components)
    open_docs = placed.groupBy("frag").applyInArrow(crossing, "doc long, tag long, size int, cross int").groupBy("doc", "tag", "size").agg(F.sum("cross").alias("cross")).where(f"100 * cross >= {percent} * size")
    rest = materialize(_all_links(placed.join(open_docs.select("doc", "tag"), ["doc", "tag"], "left_semi"), percent), "links")
    final = materialize(_joined(links.unionByName(rest)), "components")
    records = classes.withColumnsRenamed({"rep": "doc", "c1": "tag"})
    linked = final.join(records.select("doc", "tag", "least"), ["doc", "tag"])
    heads = linked.join(linked.groupBy("component").agg(F.min("least").alias("head")), "component").select("doc", "tag", "head")
    named = materialize(records.join(heads, ["doc", "tag"], "left").select("n", F.col("tag").alias("c1"), "c2", F.coalesce("head", "least").alias("head")), "named")
    discard(segments, first, few, more, components, rest, final)
    own = F.struct("doc", "null_id", "mark")
    alone = measured.where("n = 0").withColumn("head", own)
    joined = spread_join(measured.where("n > 0"), named, ["n", "c1", "c2"])
    real = lambda c, null: F.when(~null, c)
    return joined.unionByName(alone).select(
        real(F.col("doc"), F.col("null_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.col("head.doc"), F.col("head.null_id")).alias("component_id"), "mark", (F.col("head") == own).alias("first")
    )
