"""Benchmark decontamination: which documents contain a benchmark item."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .memory import tidy
from .ngram_join import shingle_sets
from .units import plain_columns, text_chunks

#: UTF-8 bytes of benchmark text that tasks get at once; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Shingles of the smallest half-block.
GRAIN = 16
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, mark long"


class ItemIndex:
    """Items by size class, with a MinHash value for each function; and their shingles for the exact check."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, n: int, functions: int):
        shingles, sizes = shingle_sets(texts, n)
        keep = sizes > 0
        self.ids, self.sizes = ids[keep], sizes[keep]
        shingles = shingles[np.repeat(keep, sizes)]
        item = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.shingle, at, self.holders = np.unique(shingles[order], return_index=True, return_counts=True)
        self.first, self.item = at, item[order]
        self.factors = K.seeded(83, functions) | K.U64(1)
        #: Items of few shingles have too small a share of any block: all their shingles are looked up.
        self.tiny = np.unique(shingles[np.repeat(self.sizes < GRAIN // 2, self.sizes)])
        level = np.maximum(np.ceil(np.log2(np.maximum(self.sizes, 1) / GRAIN)), 0).astype(int)
        self.levels: dict[int, list[np.ndarray]] = {}
        starts = np.cumsum(self.sizes) - self.sizes
        for k in sorted(set(level[self.sizes >= GRAIN // 2].tolist())):
            mine = np.flatnonzero((level == k) & (self.sizes >= GRAIN // 2))
            with np.errstate(over="ignore"):
                self.levels[k] = [np.unique([(shingles[starts[i] : starts[i] + self.sizes[i]] * a).min() for i in mine]) for a in self.factors]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """Shingles that each item has in common with an ascending set."""
        at = np.searchsorted(self.shingle, own)
        at[at == len(self.shingle)] = 0
        at = at[self.shingle[at] == own] if len(self.shingle) else at[:0]
        counts = self.holders[at]
        steps = np.arange(int(counts.sum())) + np.repeat(self.first[at] - (np.cumsum(counts) - counts), counts)
        return np.bincount(self.item[steps], minlength=len(self.ids))


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def candidates(index: ItemIndex, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Documents (by position) with a block that shares a MinHash value with an item of its size class.

    Each document is cut into half-blocks of ``GRAIN`` shingles, then pairs of them, and so on; a
    block is two neighbouring half-blocks. An item of at most ``2**k * GRAIN`` shingles that stands in
    a document lies in one block of class k, of which it makes up a fifth at least, however long the
    document is."""
    hit = np.zeros(len(counts), bool)
    halves = -(-counts // GRAIN)
    doc = np.repeat(np.arange(len(counts)), halves)
    within = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
    starts = np.repeat(np.cumsum(counts) - counts, halves) + within * GRAIN
    if not len(starts):
        return hit
    if len(index.tiny):
        hit[np.repeat(np.arange(len(counts)), counts)[_among(grams, index.tiny)]] = True
    top = max(index.levels, default=-1)
    for j, a in enumerate(index.factors):
        with np.errstate(over="ignore"):
            least = np.minimum.reduceat(grams * a, starts)
        own, place = doc, within
        for k in range(top + 1):
            if k:
                at = np.flatnonzero(place % 2 == 0)
                least, own, place = np.minimum.reduceat(least, at), own[at], place[at] // 2
            if k in index.levels:
                both = least.copy()
                pair = own[1:] == own[:-1]
                both[:-1][pair] = np.minimum(least[:-1][pair], least[1:][pair])
                hit[own[_among(both, index.levels[k][j])]] = True
    return hit


def find_contamination(
    docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 75, functions: int = 64, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, marked: bool = False
) -> DataFrame:
    """Rows ``doc_id, item_id, n_item, n_shared``: each document that has ``percent`` % of an item's
    distinct n-word shingles (A-Z lower-cased) in its whole text, with both counts.

    Search: MinHash over blocks of documents, partitioned by size as in an LSH ensemble, one value
    for each band as small shares need (see ``candidates``); a document is missed with a chance of
    about ``(1 - 0.18) ** functions``, four in a million. Check: exact counts over the whole
    document's shingle set, so nothing that falls short is returned. One scan of the documents, no
    shuffle; the items go to the tasks in blocks of ``block_bytes`` of text, one scan for each block.

    Items or documents without words match nothing; texts shorter than ``n`` words are one shingle.
    Null ids are returned as null. Repeated rows give repeated pairs. Empty tables: no rows.
    ``marked`` adds ``mark``, a hash of the text that tells rows of one id, or of none, apart.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    total = int(items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    blocks = max(1, -(-total // block_bytes))
    source, out = plain_columns(docs, id_col, text_col), None
    source = source.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))) if marked else F.lit(None).cast("long"))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.toArrow()
        ids = rows.column("item_id").to_pylist()
        index = ItemIndex(np.arange(len(ids)), rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), n, functions)
        shared = spark.sparkContext.broadcast((ids, index))

        @tidy
        def search(batches, shared=shared):
            ids, index = shared.value
            for batch in batches:
                found: tuple[list, ...] = ([], [], [], [], [])
                doc_ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark")
                for base, chunk in text_chunks(batch.column("text"), lower=True) if len(index.ids) else ():
                    hashes = chunk.hashes()
                    inside, counts = K.window_starts(chunk.first, n)
                    grams = K.ngrams(hashes, n)[inside]
                    lengths, ends = np.diff(chunk.first), np.cumsum(counts)
                    hit = candidates(index, grams, counts)
                    for i in np.flatnonzero(hit | ((lengths > 0) & (lengths < n))).tolist():
                        own = np.unique(grams[ends[i] - counts[i] : ends[i]])
                        if lengths[i] < n:
                            own = K.ngrams(hashes[chunk.first[i] : chunk.first[i + 1]], int(lengths[i]))
                        common = index.shared(own)
                        for k in np.flatnonzero((common > 0) & (100 * common >= percent * index.sizes)).tolist():
                            for store, value in zip(found, (doc_ids[base + i], ids[index.ids[k]], int(index.sizes[k]), int(common[k]), marks[base + i].as_py())):
                                store.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc_id", "item_id", "n_item", "n_shared", "mark"])

        pairs = source.mapInArrow(search, SCHEMA)
        out = pairs if out is None else out.unionByName(pairs)
    return out if marked else out.drop("mark")
