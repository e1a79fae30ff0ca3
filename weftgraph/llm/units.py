"""Units: documents dealt into blocks of bounded bytes by a hash of their id.

An operator that must look at a document more than once, with corpus-wide findings in between,
deals the texts once (``deal``) and groups by ``unit`` in each pass. The exchange of the texts is
then the same in each pass and Spark runs it once. What passes send each other are sorted arrays,
not rows (``exchange``): a hot key takes one entry for each unit, never one for each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .memory import tidy

#: Place of a null doc_id in the order of ids: that of the greatest one. ``null_id`` tells it from a real one.
NO_ID = 2**63 - 1
#: Text of one unit.
UNIT_BYTES = 5 << 20
#: Raw bytes of one packed block at most, if it holds more than one document.
BLOCK_BYTES = 4 << 20


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, by one scan of that column."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0)


def unit_count(total_bytes: int, unit_bytes: int | None = None) -> int:
    """Units of 5 MB of text, at every size."""
    return max(1, -(-total_bytes // (unit_bytes or UNIT_BYTES)))


def unit_of(doc_id: Column, units: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(NO_ID))), F.lit(units)).cast("int")


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` (null: NO_ID), whether it was null, and ``text`` (null stays null) under those names, and
    the carried columns."""
    own = F.col(id_col).cast("long")
    return docs.select(
        F.coalesce(own, F.lit(NO_ID)).alias("doc_id"), own.isNull().alias("null_id"), F.col(text_col).cast("string").alias("text"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    )


def plain_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` under those names, nulls as they are: for operators that compare no ids."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def deal(docs: DataFrame, units: int) -> DataFrame:
    """Rows ``(unit, blob)``: the columns of ``docs``, cut into compressed blocks of each unit."""

    @tidy
    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            unit = batch.column("unit").to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(unit, kind="stable")
            ranked, sizes = unit[order], np.cumsum(lengths[order] + 64)
            cut = np.flatnonzero((np.diff(ranked) != 0) | (np.diff(sizes // BLOCK_BYTES) != 0)) + 1
            edges = [0, *cut.tolist(), len(order)]
            table = table.drop(["unit"])
            blobs = [_dump(table.take(pa.array(order[a:b]))) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ranked[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["unit", "blob"])

    return docs.withColumn("unit", unit_of(F.col("doc_id"), units)).mapInArrow(pack, "unit int, blob binary")


def _dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def load(unit: pa.Table) -> pa.Table:
    """The documents of one unit, in an order that does not hang on how its blocks arrived."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in unit.column("blob").combine_chunks() if x.is_valid] if unit.num_rows else []
    if not parts:
        return pa.table({"doc_id": pa.array([], pa.int64()), "null_id": pa.array([], pa.bool_()), "text": pa.array([], pa.string())})
    table = pa.concat_tables(parts)
    return table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))


class Chunk:
    """Some documents of a batch: bytes, offsets, word borders and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = K.ASCII_LOWER[data] if lower else data
        self.starts, self.ends, self.first = K.words(self.data, offsets)

    def hashes(self) -> np.ndarray:
        return K.hash_words(self.data, self.starts, self.ends)


def raw_text(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets (nulls: empty) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    buffers = wide.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column, lower: bool = False):
    """``Chunk`` after ``Chunk`` of a text column, with the index of its first document."""
    data, offsets = raw_text(column)
    for a, b in K.chunks(np.diff(offsets)):
        yield a, Chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)


def windows(column, n: int, lower: bool = False, families: tuple[int, ...] = (1,)) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each family a hash of each run of n words inside a document, in text order; the number of
    runs of each document; the number of its words."""
    out: list[list[np.ndarray]] = [[] for _ in families]
    counts, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, chunk in text_chunks(column, lower):
        hashes = chunk.hashes()
        inside, count = K.window_starts(chunk.first, n)
        for store, seed in zip(out, families):
            store.append(K.ngrams(hashes, n, seed)[inside])
        counts.append(count)
        words.append(np.diff(chunk.first))
    return [np.concatenate(x) if x else np.zeros(0, K.U64) for x in out], np.concatenate(counts), np.concatenate(words)
