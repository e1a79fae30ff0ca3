"""Sharding along a Hilbert curve over quantised metadata, with DataFrame operators only."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import materialize


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """Hilbert index of a grid point (each coordinate below ``2**bits``), by Skilling's transform:
    undo the excess rotations from the top bit down, Gray-encode, interleave the bits."""
    x = list(point)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            t ^= (1 << b) - 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v ^ t) >> b & 1
    return index


def curve_column(axes: list[str], bits: int) -> Column:
    """The index as a lookup in the constant array of all grid points, which the parameters bound."""
    points = product(range(1 << bits), repeat=len(axes))
    table = ",".join(str(curve_index(p, bits)) for p in points)
    code = "0"
    for a in axes:
        code = f"({code}) * {1 << bits} + {a}"
    return F.expr(f"cast(element_at(array({table}), cast({code} as int) + 1) as bigint)")


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.TimestampType, T.DateType))


def _position(df: DataFrame, column: str) -> Column:
    """The column in its own order: numbers and times as doubles, null and NaN below all; else its
    string, null where it is null."""
    if not _is_number(df, column):
        return F.col(column).cast("string")
    time = isinstance(df.schema[column].dataType, (T.TimestampType, T.DateType))
    value = (F.col(column).cast("timestamp") if time else F.col(column)).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(-1e300)), F.lit(-1e300))


def string_borders(rows: DataFrame, column: str, steps: int) -> list[str]:
    """The whole strings at the ``steps - 1`` quantiles of a column. Each distinct string is counted, the
    counted strings are sorted over all tasks, and running sums inside partitions meet the sums of
    the partitions before: one number for each partition reaches the driver, and the borders."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = materialize(counted.orderBy("v").withColumn("p", F.spark_partition_id()), "strings")
    before, total = {}, 0
    for r in placed.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        before[r.p], total = total, total + r.n
    if not total:
        return []
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("p"))
    run = placed.withColumn("e", start + F.sum("n").over(W.partitionBy("p").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    step = lambda c: F.floor(c * steps / total)
    crossed = run.where(step(F.col("e")) > step(F.col("e") - F.col("n")))
    return [r.v for r in crossed.select("v").orderBy("v").collect()][: steps - 1]


def hilbert_shards(
    docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 50_000
) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, cell, curve, shard, slot``: each document's shard and its
    place there, in runs of the Hilbert order over ``dims``. Shard sizes differ by one row at most.

    Each dimension is quantised at ``2**bits - 1`` quantiles, of whole strings where it is one (see
    ``string_borders``); only those reach the driver. A cell is a point of the grid, of which there are
    ``2**(bits * len(dims))`` at most (4,096 by default, 32,768 allowed, so the table of cells is
    broadcast); a cell with more than ``bucket_rows`` rows is cut by a hash of the row into buckets of
    about that many, rows alike in id and text too. Ranks come from the running sum over bucket counts (one row for each cell and each
    ``bucket_rows`` rows) and from row numbers inside buckets, so neither a hot cell nor the whole
    table is ever in one task, and texts are never shuffled.

    size: UTF-8 bytes plus 1. Null text: size 1, the checksum of the empty text. A null in a
    dimension is its own lowest value. Ties in id and text take neighbouring slots. Empty table: no
    rows. Columns other than those named are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *[_position(docs, c).alias(f"__d{i}") for i, c in enumerate(dims)],
    )
    steps = 1 << bits
    numbers = [i for i, c in enumerate(dims) if _is_number(docs, c)]
    places = [k / steps for k in range(1, steps)]
    cuts = docs.select(F.lit(0), *[_position(docs, dims[i]).alias(f"__d{i}") for i in numbers]).agg(F.count("*"), *[F.percentile_approx(f"__d{i}", places, 10_000).alias(f"__d{i}") for i in numbers]).first()
    axes = []
    for i, c in enumerate(dims):
        borders = sorted(set(cuts[f"__d{i}"] or [])) if i in numbers else string_borders(docs.select(_position(docs, c).alias("__v")), "__v", steps)
        axis = F.lit(0)
        for border in borders:  # at most 2**bits - 1 comparisons in the row's own generated code
            axis = axis + F.coalesce((F.lit(border) < F.col(f"__d{i}")).cast("int"), F.lit(0))
        axes.append(f"__a{i}")
        rows = rows.withColumn(f"__a{i}", axis.cast("int"))
    # the row's place in its input tells rows alike in id and text apart; as that may change when rows are computed anew, they are written
    salted = F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())
    rows = materialize(rows.drop(*[f"__d{i}" for i in range(len(dims))]).withColumn("__h", F.pmod(salted, F.lit(1 << 31))), "cells")
    if bits * len(dims) > 15:
        raise ValueError("the grid may have 32,768 cells at most")
    cells = rows.groupBy(*axes).agg(F.count("*").alias("__n")).withColumn("curve", curve_column(axes, bits)).withColumn("__parts", F.ceil(F.col("__n") / bucket_rows))
    placed = rows.join(F.broadcast(cells.drop("__n")), axes).withColumn("__part", F.shiftright(F.col("__h") * F.col("__parts"), 31))
    buckets = placed.groupBy("curve", "__part").agg(F.count("*").alias("__n"))
    order = W.orderBy("curve", "__part")
    buckets = buckets.select(
        "curve", "__part", (F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__start"), F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__all")
    )
    inside = W.partitionBy("curve", "__part").orderBy("__h", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("__r", F.row_number().over(inside)).join(buckets, ["curve", "__part"]).withColumn("__r", F.col("__start") + F.col("__r") - 1)
    shard = F.expr(f"(({shards} * (__r + 1) - 1) div __all)")
    cell = F.lit(0).cast("long")
    for a in axes:
        cell = cell * steps + F.col(a)
    return ranked.select(
        "doc_id", "size", "text_crc32", cell.alias("cell"), "curve", shard.cast("int").alias("shard"), (F.col("__r") - F.expr(f"(({shards} * (__r + 1) - 1) div __all) * __all div {shards}")).cast("long").alias("slot")
    )


def shard_ranges(placed: DataFrame, dims: list[str]) -> DataFrame:
    """For each shard its rows, bytes and the least and greatest value of each dimension: what a
    reader needs to skip files."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])
