"""A table of daily files that rows arrive late for: days are rewritten by slices of time.

A layout holds one row for each id, the one that arrived last, in ``day=<d>/file_no=<k>`` folders with one Parquet
file each; a day is sorted by (time, id) and cut into files of the same number of rows. Late rows change some
days. Their stored rows, the ids that leave and the rows that come in meet by slices of time
(``Slices``), each slice is merged, and running sums over the slices' counts say where files begin.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import running_sums
from ..storage import discard, materialize
from .memory import tidy

DAY = 86_400_000_000
#: Rows of a slice on average, and the most that are merged in one task.
SLICE_ROWS, MOST_ROWS = 2_048, 32_768
CELL = ["day", "slice", "piece"]


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 in UTC; a time without a zone is taken as UTC, whatever the session's zone."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{column}`)") * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def latest(rows: DataFrame, id_col: str, arrived_col: str) -> DataFrame:
    """One row for each id: that which arrived last (nulls first of all), of ties the greatest by its columns
    in order. Rows of an id are reduced where they are read, so a hot id is a row for each task."""
    rest = [c for c in rows.columns if c not in (id_col, arrived_col)]
    best = rows.groupBy(id_col).agg(F.max(F.struct(arrived_col, *rest)).alias("__best"))
    return best.select(*[F.col(id_col) if c == id_col else F.col(f"__best.`{c}`").alias(c) for c in rows.columns])


@dataclass
class Slices:
    """An order-keeping cut of (day, time, id) into bounded pieces, the same for all tables it is applied to.

    Days are cut into slices of ``width`` microseconds, so many that one holds ``SLICE_ROWS`` rows on average.
    A slice of more than ``MOST_ROWS`` rows is cut into as many equal steps of time, or, where all its rows
    have one time, of ids, and so on until no piece is over-full: a moment that holds a third of all rows
    is many pieces."""

    width: int
    splits: list[DataFrame]

    def place(self, keys: DataFrame) -> DataFrame:
        """``day``, ``slice`` and ``piece`` (empty for most) of rows with ``day``, ``t`` (microseconds of the day) and ``id``."""
        out = keys.withColumns({"slice": F.expr(f"t div {self.width}"), "piece": F.lit("")})
        for split in self.splits:
            out = _cut(out, split)
        return out


def _cut(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Append a step to the piece of rows in over-full cells. The rows of such a cell share a key; adaptive
    execution broadcasts the few cells, or splits the skewed side."""
    step = lambda x, lo, hi: f"cast(floor((cast({x} as decimal(38, 0)) - {lo}) * parts / (cast({hi} as decimal(38, 0)) - {lo} + 1)) as long)"
    number = F.expr(f"case when lo_t < hi_t then {step('t', 'lo_t', 'hi_t')} else {step('coalesce(id, lo_id)', 'lo_id', 'hi_id')} end")
    piece = F.when(F.col("parts").isNotNull(), F.concat("piece", F.lit("/"), F.lpad(number.cast("string"), 12, "0"))).otherwise(F.col("piece"))
    return rows.join(split, CELL, "left").withColumn("piece", piece).drop("parts", "lo_t", "hi_t", "lo_id", "hi_id")


def fit_slices(keys: DataFrame, slice_rows: int = SLICE_ROWS, most_rows: int = MOST_ROWS) -> Slices:
    """Slices for the rows ``day, t, id`` (id null at most once a time)."""
    found = keys.agg(F.count("*").alias("n"), F.count_distinct("day").alias("days")).first()
    per_day = max(1, -(-found.n // (slice_rows * max(1, found.days))))
    slices = Slices(max(1, DAY // per_day), [])
    while True:
        cells = slices.place(keys).groupBy(*CELL).agg(
            F.count("*").alias("n"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t"), F.coalesce(F.min("id"), F.lit(0)).alias("lo_id"), F.coalesce(F.max("id"), F.lit(0)).alias("hi_id")
        )
        full = cells.where((F.col("n") > most_rows) & ((F.col("lo_t") < F.col("hi_t")) | (F.col("lo_id") < F.col("hi_id"))))
        full = materialize(full.select(*CELL, F.greatest(F.lit(2), F.ceil(F.col("n") * 2 / most_rows)).cast("long").alias("parts"), "lo_t", "hi_t", "lo_id", "hi_id"), "slices")
        if full.isEmpty():
            discard(full)
            return slices
        slices.splits.append(full)


@dataclass
class DailyTable:
    """Names and sizes of a layout: the id, the time that sorts and gives the day, the arrival, rows of a file."""

    folder: str
    columns: T.StructType
    file_rows: int
    id_col: str = "sale_id"
    time_col: str = "sold_at"
    arrived_col: str = "arrived_at"

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``day`` (null time: -1), ``t`` and ``id`` beside the columns."""
        at = micros(rows, self.time_col)
        return rows.withColumns({
            "day": F.coalesce(F.floor(at / F.lit(DAY)), F.lit(-1)).cast("long"), "t": F.coalesce(F.pmod(at, F.lit(DAY)), F.lit(0)).cast("long"), "id": F.col(self.id_col).cast("long"),
        })

    def stored(self, spark: SparkSession) -> DataFrame:
        """All rows, with ``day`` and ``file_no`` of their file."""
        schema = T.StructType([*self.columns, T.StructField("day", T.LongType()), T.StructField("file_no", T.LongType())])
        return spark.read.schema(schema).parquet(self.folder)

    def _names(self) -> list[str]:
        return [f.name for f in self.columns]


def _merge_slices(at: DailyTable, stored: DataFrame, leaving: DataFrame, coming: DataFrame, slices: Slices) -> DataFrame:
    """Per slice: stored rows without those that leave, and those that come, sorted; ``rank`` from 0 in the slice."""
    names = at._names()
    keep = [*CELL, "t", "id", *[f"c{i}" for i in range(len(names))]]
    wide = lambda df: slices.place(df.select("day", "t", "id", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])).select(*keep)
    changes = wide(coming).withColumn("leaves", F.lit(False)).unionByName(
        slices.place(leaving.select("day", "t", "id")).withColumn("leaves", F.lit(True)), allowMissingColumns=True
    )

    @tidy
    def merge(old: pa.Table, new: pa.Table) -> pa.Table:
        leaves = new.column("leaves").combine_chunks()
        gone = new.filter(leaves)
        if gone.num_rows:
            missing = pc.is_in(old.column("id"), value_set=gone.column("id").combine_chunks())
            old = old.filter(pc.invert(missing))
        rows = pa.concat_tables([old, new.filter(pc.invert(leaves)).select(old.column_names)])
        ids = rows.column("id")
        # nulls first, then by id
        order = np.lexsort((pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(), rows.column("t").to_numpy()))
        return rows.take(pa.array(order)).append_column("rank", pa.array(np.arange(len(order))))

    old = wide(stored)
    schema = T.StructType([*old.schema, T.StructField("rank", T.LongType())])
    return old.groupBy(*CELL).cogroup(changes.groupBy(*CELL)).applyInArrow(merge, schema)


def _write(at: DailyTable, merged: DataFrame) -> DataFrame:
    """Write the merged days over what they were, one file a task at a time; ``day`` and its number of ``files``."""
    counts = merged.groupBy(*CELL).agg(F.count("*").alias("n"))
    sums = materialize(running_sums(counts, list(CELL), upto=F.col("n")).select(*CELL, (F.col("upto") - F.col("n")).alias("first"), "n"), "slice-sums")
    days = sums.groupBy("day").agg(F.min("first").alias("day_first"), F.sum("n").alias("day_rows"))
    starts = sums.join(days, "day").select(*CELL, (F.col("first") - F.col("day_first")).alias("start"))
    place = F.expr(f"(start + rank) div {at.file_rows}").cast("long")
    rows = merged.join(starts, CELL).select("day", place.alias("file_no"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(at._names())])
    dealt = rows.repartition("day", "file_no").sortWithinPartitions("day", "file_no", at.time_col, at.id_col)
    dealt.write.partitionBy("day", "file_no").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(at.folder)
    return materialize(days.select("day", F.expr(f"cast((day_rows + {at.file_rows - 1}) div {at.file_rows} as long)").alias("files")), "day-files")


def overwrite_days(at: DailyTable, rows: DataFrame) -> DataFrame:
    """Bring rows into the layout: each id keeps the row that arrived last, and the days where a row comes or leaves
    are written anew, whole; all other files stay as they are. Returns the ``day`` of each that was.

    Rows that arrived no later than the stored row of their id change nothing, so a run that was cut off can be
    repeated. Days are swapped in by Spark's dynamic partition overwrite; files beyond a day's new number go
    after that. To the driver go two numbers for each changed day. Null id: an id of its own. Null time: day -1,
    sorted by id. Null arrival: before all others. Ties in arrival: the greatest row by its columns in order.
    Repeated rows: one. Without rows nothing is written."""
    spark = rows.sparkSession
    names = at._names()
    fresh = materialize(at.keyed(latest(rows.select(*names), at.id_col, at.arrived_col)).withColumn("arrived", micros(rows, at.arrived_col)), "incoming")
    if _exists(spark, at.folder):
        kept = at.keyed(at.stored(spark)).withColumn("arrived", micros(rows, at.arrived_col))
        before = kept.select("id", F.lit(True).alias("old"), F.col("arrived").alias("old_arrived"), F.col("day").alias("old_day"), F.col("t").alias("old_t"))
        joined = fresh.join(before, fresh["id"].eqNullSafe(before["id"]), "left").drop(before["id"])
        newer = F.col("old").isNull() | F.coalesce(F.col("arrived") > F.coalesce(F.col("old_arrived"), F.lit(-(2**63))), F.lit(False))
        changes = materialize(joined.where(newer), "changes")
        coming = changes.drop("old", "old_arrived", "old_day", "old_t")
        leaving = changes.where("old").select(F.col("old_day").alias("day"), F.col("old_t").alias("t"), "id")
        days = materialize(coming.select("day").union(leaving.select("day")).distinct(), "changed-days")
        stored = kept.drop("arrived").join(days, "day", "left_semi")
        old_files = materialize(stored.groupBy("day").agg((F.max("file_no") + 1).alias("old_files")), "old-files")
    else:
        changes, coming = None, fresh
        # nothing is stored: empty tables of their own, as Spark would take two sides made of ``fresh`` for a self-join
        leaving, stored = (spark.createDataFrame([], x.schema) for x in (fresh.select("day", "t", "id"), fresh))
        days = materialize(coming.select("day").distinct(), "changed-days")
        old_files = None
    if not days.isEmpty():
        slices = fit_slices(coming.select("day", "t", "id").union(stored.select("day", "t", "id")))
        merged = materialize(_merge_slices(at, stored, leaving, coming, slices), "merged")
        files = _write(at, merged)
        if old_files is not None:
            left = old_files.join(files, "day", "left").where("old_files > coalesce(files, 0)").select("day", F.coalesce("files", F.lit(0)).alias("files"), "old_files").collect()
            _remove(spark, [f"{at.folder}/day={r.day}/file_no={k}" for r in left for k in range(r.files, r.old_files)])
        discard(merged, files, *slices.splits)
    discard(fresh, changes, old_files)
    return days


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, folder: str) -> bool:
    place, fs = _fs(spark, folder)
    return fs.exists(place)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        place, fs = _fs(spark, folder)
        fs.delete(place, True)
        above = place.getParent()
        if not fs.listStatus(above):
            fs.delete(above, False)


def describe_files(at: DailyTable, spark: SparkSession, rows_crc: list[Column], cents: Column) -> DataFrame:
    """A row for each file, of what it holds: ``day, file_no, path, n_rows, cents, rows_crc, ids_sha256, columns``.
    A file's rows are read by row number in its order, by one task, streaming: its ids are one text. ``columns``
    are those of its footer."""
    stored = at.stored(spark)
    crc = F.crc32(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in rows_crc]).cast("binary"))
    told = stored.select(
        "day", "file_no", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.coalesce(F.col(at.id_col).cast("string"), F.lit("")).alias("id"), cents.alias("cents"), crc.alias("crc"),
    )

    @tidy
    def digest(batches):
        from pyarrow import fs, parquet

        key, sums, sha = None, None, None

        def done():
            store, place = fs.FileSystem.from_uri(key[2])
            columns = ",".join(parquet.read_schema(place, filesystem=store).names)
            return pa.RecordBatch.from_pylist([dict(zip(FILES.names, (*key, *sums, sha.hexdigest(), columns)))], schema=FILES)

        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path")
            turns = np.flatnonzero(pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                own = tuple(part.column(c)[0].as_py() for c in ("day", "file_no", "path"))
                if own != key:
                    if key is not None:
                        yield done()
                    key, sums, sha = own, [0, 0, 0], hashlib.sha256()
                elif sums[0]:
                    sha.update(b",")
                sha.update(",".join(part.column("id").to_pylist()).encode())
                sums = [sums[0] + b - a, sums[1] + pc.sum(part.column("cents")).as_py(), sums[2] + pc.sum(part.column("crc")).as_py()]
        if key is not None:
            yield done()

    dealt = told.repartition("path").sortWithinPartitions("path", "row")
    return dealt.mapInArrow(digest, "day long, file_no long, path string, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string")


FILES = pa.schema([("day", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string()), ("columns", pa.string())])
