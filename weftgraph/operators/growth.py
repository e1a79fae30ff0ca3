"""A generator of adjacency rows in which each row knows what earlier rows drew.

Rows are drawn in rounds: a round's rows, from a start up to ``growth`` times as many, are independent of each other and know all
rows before the start. What they know of a range of columns is the number of edge ends that lie in it, taken from running sums at
its borders; which halves of a range get entries depends on its size and on how full each half is. Then each entry that a
row drew brings some of its column's neighbours along, so that triangles close. Rounds grow as the logarithm of the rows; state
lies in written tables.

Ranges meet the state in tiles: some rows and the packed ends of two neighbouring blocks of columns. A range that fits a block is
sent there once and halved down to single columns; only wider ones are halved by joins, a level after the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import hashed
from ..storage import discard, materialize
from .generators import uniform, uniform_of
from .order import running_sums
from .structure import both_ways, triangles
from .trees import row_decisions

#: Observations that a size's mean counts for beside a fullness's own.
PRIOR = 5.0
#: Levels of halving by joins between written tables.
LEVELS = 3
#: Columns of a block; entries of a tile on average, about; ranges that are walked at once; parts of a block whose ends are packed together.
WIDTH, TILE, AT_ONCE, PARTS = 1 << 20, 1 << 20, 1 << 12, 128


def starts_until(last: int, growth: float) -> list[int]:
    """The first rows of the rounds that reach ``last``."""
    out = [1]
    while int(out[-1] * growth) <= last:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return [s for s in out if s <= last]


def _start(row: str, starts: list[int]) -> Column:
    return F.element_at(F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= F.col(row)), -1)


def _filled(amount: Column, size: Column) -> Column:
    """How full a range is: the logarithm of the ends for each column, in whole steps."""
    return F.floor(F.log2(1 + F.greatest(amount, F.lit(0)) / size)).cast("int")


def _size_class(lo: Column, hi: Column) -> Column:
    return F.floor(F.log2(hi - lo)).cast("int")


def degrees_before(entries: DataFrame, starts: list[int]) -> DataFrame:
    """``s, c, deg``: for each start the edges that rows before it gave a column, where there are any. They are counted for each round
    of rows first and then added up, so an end is not sent for each start."""
    every = F.array(*[F.lit(s).cast("long") for s in starts])
    seen = entries.select(F.size(F.filter(every, lambda s: s <= F.col("row_id"))).alias("k"), F.explode(F.array("row_id", "col_id")).alias("c"))
    counted = seen.where(F.col("k") < len(starts)).groupBy("k", "c").agg(F.count("*").alias("n"))
    later = counted.select("c", "n", F.explode(F.slice(every, F.col("k") + 1, F.lit(len(starts)))).alias("s"))
    return later.groupBy("s", "c").agg(F.sum("n").alias("deg"))


def known_before(entries: DataFrame, starts: list[int]) -> DataFrame:
    """``s, c, deg, before``: for each start and column up to it, the edges that rows before the start gave the column, and those of
    columns before it. Sums run on over starts, so only differences within one start mean anything. The grid has
    growth / (growth - 1) times as many rows as the last start."""
    spark = entries.sparkSession
    grid = spark.createDataFrame([(s,) for s in starts], "s long").select("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s"))).alias("c"))
    rows = grid.join(degrees_before(entries, starts), ["s", "c"], "left").select("s", "c", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))
    summed = running_sums(rows, ["s", "c"], upto=F.col("deg"))
    return summed.select("s", "c", "deg", (F.col("upto") - F.col("deg")).alias("before"))


def _in_tiles(rows: DataFrame, deg: DataFrame, tiles: dict[int, int], kernel: Callable[[pa.Table, np.ndarray, int], pa.Table], schema: str) -> DataFrame:
    """What ``kernel(rows, ends, base)`` says of ``rows(s, row_id, at, ..)`` in each tile. ``ends`` are those of the columns from ``base`` on
    that rows before ``s`` gave, for the block of ``at`` and the next one. ``tiles`` are the shares of rows for each start."""
    width, part = WIDTH, max(1, WIDTH // PARTS)
    shares = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in tiles.items() for x in pair]), F.col("s"))

    def pack(table: pa.Table) -> pa.Table:
        s, k = (table.column(c)[0].as_py() for c in ("s", "part"))
        ends = np.zeros(part, np.int64)
        ends[table.column("c").to_numpy() - k * part] = table.column("deg").to_numpy()
        return pa.table({"s": [s], "part": [k], "ends": pa.array([zlib.compress(ends.tobytes(), 1)], pa.binary())})

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kernel(left, np.zeros(0, np.int64), 0)
        base = left.column("j")[0].as_py() * width
        ends = np.zeros(2 * width, np.int64)
        for k, packed in zip(right.column("part").to_pylist(), right.column("ends").to_pylist()):
            ends[k * part - base : (k + 1) * part - base] = np.frombuffer(zlib.decompress(packed), np.int64)
        return kernel(left, ends, base)

    left = rows.withColumn("i", F.pmod(F.xxhash64("row_id"), shares)).withColumn("j", F.expr(f"at div {width}"))
    packed = deg.select("s", F.expr(f"c div {part}").alias("part"), "c", "deg").groupBy("s", "part").applyInArrow(pack, "s long, part long, ends binary")
    own = F.expr(f"part * {part} div {width}")
    right = packed.select("s", "part", "ends", F.explode(F.array(own, own - 1)).alias("j")).where("j >= 0")
    right = right.select("s", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("i"), "j", "part", "ends")
    return left.groupBy("s", "i", "j").cogroup(right.groupBy("s", "i", "j")).applyInArrow(tile, schema)


def _shares(counts: dict[int, float], starts: list[int]) -> dict[int, int]:
    return {s: max(1, int(np.ceil(counts.get(s, 0) / TILE))) for s in starts}


def _log2(x: np.ndarray) -> np.ndarray:
    """The whole part of the logarithm, of numbers from 1 on."""
    return np.frexp(x.astype(float))[1].astype(np.int64) - 1


def _fullness(amount: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """``_filled`` in a tile."""
    return _log2(1 + amount / size)


def _first_fitting(row: str, column: str, last: int) -> Column:
    """Where the first range begins, among those that halving leads to ``column`` through, that fits a block."""
    if last <= WIDTH:
        return F.lit(0).cast("long")
    mid = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    cut = lambda a, _: F.when(a["hi"] - a["lo"] <= WIDTH, a).when(F.col(column) < mid(a), part(a["lo"], mid(a))).otherwise(part(mid(a), a["hi"]))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_wide_levels(last))), part(F.lit(0).cast("long"), F.col(row)), cut)["lo"]


def _wide_levels(size: int) -> int:
    """Halvings after which a range of ``size`` columns fits a block."""
    levels = 0
    while size > WIDTH:
        size, levels = (size + 1) // 2, levels + 1
    return levels


#: What a tile says of a source's entries; kinds: halvings by size and fullness, drawn entries by their column's edges, brought ones.
CELLS = "kind int, size_class int, left int, right int, n long, l long, b long"


def _cells(rows: pa.Table, ends: np.ndarray, base: int, width: int) -> pa.Table:
    row, col, kind = (rows.column(c).to_numpy() for c in ("row_id", "col", "kind"))
    out = []

    def told(of: int, code: np.ndarray, *sums: np.ndarray) -> None:
        n = np.bincount(code)
        met = np.flatnonzero(n)
        found = [np.bincount(code, x, len(n)).astype(np.int64)[met] for x in sums] or [np.zeros(len(met), np.int64)] * 2
        out.append([np.full(len(met), of), met >> 12, met >> 6 & 63, met & 63, n[met], *found])

    for of in (1, 2):
        told(of, _fullness(ends[col[kind == of - 1] - base], 1) << 6)
    order = np.flatnonzero(kind == 0)
    order = order[np.lexsort((col[order], row[order]))]
    row, col = row[order], col[order]
    before = np.append(0, np.cumsum(ends))
    lo, hi = np.zeros(len(row), np.int64), row.copy()
    while True:
        wide = hi - lo > 1
        row, col, lo, hi = row[wide], col[wide], lo[wide], hi[wide]
        if not len(row):
            break
        mid = (lo + hi) // 2
        left = col < mid
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lo[1:] != lo[:-1])))
        has_left, has_right = np.logical_or.reduceat(left, first), np.logical_or.reduceat(~left, first)
        fits = (hi - lo)[first] <= width
        a, m, b = (x[first[fits]] - base for x in (lo, mid, hi))
        code = (_log2(b - a) << 6 | _fullness(before[m] - before[a], m - a)) << 6 | _fullness(before[b] - before[m], b - m)
        told(0, code, has_left[fits], (has_left & has_right)[fits])
        lo, hi = np.where(left, lo, mid), np.where(left, mid, hi)
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.table({name: pa.array(x, pa.int32() if k < 4 else pa.int64()) for k, (name, x) in enumerate(zip(("kind", "size_class", "left", "right", "n", "l", "b"), columns))})


def _walked(rows: pa.Table, ends: np.ndarray, base: int, chances: np.ndarray, seed: int) -> pa.Table:
    """``row_id, col_id, deg``: ranges halved down to single columns."""
    before, top, out = np.append(0, np.cumsum(ends)), chances.shape[2] - 1, [np.zeros((0, 3), np.int64)]
    row_id, start, end, depth = (rows.column(c).to_numpy() for c in ("row_id", "lo", "hi", "depth"))
    pieces = [(int(d), at[k : k + AT_ONCE]) for d in np.unique(depth) for at in [np.flatnonzero(depth == d)] for k in range(0, len(at), AT_ONCE)]
    for level, at in pieces:
        row, lo, hi = row_id[at], start[at], end[at]
        while len(row):
            single = hi - lo <= 1
            out.append(np.column_stack([row[single], lo[single], ends[lo[single] - base]]))
            row, lo, hi = row[~single], lo[~single], hi[~single]
            mid = (lo + hi) // 2
            left, right = (np.minimum(_fullness(before[y - base] - before[x - base], y - x), top) for x, y in ((lo, mid), (mid, hi)))
            p_left, p_right = chances[:, _log2(hi - lo), left, right]
            go_left = uniform_of(seed + 10 * level, row, lo, hi) < p_left
            go_right = (uniform_of(seed + 10 * level + 1, row, lo, hi) < p_right) | ~go_left
            row, lo, hi = (np.append(x[go_left], y[go_right]) for x, y in ((row, row), (lo, mid), (mid, hi)))
            level += 1
    found = np.concatenate(out)
    return pa.table({c: found[:, k] for k, c in enumerate(("row_id", "col_id", "deg"))})


def _at(rows: DataFrame, known: DataFrame, column: Column, name: str) -> DataFrame:
    """``rows`` with the sum before ``column`` in their own start's state; beyond the start nothing is known."""
    look = known.select("s", F.col("c").alias("__c"), F.col("before").alias(name))
    return rows.withColumn("__c", F.least(column, F.col("s"))).join(look, ["s", "__c"]).drop("__c")


class RowModel:
    """What ``fit`` learned from one graph's rows: ``halves(size_class, left, right, p_left, p_right)``, ``sizes(size_class, ...)`` for
    states not met, and ``closing(filled, mean)``, the entries that an entry brings along by its column's edges. Rows are taken to have about
    ``per_row`` entries when they are dealt over tiles."""

    def __init__(self, halves: DataFrame, sizes: DataFrame, closing: DataFrame, per_row: float = 1.0):
        self.halves, self.sizes, self.closing, self.per_row = halves, sizes, closing, per_row

    @classmethod
    def fit(cls, entries: DataFrame, growth: float = 1.5) -> "RowModel":
        """From ``row_id, col_id`` (column below row, once each). An entry closes a triangle if a lower column of its row is linked
        to its column; the others are drawn by halving."""
        own = None
        if not hasattr(entries, "written_to"):
            own = entries = materialize(entries.select("row_id", "col_id"), "entries")
        last = entries.agg(F.max("row_id")).first()[0] or 1
        starts = starts_until(last, growth)
        rounds = entries.groupBy(_start("row_id", starts).alias("s")).agg(F.count("*").alias("n"), F.approx_count_distinct("row_id").alias("rows")).collect()  # a row for each round
        corners = triangles(entries.select(F.col("col_id").alias("u"), F.col("row_id").alias("v")))
        sides = corners.select(F.array_sort(F.array("p", "q", "r")).alias("t"))
        brought = sides.groupBy(F.col("t")[2].alias("row_id"), F.col("t")[1].alias("col_id")).agg(F.min(F.col("t")[0]).alias("by"))
        brought = materialize(brought, "brought")

        placed = entries.join(brought, ["row_id", "col_id"], "left").select(_start("row_id", starts).alias("s"), "row_id", F.coalesce("by", "col_id").alias("col"), F.col("by").isNotNull().cast("int").alias("kind"))
        placed = placed.withColumn("at", F.when(F.col("kind") == 1, F.col("col")).otherwise(_first_fitting("row_id", "col", last)))
        width = WIDTH
        told = _in_tiles(placed, degrees_before(entries, starts), _shares({r.s: r.n for r in rounds}, starts), lambda rows, ends, base: _cells(rows, ends, base, width), CELLS)
        known = None
        if last > WIDTH:
            known = materialize(known_before(entries, starts), "known")
            told = told.unionByName(cls._wide_cells(entries.join(brought, ["row_id", "col_id"], "left_anti"), known, starts))
        cells = materialize(told.groupBy("kind", "size_class", "left", "right").agg(*[F.sum(c).alias(c) for c in "nlb"]), "cells")

        counts = lambda *keys: cells.where("kind = 0").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in "nlb"])
        sizes = counts("size_class").select("size_class", (F.col("l") / F.col("n")).alias("size_left"), ((F.col("b") + 0.5) / (F.col("l") + 1)).alias("size_right"))
        halves = counts("size_class", "left", "right").join(sizes, "size_class")
        halves = halves.select("size_class", "left", "right", ((F.col("l") + PRIOR * F.col("size_left")) / (F.col("n") + PRIOR)).alias("p_left"), ((F.col("b") + PRIOR * F.col("size_right")) / (F.col("l") + PRIOR)).alias("p_right"))
        met = lambda kind, name: cells.where(F.col("kind") == kind).select(F.col("left").alias("filled"), F.col("n").alias(name))
        closing = met(1, "n").join(met(2, "m"), "filled", "left").select("filled", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("mean"))
        per_row = max([r.n / max(1, r.rows) for r in rounds], default=1.0)
        out = cls(materialize(halves, "halves"), materialize(sizes, "sizes"), materialize(closing, "closing"), per_row)
        discard(own, known, brought, cells)
        return out

    @staticmethod
    def _wide_cells(drawn: DataFrame, known: DataFrame, starts: list[int]) -> DataFrame:
        """The halvings of ranges that fit no block."""
        mid = F.expr("(lo + hi) div 2")
        steps = row_decisions(drawn).where(F.col("hi") - F.col("lo") > WIDTH).withColumn("s", _start("row_id", starts))
        for column, name in ((F.col("lo"), "a"), (mid, "b"), (F.col("hi"), "c")):
            steps = _at(steps, known, column, name)
        left, right = _filled(F.col("b") - F.col("a"), mid - F.col("lo")), _filled(F.col("c") - F.col("b"), F.col("hi") - mid)
        both = F.col("has_left") * F.col("has_right")
        keys = [F.lit(0).alias("kind"), _size_class(F.col("lo"), F.col("hi")).alias("size_class"), left.alias("left"), right.alias("right")]
        return steps.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("has_left").alias("l"), F.sum(both).alias("b"))

    def _chances(self) -> np.ndarray:
        """The chances that the left and the right half get entries, by size, left and right fullness; the last fullness stands for states
        not met. The model has a row for each of these states."""
        halves, sizes = self.halves.collect(), self.sizes.collect()
        top = 1 + max([x for r in halves for x in (r.left, r.right)], default=-1)
        out = np.full((2, 64, top + 1, top + 1), 0.5)
        for r in sizes:
            out[:, r.size_class] = np.array([r.size_left, r.size_right])[:, None, None]
        for r in halves:
            out[:, r.size_class, r.left, r.right] = r.p_left, r.p_right
        return out

    def _halved(self, live: DataFrame, known: DataFrame, seed: int) -> DataFrame:
        """Ranges that fit no block cut into the halves that get entries; the sums at borders travel along."""
        mid = F.expr("(lo + hi) div 2")
        rows = _at(live, known, mid, "pm")
        left, right = _filled(F.col("pm") - F.col("pl"), F.greatest(mid - F.col("lo"), F.lit(1))), _filled(F.col("ph") - F.col("pm"), F.col("hi") - mid)
        rows = rows.withColumn("size_class", _size_class(F.col("lo"), F.col("hi"))).withColumn("left", left).withColumn("right", right)
        rows = rows.join(F.broadcast(self.halves), ["size_class", "left", "right"], "left").join(F.broadcast(self.sizes), "size_class", "left")
        go_left = uniform(seed, "row_id", "lo", "hi") < F.coalesce("p_left", "size_left", F.lit(0.5))
        go_right = (uniform(seed + 1, "row_id", "lo", "hi") < F.coalesce("p_right", "size_right", F.lit(0.5))) | ~go_left
        part = lambda a, b, pa, pb: F.struct(a.alias("lo"), b.alias("hi"), pa.alias("pl"), pb.alias("ph"))
        lo, hi, pl, pm, ph = (F.col(c) for c in ("lo", "hi", "pl", "pm", "ph"))
        cut = F.array(F.when(go_left, part(lo, mid, pl, pm)), F.when(go_right, part(mid, hi, pm, ph)))
        wide = hi - lo > WIDTH
        pieces = F.when(wide, F.filter(cut, lambda x: x.isNotNull())).otherwise(F.array(part(lo, hi, pl, ph)))
        return rows.select("row_id", "s", (F.col("depth") + wide.cast("int")).alias("depth"), F.explode(pieces).alias("h")).select("row_id", "s", "depth", "h.*")

    def _brought(self, drawn: DataFrame, done: DataFrame, seed: int) -> DataFrame:
        """Entries that drawn ones bring along: neighbours of the column among earlier rows, from a hashed place on."""
        near = both_ways(done.select(F.col("col_id").alias("u"), F.col("row_id").alias("v"))).select(F.col("a").alias("col_id"), F.col("b").alias("nbr"))
        near = near.repartition("col_id")  # else the hashes, wider than the ids, are sent along
        ranked = near.withColumn("k", (F.row_number().over(W.partitionBy("col_id").orderBy(hashed(seed, "col_id", "nbr"), "nbr")) - 1).cast("long"))
        share = F.col("mean") / (1 + F.col("mean"))
        u = F.greatest(uniform(seed + 2, "row_id", "col_id"), F.lit(1e-12))
        number = F.when(share > 0, F.least(F.floor(F.log(u) / F.log(share)), F.col("deg"))).otherwise(0).cast("long")
        rows = drawn.withColumn("filled", _filled(F.col("deg"), F.lit(1))).join(F.broadcast(self.closing), "filled").withColumn("number", number).where("number > 0")
        first = F.floor(uniform(seed + 3, "row_id", "col_id") * F.col("deg")).cast("long")
        picks = rows.select("row_id", "col_id", "deg", first.alias("f"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)).alias("j"))
        picks = picks.select("row_id", "col_id", ((F.col("f") + F.col("j")) % F.col("deg")).alias("k"))
        return picks.join(ranked, ["col_id", "k"]).select("row_id", F.col("nbr").alias("col_id"))

    def generate(self, rows: DataFrame, seed: int, growth: float = 1.5) -> DataFrame:
        """``row_id, col_id`` for ``rows(row_id)``, each row above 0 with one entry at least; ids that repeat count once. The same
        seed gives the same rows."""
        rows = materialize(rows.where("row_id > 0").select(F.col("row_id").cast("long")).distinct(), "rows")
        last = rows.agg(F.max("row_id")).first()[0]
        done = rows.sparkSession.createDataFrame([], "row_id long, col_id long")
        if last is None:
            return done
        starts = starts_until(last, growth)
        counts = {r.s: r.n for r in rows.groupBy(_start("row_id", starts).alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each round
        shares = _shares({s: n * self.per_row for s, n in counts.items()}, starts)
        chances, grown = self._chances(), False
        for s, end in zip(starts, [*starts[1:], last + 1]):
            if s not in counts:
                continue
            live = rows.where((F.col("row_id") >= s) & (F.col("row_id") < end)).select("row_id", F.lit(s).cast("long").alias("s"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("lo"), F.col("row_id").alias("hi"))
            known = before = None
            if end - 1 > WIDTH:
                known = materialize(known_before(done, [s]), "known")
                live = _at(_at(live, known, F.col("lo"), "pl"), known, F.col("hi"), "ph")
                for level in range(_wide_levels(end - 1)):
                    live = self._halved(live, known, seed + 10 * level)
                    if level % LEVELS == LEVELS - 1:
                        live = materialize(live, "live")
                        discard(before)
                        before = live
            live = live.select("s", "row_id", F.col("lo").alias("at"), "lo", "hi", "depth")
            drawn = _in_tiles(live, degrees_before(done, [s]), shares, lambda rows, ends, base: _walked(rows, ends, base, chances, seed), "row_id long, col_id long, deg long")
            drawn = materialize(drawn, "drawn")
            new = drawn.select("row_id", "col_id").unionByName(self._brought(drawn, done, seed)).distinct()
            new = materialize(new, "grown")
            discard(known, before, drawn)
            done, grown = done.unionByName(new) if grown else new, True
        return done
