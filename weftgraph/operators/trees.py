"""Computation trees, token sequences and row trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import hashed
from .order import numbered_within


def topology(spark: SparkSession, depth: int, fanout: int) -> DataFrame:
    """``pos, parent_pos, depth`` of the full tree; the root is 0 and has no parent."""
    out, first = None, 0
    for h in range(depth + 1):
        rows = spark.range(first, first + fanout**h).select(F.col("id").alias("pos"), (F.expr(f"(id - 1) div {fanout}") if h else F.lit(None)).cast("long").alias("parent_pos"), F.lit(h).cast("long").alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        first += fanout**h
    return out


def sample_trees(edges: DataFrame, roots: DataFrame, depth: int, fanout: int, seed: int) -> DataFrame:
    """``root, pos, parent_pos, node_id``: up to ``fanout`` in-neighbours of each slot's node without
    replacement; empty slots have a null node. A node's neighbours are ranked once by a hash; a slot takes
    neighbours in that order from a hashed place on, around the end. So each level is a join of
    ``fanout`` rows for each slot on (node, rank), however many neighbours a hub has."""
    near = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("nbr")).distinct()
    here = W.partitionBy("node_id")
    ranked = near.select("node_id", "nbr", (F.row_number().over(here.orderBy(hashed(seed, "node_id", "nbr"), "nbr")) - 1).cast("long").alias("k"))
    size = near.groupBy("node_id").agg(F.count("*").alias("n"))
    level = roots.select(F.col("node_id").alias("root"), F.lit(0).cast("long").alias("pos"), "node_id")
    found = level
    for _ in range(depth):
        start = F.conv(F.substring(hashed(seed, "root", "pos"), 1, 8), 16, 10).cast("long")
        picks = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(fanout)) - 1))
        slots = level.join(size, "node_id").select("root", "pos", "node_id", "n", start.alias("s"), picks.alias("j"))
        slots = slots.select("root", "node_id", (F.col("pos") * fanout + F.col("j") + 1).alias("pos"), ((F.col("s") + F.col("j")) % F.col("n")).alias("k"))
        level = slots.join(ranked, ["node_id", "k"]).select("root", "pos", F.col("nbr").alias("node_id"))
        found = found.unionByName(level)
    slots = (fanout ** (depth + 1) - 1) // (fanout - 1) if fanout > 1 else depth + 1
    grid = roots.select(F.col("node_id").alias("root"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("pos"))
    return grid.join(found, ["root", "pos"], "left").select("root", "pos", F.when(F.col("pos") > 0, F.expr(f"(pos - 1) div {fanout}")).alias("parent_pos"), "node_id")


def tokens(trees: DataFrame, clusters: DataFrame, empty: int, start: int) -> DataFrame:
    """``root, tokens``: the start token and each slot's cluster, ``empty`` for empty slots."""
    named = trees.join(clusters, "node_id", "left").withColumn("t", F.coalesce(F.col("cid").cast("long"), F.lit(empty).cast("long")))
    return named.groupBy("root").agg(F.concat(F.array(F.lit(start).cast("long")), F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"])).alias("tokens"))


def paths(sequences: DataFrame, depth: int, fanout: int) -> DataFrame:
    """``root, leaf, query, predict``: for each leaf the tokens from the start to it, and the same shifted by one."""
    first = sum(fanout**h for h in range(depth))
    chains = []
    for leaf in range(first, first + fanout**depth):
        chain, pos = [], leaf
        while pos:
            chain.append(pos)
            pos = (pos - 1) // fanout
        chains.append(F.struct(F.lit(leaf).cast("long").alias("leaf"), F.array(*[F.lit(p) for p in [0, 1, *[p + 1 for p in reversed(chain)]]]).alias("at")))
    rows = sequences.select("root", "tokens", F.explode(F.array(*chains)).alias("c"))
    full = F.transform("c.at", lambda p: F.element_at(F.col("tokens"), p + 1))
    return rows.select("root", F.col("c.leaf").alias("leaf"), full.alias("path")).select("root", "leaf", "path", F.slice("path", 1, depth + 1).alias("query"), F.slice("path", 2, depth + 1).alias("predict"))


def tree_features(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """Slots with features, zeros for empty ones."""
    dims = nodes.select(F.size("feature").alias("n")).limit(1).first()
    return trees.join(nodes.select("node_id", "feature"), "node_id", "left").withColumn("feature", F.coalesce("feature", F.array_repeat(F.lit(0.0).cast("float"), dims.n if dims else 0)))


def root_mean(trees: DataFrame, nodes: DataFrame, ignore_empty: bool = False) -> DataFrame:
    """``root, dim, v``: the mean over a root and its children, empty slots as zeros unless left out."""
    slots = trees.where("pos = 0 or parent_pos = 0")
    if ignore_empty:
        slots = slots.where("node_id is not null")
    rows = tree_features(slots, nodes).select("root", F.posexplode("feature").alias("dim", "v"))
    return rows.groupBy("root", F.col("dim").cast("long").alias("dim")).agg(F.avg(F.col("v").cast("double")).alias("v"))


def row_decisions(entries: DataFrame) -> DataFrame:
    """``row_id, depth, lo, hi, has_left, has_right`` of ``row_id, col_id`` (col below row): each row's
    columns [0, row) are halved until one is left; which halves hold an entry. One pass: an entry lists
    the ranges it falls in, and the ranges are grouped."""
    walk = """aggregate(sequence(0, cast(ceil(log2(greatest(row_id, 1L))) as int)), named_struct('lo', 0L, 'hi', row_id, 's', cast(array() as array<struct<depth:bigint,lo:bigint,hi:bigint,l:int>>)),
      (a, d) -> if(a.hi - a.lo <= 1, a, named_struct('lo', if(col_id < (a.lo + a.hi) div 2, a.lo, (a.lo + a.hi) div 2), 'hi', if(col_id < (a.lo + a.hi) div 2, (a.lo + a.hi) div 2, a.hi),
        's', concat(a.s, array(named_struct('depth', cast(d as bigint), 'lo', a.lo, 'hi', a.hi, 'l', if(col_id < (a.lo + a.hi) div 2, 1, 0))))))).s"""
    steps = entries.select("row_id", F.explode(F.expr(walk)).alias("s")).select("row_id", "s.*")
    return steps.groupBy("row_id", "depth", "lo", "hi").agg(F.max("l").alias("has_left"), F.max(1 - F.col("l")).alias("has_right"))


def row_children(decisions: DataFrame) -> DataFrame:
    """``depth, k, row_id, lo, hi, side``: the halves that hold entries of ``row_decisions``, numbered from 0 in
    each depth, by row and then left before right."""
    mid = F.expr("(lo + hi) div 2")
    halves = F.filter(F.array(F.when(F.col("has_left") == 1, F.struct(F.lit(0).alias("side"), F.col("lo").alias("a"), mid.alias("b"))), F.when(F.col("has_right") == 1, F.struct(F.lit(1).alias("side"), mid.alias("a"), F.col("hi").alias("b")))), lambda x: x.isNotNull())
    rows = decisions.select("depth", "row_id", F.explode(halves).alias("h")).select("depth", "row_id", F.col("h.a").alias("lo"), F.col("h.b").alias("hi"), F.col("h.side").alias("side"))
    ranked = numbered_within(rows, "depth", "row_id", "lo")
    return ranked.select("depth", (F.col("r") - 1).alias("k"), "row_id", "lo", "hi", "side")


def cnf_clauses(literals: DataFrame, n_var: int) -> DataFrame:
    """``clause_id, clause``: the literals of ``clause_id, literal_id`` as signed numbers and a closing 0;
    ids below ``n_var`` are positive. Clauses without literals do not occur."""
    signed = F.when(F.col("literal_id") < n_var, F.col("literal_id") + 1).otherwise(-(F.col("literal_id") - n_var + 1))
    rows = literals.distinct().groupBy("clause_id").agg(F.array_sort(F.collect_list(F.struct(F.col("literal_id").alias("k"), signed.cast("string").alias("s")))).alias("l"))
    return rows.select("clause_id", F.concat(F.array_join(F.transform("l", lambda x: x["s"]), " "), F.lit(" 0")).alias("clause"))


def fenwick_parts(rows: DataFrame) -> DataFrame:
    """``row_id, part_lo, part_hi``: the binary blocks that make up the rows before each row."""
    bits = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("b")).where("shiftright(row_id, b) % 2 = 1")
    return bits.select("row_id", F.expr("shiftleft(shiftright(row_id, b + 1), b + 1)").alias("part_lo"), F.expr("shiftleft(shiftright(row_id, b + 1), b + 1) + shiftleft(1L, b)").alias("part_hi"))
