"""Outlier detectors: isolation forest and local outlier factor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .training import _matrix


def unsuccessful(n: np.ndarray | float):
    """Mean depth at which a random binary search tree of ``n`` keys does not find one."""
    n = np.asarray(n, float)
    wide = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(wide - 1) + np.euler_gamma) - 2 * (wide - 1) / wide, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """A random tree over the rows of ``x``, as arrays: component (-1 at a leaf), border, left and right node, and the depth a row ends
    at with what a leaf's rows would still need."""
    axis, border, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, at: int) -> int:
        own = len(axis)
        for store in (axis, border, left, right, depth):
            store.append(-1)
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
        if at >= limit or len(rows) < 2 or not len(spread):
            depth[own] = at + float(unsuccessful(len(rows)))
            return own
        k = int(rng.choice(spread))
        cut = rng.uniform(rows[:, k].min(), rows[:, k].max())
        axis[own], border[own] = k, cut
        left[own], right[own] = node(rows[rows[:, k] < cut], at + 1), node(rows[rows[:, k] >= cut], at + 1)
        return own

    node(x, 0)
    return tuple(np.array(a) for a in (axis, np.array(border, float), left, right, np.array(depth, float)))


def isolation_scores(nodes: DataFrame, trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """``node_id, p``: 2^(-mean depth over what is usual), nearer 1 for rows that random cuts isolate early. Each tree is grown from
    ``sample`` rows, those of the smallest hashes of (tree, id): ``trees * sample`` rows at most reach the driver, and the trees, which
    these bound, all tasks. Rows are then scored where they are."""
    rows = nodes.select("node_id", F.col("feature").cast("array<double>").alias("feature"))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(trees * sample).select("feature").collect()
    x, rng = np.array([r.feature for r in picked]), np.random.default_rng(seed)
    if not len(x):
        return nodes.select("node_id", F.lit(0.0).alias("p")).limit(0)
    size = min(sample, len(x))
    forest = [grow(x[rng.choice(len(x), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]
    usual = max(float(unsuccessful(size)), 1e-12)
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, total = _matrix(batch.column("feature")), np.zeros(batch.num_rows)
            every = np.arange(len(v))
            for axis, border, left, right, depth in shared.value:
                at = np.zeros(len(v), np.int64)
                while (inner := axis[at] >= 0).any():
                    below = v[every, np.maximum(axis[at], 0)] < border[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                total += depth[at]
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(2.0 ** (-total / len(shared.value) / usual))], ["node_id", "p"])

    return rows.mapInArrow(score, "node_id long, p double")


def local_outlier_factor(neighbours: DataFrame) -> DataFrame:
    """``node_id, p`` of each node's ``k`` nearest ``dst, src, rnk, d`` (squared distances): how much sparser a node's surroundings are than
    those of its neighbours. A neighbour counts as far as its own k-th neighbour at least; where all lie at one point the factor is 1."""
    near = materialize(neighbours.select("dst", "src", F.sqrt(F.greatest("d", F.lit(0.0))).alias("d")), "near")
    reach = near.groupBy(F.col("dst").alias("src")).agg(F.max("d").alias("kd"))
    mean = near.join(reach, "src").groupBy("dst").agg(F.avg(F.greatest("d", "kd")).alias("m"))
    density = materialize(mean.select(F.col("dst").alias("node_id"), (1 / F.greatest("m", F.lit(1e-10))).alias("l")), "density")
    around = near.join(density.select(F.col("node_id").alias("src"), "l"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.avg("l").alias("a"))
    return around.join(density, "node_id").select("node_id", (F.col("a") / F.col("l")).alias("p"))
