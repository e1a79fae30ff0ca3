"""Feature builders of graph predictors: what a network of each kind computes from neighbours before its
trained head. Heads are trained apart (``predictors``), so that propagation is a plan over all edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import materialize
from . import propagate as P
from .edges import degrees, reset_loops, symmetrize
from .neighbors import knn, top_share


def joined(nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    """``nodes`` with its feature followed by that of each part; zeros where a part lacks the node. Parts are
    written first, as each is read for its width too."""
    parts = tuple(materialize(part.select("node_id", "feature"), "part") for part in parts)
    out = nodes.withColumn("feature", F.col("feature").cast("array<double>"))
    for k, part in enumerate(parts):
        out = out.join(part.select("node_id", F.col("feature").cast("array<double>").alias(f"__f{k}"), F.size("feature").alias(f"__n{k}")), "node_id", "left")
    widths = [part.select(F.size("feature")).first() for part in parts]
    both = [F.coalesce(F.col(f"__f{k}"), F.array_repeat(F.lit(0.0), w[0] if w else 0)) for k, w in enumerate(widths)]
    return out.withColumn("feature", F.concat("feature", *both)).drop(*[c for k in range(len(parts)) for c in (f"__f{k}", f"__n{k}")])


def activated(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("feature", F.transform("feature", lambda x: V.relu(x.cast("double"))))


def gcn(edges: DataFrame, nodes: DataFrame, hops: int = 2) -> DataFrame:
    """Symmetrically normalised sums over edges with one loop at each node, ``hops`` times."""
    weights, now = P.normalized_edges(reset_loops(edges, nodes)), nodes.select("node_id", "feature")
    for _ in range(hops):
        now = materialize(P.smoothed(weights, now), "smoothed")
    return nodes.drop("feature").join(now, "node_id")


def gin(edges: DataFrame, nodes: DataFrame, hops: int = 2, eps: float = 0.0, how: str = "mean") -> DataFrame:
    """(1 + eps) x plus the neighbours' aggregate, ``hops`` times; nodes without neighbours keep (1 + eps) x."""
    now = nodes.select("node_id", F.col("feature").cast("array<double>").alias("feature"))
    for _ in range(hops):
        near = P.aggregated(edges, now, how, name="__a")
        scaled = F.transform("feature", lambda x: x * (1 + eps))
        now = now.join(near, "node_id", "left").select("node_id", F.when(F.col("__a").isNull(), scaled).otherwise(V.added(scaled, "__a")).alias("feature"))
    return nodes.drop("feature").join(now, "node_id")


def sage(edges: DataFrame, nodes: DataFrame, how: str = "mean") -> DataFrame:
    """x beside the neighbours' aggregate; ``how`` may be "pool", the greatest relu(x)."""
    near = P.aggregated(edges, activated(nodes), "max") if how == "pool" else P.aggregated(edges, nodes, how)
    return joined(nodes, near)


def pna(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """x beside mean, max, min and std of the neighbours, each as it is and scaled by log(degree + 1) over its mean."""
    deg = degrees(edges, nodes).select("node_id", F.log1p(F.col("in_deg").cast("double")).alias("__l"))
    mean = deg.where("__l > 0").agg(F.avg("__l")).first()[0] or 1.0
    four = P.principal_arrays(edges, nodes).join(deg, "node_id").select("node_id", F.concat("mean", "max", "min", "std").alias("a"), (F.col("__l") / mean).alias("s"))
    return joined(nodes, four.select("node_id", F.concat("a", F.transform("a", lambda x: x * F.col("s"))).alias("feature")))


def bernstein_bank(edges: DataFrame, nodes: DataFrame, degree: int = 2) -> DataFrame:
    """The band-pass filters of a Bernstein basis of the Laplacian, side by side."""
    w, power, powers = P.normalized_edges(edges), nodes.select("node_id", "feature"), []
    for k in range(degree + 1):
        if k:
            power = materialize(P.laplacian(w, power), "power")
        powers.append(power)
    return joined(nodes, *[P.combined([(t, p) for t, p in zip(theta, powers) if t] or [(0.0, powers[0])]) for theta in V.bernstein_theta(degree)])


def chebyshev_bank(edges: DataFrame, nodes: DataFrame, order: int = 2) -> DataFrame:
    return joined(nodes, *P.chebyshev(edges, nodes, order)[1:])


def two_filters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A low and a high pass, (I + S) x and (I - S) x, side by side."""
    s = materialize(P.smoothed(P.normalized_edges(edges), nodes), "smoothed")
    x = nodes.select("node_id", "feature")
    return joined(nodes, P.combined([(1.0, x), (1.0, s)]), P.combined([(1.0, x), (-1.0, s)]))


def gat(edges: DataFrame, nodes: DataFrame, separate: bool = True) -> DataFrame:
    """Attention over neighbours, beside the node's own vector or added to it."""
    near = P.attention_arrays(edges, nodes)
    if separate:
        return joined(nodes, near)
    found = nodes.join(near.withColumnRenamed("feature", "__a"), "node_id", "left")
    return found.withColumn("feature", F.coalesce(V.added("feature", "__a"), F.col("feature").cast("array<double>"))).drop("__a")


def rgcn(typed: DataFrame, nodes: DataFrame, etypes: list[str]) -> DataFrame:
    """x beside the neighbours' mean of each edge type, in the order of ``etypes``."""
    per = P.relation_arrays(typed, nodes)
    return joined(nodes, *[per.where(F.col("etype") == e).select("node_id", F.col("mean").alias("feature")) for e in etypes])


def hgt(typed: DataFrame, nodes: DataFrame, etypes: list[str]) -> DataFrame:
    """x beside attention over the neighbours of each edge type."""
    return joined(nodes, *[P.attention_arrays(typed.where(F.col("etype") == e).select("src", "dst"), nodes) for e in etypes])


def with_nearest(edges: DataFrame, nodes: DataFrame, k: int, queries: DataFrame | None = None, distance: str = "cosine") -> DataFrame:
    """The multigraph of ``edges`` and each query node's ``k`` nearest nodes; repeats are kept."""
    near = knn(nodes if queries is None else queries, nodes, k, distance)
    return materialize(edges.select("src", "dst").unionByName(near.select("src", "dst")), "multigraph")


def nearest_gcn(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """``gcn`` on the graph beside ``gcn`` on its nearest-neighbour graph."""
    near = materialize(knn(nodes, nodes, k).select("src", "dst"), "near")
    return joined(gcn(edges, nodes), gcn(symmetrize(near), nodes).select("node_id", "feature"))


def signed_attention(edges: DataFrame, nodes: DataFrame, agree: DataFrame) -> DataFrame:
    """x beside attention in which edges that ``agree(src, dst, sign)`` marks -1 count against."""
    return joined(nodes, P.attention_arrays(edges.join(agree, ["src", "dst"]), nodes, "sign"))


def outlier_scores(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Three outlier scores as a feature: distance to the farthest and mean of the nearest neighbours
    (``dst, rnk, d``), and the squared length of the standardised vector."""
    near = neighbours.groupBy(F.col("dst").alias("node_id")).agg(F.max("d").alias("far"), F.avg("d").alias("mean"))
    rows = P.long_form(nodes)
    s = F.broadcast(rows.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")))
    size = rows.join(s, "dim").groupBy("node_id").agg(F.sum(F.pow((F.col("v") - F.col("m")) / F.greatest("sd", F.lit(1e-8)), 2)).alias("z"))
    return near.join(size, "node_id").select("node_id", F.array("far", "mean", "z").alias("feature"))


def overwritten(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """Nodes with the features of ``made(node_id, feature)`` where it has them. Raises if widths differ or a made node does not exist."""
    wide = nodes.select(F.size("feature")).first()[0]
    if made.where(F.size("feature") != wide).limit(1).count():
        raise ValueError(f"made features must have {wide} components")
    if made.join(nodes, "node_id", "left_anti").limit(1).count():
        raise ValueError("made features for unknown nodes")
    new = made.select("node_id", F.col("feature").cast("array<double>").alias("__m"))
    return nodes.join(new, "node_id", "left").withColumn("feature", F.coalesce("__m", F.col("feature").cast("array<double>"))).drop("__m")


def root_features(sequences: DataFrame, centres: DataFrame) -> DataFrame:
    """``node_id, feature``: the centre of each generated tree's root token (behind the start token)."""
    return sequences.select(F.col("root").alias("node_id"), F.element_at("tokens", 2).alias("cid")).join(centres, "cid").select("node_id", "feature")


def sequence_features(sequences: DataFrame, centres: DataFrame) -> DataFrame:
    """``node_id, feature``: the root's centre beside the mean centre of all other slots, empty ones as zeros."""
    slots = sequences.select(F.col("root").alias("node_id"), F.posexplode(F.slice("tokens", 2, 1 << 30)).alias("pos", "cid")).join(centres, "cid", "left")
    wide = centres.select(F.size("feature")).first()[0]
    full = slots.select("node_id", "pos", F.coalesce(F.col("feature").cast("array<double>"), F.array_repeat(F.lit(0.0), wide)).alias("feature"))
    rest = P._stats(full.where("pos > 0").select("node_id", P.as_vector("feature").alias("__f")), ["mean"], "node_id")
    root = full.where("pos = 0").select("node_id", "feature")
    return root.join(rest, "node_id").select("node_id", F.concat("feature", "mean").alias("feature"))


def tree_features(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same of sampled trees ``root, pos, node_id`` with the nodes' own features."""
    wide = nodes.select(F.size("feature")).first()[0]
    slots = trees.join(nodes.select("node_id", F.col("feature").cast("array<double>").alias("feature")), "node_id", "left")
    full = slots.select(F.col("root").alias("node_id"), "pos", F.coalesce("feature", F.array_repeat(F.lit(0.0), wide)).alias("feature"))
    rest = P._stats(full.where("pos > 0").select("node_id", P.as_vector("feature").alias("__f")), ["mean"], "node_id")
    return full.where("pos = 0").select("node_id", "feature").join(rest, "node_id").select("node_id", F.concat("feature", "mean").alias("feature"))


def alike_edges(edges: DataFrame, nodes: DataFrame, share: tuple[int, int] = (1, 2)) -> DataFrame:
    return top_share(edges, nodes, share)
