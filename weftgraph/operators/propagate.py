"""Messages along edges: neighbour aggregation, spectral filters, attention.

Sums, means and attention meet in tiles of blocks of nodes (``tiles``): a vector is sent once for each block of targets. Other
aggregates send one vector for each edge; a task sends one buffer for each target that it met. What comes out is an array again.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..storage import materialize
from .tiles import PIECE, Tiles, sums_by, tiles_of


def long_form(vectors: DataFrame, column: str = "feature") -> DataFrame:
    """``node_id, dim, v`` of ``node_id, <array>``."""
    return vectors.select("node_id", F.posexplode(column).alias("dim", "v")).select("node_id", F.col("dim").cast("long").alias("dim"), F.col("v").cast("double").alias("v"))


def gathered(rows: DataFrame, name: str = "feature") -> DataFrame:
    """``node_id, <array>`` of ``node_id, dim, v``."""
    return rows.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias(name))


def as_vector(column: Column | str) -> Column:
    return array_to_vector((F.col(column) if isinstance(column, str) else column).cast("array<double>"))


def messages(edges: DataFrame, vectors: DataFrame, column: str = "feature", *keep: str) -> DataFrame:
    """``node_id (the target), <keep>, __f`` for each edge: the source's array as a vector, made once for each source."""
    sources = vectors.select(F.col("node_id").alias("src"), as_vector(column).alias("__f"))
    return edges.join(sources, "src").select(F.col("dst").alias("node_id"), *keep, "__f")


def stable_std(variance: Column, count: Column) -> Column:
    """sqrt(max(E[x^2] - E[x]^2, 0) + 1e-5) of each component, from the sample variance."""
    share = (count - 1).cast("double") / count
    return F.transform(vector_to_array(variance), lambda v: F.sqrt(F.greatest(v * share, F.lit(0.0)) + 1e-5))


def _stats(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """``<keys>, <name> ..``: arrays of the aggregates among mean, sum, min, max and std."""
    wanted = [("variance" if n == "std" else n) for n in names]
    found = rows.groupBy(*keys).agg(Summarizer.metrics(*dict.fromkeys([*wanted, "count"])).summary(F.col("__f")).alias("__s"))
    read = {n: stable_std(F.col("__s.variance"), F.col("__s.count")) if n == "std" else vector_to_array(F.col(f"__s.{n}")) for n in names}
    return found.select(*keys, *[c.alias(n) for n, c in read.items()])


def aggregated(edges: DataFrame, vectors: DataFrame, how: str = "mean", column: str = "feature", name: str = "feature") -> DataFrame:
    """``node_id, <name>``: an aggregate over the sources of each node's incoming edges. Sums and means are added up in tiles."""
    if how in ("mean", "sum"):
        counted = vectors.select("node_id", F.concat(F.col(column).cast("array<double>"), F.array(F.lit(1.0))).alias("feature"))
        found = tiles_of(edges, weighted=False).sums(counted).select("node_id", F.slice("feature", 1, F.size("feature") - 1).alias("s"), F.element_at("feature", -1).alias("n"))
        return found.select("node_id", (F.transform("s", lambda x: x / F.col("n")) if how == "mean" else F.col("s")).alias(name))
    return _stats(messages(edges, vectors, column), [how], "node_id").withColumnRenamed(how, name)


def neighbour(edges: DataFrame, vectors: DataFrame, how: str = "mean", column: str = "feature") -> DataFrame:
    """``aggregated`` as ``node_id, dim, v``."""
    return long_form(aggregated(edges, vectors, how, column))


def principal_arrays(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """``node_id, mean, max, min, std`` in one pass."""
    return _stats(messages(edges, vectors), ["mean", "max", "min", "std"], "node_id")


def principal(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """``principal_arrays`` as ``node_id, agg, dim, v``."""
    found = principal_arrays(edges, vectors).select("node_id", F.posexplode(F.arrays_zip("mean", "max", "min", "std")).alias("dim", "z")).select("node_id", F.col("dim").cast("long").alias("dim"), "z.*")
    return found.select("node_id", "dim", F.expr("stack(4, 'mean', mean, 'max', max, 'min', min, 'std', std) as (agg, v)"))


def normalized_edges(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` with w = 1 / sqrt(in-degree of src * in-degree of dst), degrees 1 at least."""
    deg = edges.groupBy("dst").agg(F.count("*").alias("d"))
    both = edges.join(deg.select(F.col("dst").alias("src"), F.col("d").alias("ds")), "src", "left").join(deg.select("dst", F.col("d").alias("dd")), "dst")
    return both.select("src", "dst", (1 / F.sqrt(F.coalesce("ds", F.lit(1)) * F.col("dd").cast("double"))).alias("w"))


def both_weights(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` with w = 1 / sqrt(out-degree of src * in-degree of dst)."""
    out, into = (F.count("*").over(W.partitionBy(c)) for c in ("src", "dst"))
    return edges.select("src", "dst", (1 / F.sqrt((out * into).cast("double"))).alias("w"))


def weighted_sum(weights: DataFrame, vectors: DataFrame, column: str = "feature", name: str = "feature") -> DataFrame:
    """``node_id, <name>``: the sum over incoming edges ``src, dst, w`` (w above 0) of w times the source's vector."""
    return tiles_of(weights).sums(vectors.select("node_id", F.col(column).alias("feature"))).withColumnRenamed("feature", name)


def smoothed(weights: DataFrame, vectors: DataFrame, column: str = "feature") -> DataFrame:
    """``node_id, <array>``: the weighted sum over incoming edges, zeros for nodes without any."""
    found = weighted_sum(weights, vectors, column, "__s")
    return vectors.select("node_id", F.col(column).alias("__x")).join(found, "node_id", "left").select("node_id", F.coalesce("__s", F.transform("__x", lambda x: F.lit(0.0))).alias(column))


def laplacian(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """x - D^-1/2 A D^-1/2 x."""
    s = smoothed(weights, vectors).withColumnRenamed("feature", "__s")
    return vectors.select("node_id", "feature").join(s, "node_id").select("node_id", V.difference("feature", "__s").alias("feature"))


def combined(terms: list[tuple[float, DataFrame]]) -> DataFrame:
    """The weighted sum of vectors of the same nodes."""
    scale, first = terms[0]
    out = first.select("node_id", F.transform("feature", lambda x: x.cast("double") * scale).alias("feature"))
    for scale, term in terms[1:]:
        out = out.join(term.select("node_id", F.col("feature").alias("__t")), "node_id").select("node_id", V.added("feature", "__t", scale).alias("feature"))
    return out


def polynomial_filter(edges: DataFrame, nodes: DataFrame, theta: list[float]) -> DataFrame:
    """Sum of theta_k L^k x."""
    w, power, terms = normalized_edges(edges), nodes.select("node_id", "feature"), []
    for k, t in enumerate(theta):
        if k:
            power = materialize(laplacian(w, power), "power")
        terms.append((t, power))
    return combined(terms)


def bernstein_filter(edges: DataFrame, nodes: DataFrame, weights: list[float]) -> DataFrame:
    """Sum over i of relu(w_i) C(K, i) / 2^K (2I - L)^(K-i) L^i x, as a polynomial of L, so that each power of L is taken once."""
    k = len(weights) - 1
    theta = [0.0] * (k + 1)
    for i, weight in enumerate(weights):
        for j in range(k - i + 1):  # (2 - L)^(k - i) = sum of C(k - i, j) 2^(k - i - j) (-L)^j
            theta[i + j] += max(weight, 0.0) * comb(k, i) / 2**k * comb(k - i, j) * 2.0 ** (k - i - j) * (-1) ** j
    return polynomial_filter(edges, nodes, theta)


def chebyshev(edges: DataFrame, nodes: DataFrame, order: int) -> list[DataFrame]:
    """T_0 x .. T_order x of the Laplacian scaled for a greatest eigenvalue of 2, that is -D^-1/2 A D^-1/2."""
    w = normalized_edges(edges)
    out = [nodes.select("node_id", "feature")]
    for k in range(1, order + 1):
        s = materialize(smoothed(w, out[-1]), "smoothed")
        out.append(combined([(-1.0, s)]) if k == 1 else combined([(-2.0, s), (-1.0, out[-2])]))
    return out


def hops(edges: DataFrame, nodes: DataFrame, k: int, how: str = "mean") -> list[DataFrame]:
    """x, Ax, A^2 x ..: parameter-free propagation with the neighbour aggregate alone."""
    out = [nodes.select("node_id", "feature")]
    for _ in range(k):
        out.append(materialize(aggregated(edges, out[-1], how), "hop"))
    return out


def stacked(terms: list[DataFrame], name: str = "hop") -> DataFrame:
    """``node_id, <name>, dim, v`` of several vectors of each node."""
    out = None
    for k, t in enumerate(terms):
        rows = long_form(t).withColumn(name, F.lit(k).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def gin_smooth(edges: DataFrame, nodes: DataFrame, eps: float = 0.0, how: str = "mean") -> DataFrame:
    """(1 + eps) x + aggregate."""
    found = aggregated(edges, nodes, how, name="__a")
    return nodes.join(found, "node_id").select("node_id", F.zip_with("feature", "__a", lambda x, a: (1 + eps) * x.cast("double") + a).alias("feature"))


def edge_scores(edges: DataFrame, nodes: DataFrame, *keep: str) -> DataFrame:
    """``src, dst, <keep>, e``: exp(dot product of both ends, less the greatest of the target's edges)."""
    a, b = (nodes.select(F.col("node_id").alias(c), F.col("feature").alias(f"f_{c}")) for c in ("src", "dst"))
    scored = edges.join(a, "src").join(b, "dst").select("src", "dst", *keep, V.dot("f_src", "f_dst").alias("s"))
    top = scored.groupBy("dst").agg(F.max("s").alias("top"))
    return scored.join(top, "dst").select("src", "dst", *keep, F.exp(F.col("s") - F.col("top")).alias("e"))


def attention_arrays(edges: DataFrame, nodes: DataFrame, sign: str | None = None) -> DataFrame:
    """``node_id, feature``: messages weighted by the softmax of dot products over each target's edges,
    times the edge's ``sign`` (1 or -1), if given. A tile takes off the greatest product that it met; what tiles say of a node
    is brought to the greatest of all."""
    signed = edges.select("src", "dst", F.col(sign).alias("k")) if sign else edges.select("src", "dst")

    def kernel(s, d, edge, x, y, ns, nd):
        score = np.concatenate([np.einsum("ij,ij->i", x[s[c : c + PIECE]], y[d[c : c + PIECE]]) for c in range(0, len(s), PIECE)])
        top = np.full(nd, -np.inf)
        np.maximum.at(top, d, score)
        e = np.exp(score - top[d])
        kept = e * edge["k"] if sign else e
        told = sums_by(d, lambda c: np.column_stack([x[s[c]] * kept[c, None], e[c]]), nd, x.shape[1] + 1)
        return [("dst", np.column_stack([told, top]))]

    rows = nodes.select("node_id", "feature")
    found = Tiles(signed).run(kernel, rows, rows).select("node_id", F.element_at("s", -1).alias("top"), F.slice("s", 1, F.size("s") - 1).alias("s"))
    all_ = found.withColumn("w", F.exp(F.col("top") - F.max("top").over(W.partitionBy("node_id"))))
    return _scaled_sums(all_).select("node_id", F.transform(F.slice("s", 1, F.size("s") - 1), lambda v: v / F.element_at("s", -1)).alias("feature"))


def _scaled_sums(rows: DataFrame) -> DataFrame:
    """``node_id, s``: the sums of w times s; w may have underflown to 0."""
    scaled = rows.select("node_id", as_vector(F.transform("s", lambda v: v * F.col("w"))).alias("v"))
    return scaled.groupBy("node_id").agg(Summarizer.sum(F.col("v")).alias("v")).select("node_id", vector_to_array("v").alias("s"))


def attention(edges: DataFrame, nodes: DataFrame, sign: str | None = None) -> DataFrame:
    """``attention_arrays`` as ``node_id, dim, v``."""
    return long_form(attention_arrays(edges, nodes, sign))


def relation_arrays(typed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, etype, mean``: neighbour means of each edge type."""
    return _stats(messages(typed, nodes, "feature", "etype"), ["mean"], "node_id", "etype")


def relation_mean(typed: DataFrame, nodes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``node_id, dim, v``: neighbour means of each edge type, averaged over the types a node has; or their
    weighted sum plus the node's own vector."""
    per = relation_arrays(typed, nodes)
    if weights is None:
        return long_form(_stats(per.select("node_id", as_vector("mean").alias("__f")), ["mean"], "node_id"), "mean")
    scale = F.coalesce(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])[F.col("etype")], F.lit(0.0))
    parts = per.select("node_id", F.transform("mean", lambda x: x * scale).alias("f")).unionByName(nodes.select("node_id", F.col("feature").cast("array<double>").alias("f")))
    return long_form(_stats(parts.select("node_id", as_vector("f").alias("__f")), ["sum"], "node_id"), "sum")


def nonzero_mean(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, dim, v``: mean over sources whose vector is not all zeros; without one the divisor is 1."""
    alive = nodes.select(F.col("node_id").alias("src"), F.exists("feature", lambda x: x != 0).cast("int").alias("__a"))
    rows = messages(edges.join(alive, "src"), nodes, "feature", "__a")
    found = rows.groupBy("node_id").agg(Summarizer.sum(F.col("__f")).alias("__s"), F.greatest(F.sum("__a"), F.lit(1)).alias("__n"))
    return long_form(found.select("node_id", F.transform(vector_to_array("__s"), lambda x: x / F.col("__n")).alias("feature")))
