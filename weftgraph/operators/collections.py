"""Collections of graphs, as edges with a ``graph_id``: clean-up, canonical orders, statistics, motifs.

One graph of a collection may be handed to one task where an order is inherently sequential; a
collection may hold any number of graphs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import hashed
from ..storage import materialize
from .components import connected_components
from .edges import canonical
from .order import numbered
from .structure import bfs, both_ways, orbits4


def as_one(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``u, v`` of all graphs side by side, node ``x`` of graph ``g`` as ``x * graphs + g``; and ``graphs``, the
    greatest graph id and one."""
    graphs = int(pairs.agg(F.max("graph_id")).first()[0] or 0) + 1
    name = lambda c: (F.col(c) * graphs + F.col("graph_id")).alias(c)
    return pairs.select(name("u"), name("v")), graphs


def graph_components(pairs: DataFrame) -> DataFrame:
    """``graph_id, node_id, component`` (the smallest node) of ``graph_id, u, v``."""
    one, graphs = as_one(pairs)
    found = connected_components(one.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return found.select((F.col("node") % graphs).alias("graph_id"), F.expr(f"node div {graphs}").alias("node_id"), F.expr(f"component div {graphs}").alias("component"))


def _largest(pairs: DataFrame) -> DataFrame:
    label = graph_components(pairs)
    size = label.groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    top = size.groupBy("graph_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return label.join(top, ["graph_id", "component"]).select("graph_id", "node_id")


def _kept(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.select("graph_id", F.col("node_id").alias("u")), ["graph_id", "u"], "left_semi")


def cleaned(edges: DataFrame) -> DataFrame:
    """``graph_id, u, v``: without loops and repeats, the largest component of each graph (of the
    smallest node on ties), nodes renamed 0, 1 .. in their order."""
    pairs = materialize(canonical(edges, "graph_id"), "pairs")
    nodes = _largest(pairs)
    names = nodes.withColumn("k", (F.row_number().over(W.partitionBy("graph_id").orderBy("node_id")) - 1).cast("long"))
    u, v = names.select("graph_id", F.col("node_id").alias("u"), F.col("k").alias("ku")), names.select("graph_id", F.col("node_id").alias("v"), F.col("k").alias("kv"))
    return pairs.join(u, ["graph_id", "u"]).join(v, ["graph_id", "v"]).select("graph_id", F.col("ku").alias("u"), F.col("kv").alias("v"))


def before_gap(edges: DataFrame) -> DataFrame:
    """``graph_id, u, v`` of generated graphs: nodes up to the first one (1 or greater) all of whose
    neighbours have greater ids, which began another part; then the largest component of these."""
    pairs = materialize(canonical(edges, "graph_id"), "pairs")
    low = both_ways(pairs, "graph_id").groupBy("graph_id", "a").agg(F.min("b").alias("b"))
    gap = low.where("a < b and a >= 1").groupBy("graph_id").agg(F.min("a").alias("gap"))
    kept = materialize(pairs.join(gap, "graph_id", "left").where("gap is null or v < gap").select("graph_id", "u", "v"), "pairs")
    return _kept(kept, _largest(kept))


def collection_report(pairs: DataFrame) -> DataFrame:
    """One row: greatest and mean number of nodes and of edges of ``graph_id, u, v``."""
    nodes = both_ways(pairs, "graph_id").groupBy("graph_id").agg(F.countDistinct("a").alias("n"))
    size = pairs.groupBy("graph_id").agg(F.count("*").alias("m")).join(nodes, "graph_id")
    return size.agg(F.max("n").alias("max_nodes"), F.avg("n").alias("mean_nodes"), F.max("m").alias("max_edges"), F.avg("m").alias("mean_edges"))


def attribute_order(pairs: DataFrame) -> DataFrame:
    """``graph_id, u, v, place``: the row-major place of each edge in its graph, by (greater, smaller) end."""
    order = W.partitionBy("graph_id").orderBy(F.greatest("u", "v"), F.least("u", "v"))
    return pairs.select("graph_id", "u", "v", (F.row_number().over(order) - 1).cast("long").alias("place"))


def canonical_order(pairs: DataFrame, kind: str = "bfs") -> DataFrame:
    """``graph_id, node_id, place``: components from large to small (smallest node first on ties), each
    searched from its node of greatest degree (smallest id on ties), breadth or depth first,
    neighbours by id. One graph a task."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(part.u.tolist(), part.v.tolist()):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        for x in near.values():
            x.sort()
        left, found = set(near), []
        while left:
            todo, seen = [min(left)], set()
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += near[a]
            left -= seen
            found.append(seen)
        order: list[int] = []
        for nodes in sorted(found, key=lambda s: (-len(s), min(s))):
            root = min(nodes, key=lambda a: (-len(near[a]), a))
            if kind == "bfs":
                queue, seen = [root], {root}
                for a in queue:
                    new = [b for b in near[a] if b not in seen]
                    seen.update(new)
                    queue += new
                order += queue
            else:
                stack, seen = [root], set()
                while stack:
                    a = stack.pop()
                    if a not in seen:
                        seen.add(a)
                        order.append(a)
                        stack += [b for b in reversed(near[a]) if b not in seen]
        return pd.DataFrame({"graph_id": part.graph_id.iloc[0], "node_id": np.array(order, np.int64), "place": np.arange(len(order))})

    return pairs.groupBy("graph_id").applyInPandas(one, "graph_id long, node_id long, place long")


def random_search_order(edges: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """``node_id, place``: breadth first from the node of the smallest hash, by depth and then hash; nodes out
    of reach last."""
    root = nodes.select("node_id").orderBy(hashed(seed, "node_id"), "node_id").limit(1)
    found = nodes.select("node_id").join(bfs(edges, root).select("node_id", "depth"), "node_id", "left")
    placed = numbered(found, F.col("depth").asc_nulls_last(), hashed(seed, "node_id"), F.col("node_id"))
    return placed.select("node_id", (F.col("r") - 1).alias("place"))


def graph_orbits(pairs: DataFrame) -> DataFrame:
    """``graph_id, node_id, o0 .. o14`` of each graph."""
    one, graphs = as_one(pairs)
    return orbits4(one).select((F.col("node_id") % graphs).alias("graph_id"), F.expr(f"node_id div {graphs}").alias("node_id"), *[f"o{k}" for k in range(15)])


def motif_totals(orbits: DataFrame) -> DataFrame:
    """``graph_id, path3, cycle4``: orbits 1 and 2, and orbit 8, summed over nodes and divided by their number."""
    return orbits.groupBy("graph_id").agg((F.sum(F.col("o1") + F.col("o2")) / F.count("*")).alias("path3"), (F.sum("o8") / F.count("*")).alias("cycle4"))


def mean_orbits(orbits: DataFrame) -> DataFrame:
    """``graph_id, h``: each graph's mean orbit counts, not normalised."""
    return orbits.groupBy("graph_id").agg(F.array(*[F.avg(f"o{k}") for k in range(15)]).alias("h"))


def log_bins(values: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """``graph_id, bin, n`` of ``graph_id, x`` over ``bins`` bins whose borders are spaced evenly in the logarithm; the
    last one closed on the right, values outside left out."""
    step = (np.log(high) - np.log(low)) / bins
    inside = values.where(F.col("x").between(low, high))
    return inside.groupBy("graph_id", F.least(F.floor((F.log("x") - float(np.log(low))) / step + 1e-9), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
