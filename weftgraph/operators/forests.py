"""Networks inside sampled trees: slots hear from their children, level by level, and the root is judged.

A forest is a graph whose nodes are the filled slots of all trees and whose edges go from child to parent, so a slot hears from
``fanout`` others at most, however many neighbours its node has. A block of a network gathers one level; as many
blocks as levels bring the leaves' features to the root. Losses count roots only.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .attention import AttentionNetwork, Heads
from .training import Block, Edges, Filters, Network, Same, mean_weights


def slot_ids(trees: DataFrame, slots: int) -> DataFrame:
    """Filled slots of ``root, pos, parent_pos, node_id`` with a number ``slot`` of their own and their parent's, ``above``; ``slots``
    is the number of places of a tree. Numbers are root * slots + pos."""
    at = lambda c: F.col("root") * slots + F.col(c)
    return trees.where("node_id is not null").select("root", "pos", "node_id", at("pos").alias("slot"), at("parent_pos").alias("above"))


def forest_nodes(filled: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, feature, y, part`` of all filled slots; slots below the root belong to no part and have no label."""
    rows = filled.join(nodes.select("node_id", "feature", "y", "part"), "node_id")
    top = lambda c: F.when(F.col("pos") == 0, F.col(c))
    return rows.select(F.col("slot").alias("node_id"), "feature", top("y").alias("y"), F.coalesce(top("part"), F.lit("below")).alias("part"))


def tree_network(trees: DataFrame, nodes: DataFrame, kind: str, depth: int, fanout: int, hidden: int = 16, seed: int = 1) -> "TreeNetwork":
    """A network over ``trees`` of ``depth`` levels below the root, of ``nodes(node_id, feature, y, part)``, one root for each node:

    - "sgc": the mean of a slot and its children, taken ``depth`` times, and one dense layer;
    - "gcn": the same mean with a rectified dense layer after each time;
    - "sage": a slot's own row beside its children's mean at each level;
    - "gin": a slot plus the sum of its children, two dense layers at each level;
    - "gat": the root attends to the slots of each level, with values, keys and queries of each level's own.

    Empty slots send nothing. A root without children hears itself only."""
    slots = sum(fanout**h for h in range(depth + 1))
    filled = materialize(slot_ids(trees, slots), "slots")
    rows = materialize(forest_nodes(filled, nodes), "forest")
    up = filled.where("above is not null").select(F.col("slot").alias("src"), F.col("above").alias("dst"))
    selves = filled.select(F.col("slot").alias("src"), F.col("slot").alias("dst"))
    if kind == "gat":
        first = [sum(fanout**h for h in range(k)) for k in range(1, depth + 1)]  # where levels 1, 2, ... begin
        level = sum((F.col("pos") >= f).cast("int") for f in first) - 1
        down = filled.where("pos > 0").select(F.col("slot").alias("src"), (F.col("root") * slots).alias("dst"), level.alias("k"))
        net = AttentionNetwork(rows, [], {}, seed, edges=down, heads=Heads(depth, 2, max(1, hidden // 2), "additive"), head=(hidden, 1), stride=slots)
        return TreeNetwork(net, slots)
    if kind == "gin":
        both = up.unionByName(selves).withColumn("w", F.lit(1.0))
        name, bank, widths = ("sum",), {"sum": Edges(materialize(both, "weights"), slots)}, (hidden, hidden)
    elif kind == "sage":
        name, bank, widths = ("own", "mean"), {"own": Same(), "mean": Edges(materialize(mean_weights(up), "weights"), slots)}, (hidden,)
    elif kind in ("gcn", "sgc"):
        weights = materialize(mean_weights(up.unionByName(selves)), "weights")
        name, bank, widths = ("mean",), {"mean": Edges(weights, slots)}, (hidden,)
        if kind == "sgc":  # S^depth as a polynomial of I - S
            powers = Filters(weights, [[float((-1) ** k * comb(depth, k)) for k in range(depth + 1)]], slots)
            return TreeNetwork(Network(rows, [Block(("power",), (1,))], {"power": powers}, seed), slots)
    else:
        raise ValueError(f"no network of kind {kind}")
    blocks = [Block(name, widths)] * (depth - 1) + [Block(name, (*widths, 1))]
    return TreeNetwork(Network(rows, blocks, bank, seed), slots)


class TreeNetwork:
    """A network over a forest, asked about roots."""

    def __init__(self, net: Network, slots: int):
        self.net, self.slots = net, slots

    def fit(self, epochs: int = 20, rate: float = 0.05, patience: int = 8) -> "TreeNetwork":
        """Stops once the validation roots' loss has not fallen for ``patience`` epochs; the best weights are kept."""
        self.net.fit(epochs, rate, patience)
        return self

    def scores(self) -> DataFrame:
        """``node_id, p`` of all roots."""
        roots = self.net.scores().where(F.col("node_id") % self.slots == 0)
        return roots.select(F.expr(f"node_id div {self.slots}").alias("node_id"), "p")

    def close(self) -> None:
        self.net.close()
