"""Detectors that learn along with what they choose: neighbours by a learned distance, trees by a network's gradient."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import discard, materialize
from . import propagate as P
from .edges import with_ends
from .predictors import as_vectors
from .training import Block, Edges, Network, Relations, Same


@dataclass
class Chooser:
    """The share of neighbours that each relation keeps, and how it came about."""

    shares: dict[str, float]
    last: dict[str, float] = field(default_factory=dict)
    moves: dict[str, list[int]] = field(default_factory=dict)

    def learn(self, distances: dict[str, float], step: float, window: int = 10) -> None:
        """A relation whose kept neighbours came nearer since the last round keeps more of them, another one fewer; one whose last
        ``window`` moves nearly cancel has settled."""
        for e, now in distances.items():
            before, moves = self.last.get(e), self.moves.setdefault(e, [])
            settled = len(moves) >= window and abs(sum(moves[-window:])) <= 2
            if before is not None and not settled:
                moves.append(1 if now <= before else -1)
                self.shares[e] = min(1.0, max(step, self.shares[e] + moves[-1] * step))
            self.last[e] = now


def nearest_share(typed: DataFrame, scores: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``src, dst, etype, d`` of each target's incoming edges of a type: its share of least distance |s - s'| in ``scores(node_id, s)``,
    one at least."""
    d = with_ends(typed.select("src", "dst", "etype"), scores, "s").select("src", "dst", "etype", F.round(F.abs(F.col("src_s") - F.col("dst_s")), 9).alias("d"))
    here = W.partitionBy("dst", "etype")
    wanted = F.create_map(*[F.lit(x) for e, p in shares.items() for x in (e, float(p))])[F.col("etype")]
    ranked = d.withColumn("__r", F.row_number().over(here.orderBy("d", "src"))).withColumn("__n", F.count("*").over(here))
    return ranked.where(F.col("__r") <= F.ceil(F.round(F.col("__n") * wanted, 9))).select("src", "dst", "etype", "d")


def chosen_neighbours(typed: DataFrame, nodes: DataFrame, etypes: list[str], rounds: int = 6, epochs: int = 3, step: float = 0.05, hidden: int = 16, seed: int = 1) -> tuple[Network, Chooser]:
    """A network over the neighbours that a learned distance keeps, and the shares at the end.

    In each round a scorer of labels takes some steps; nodes are as far apart as its scores; each relation keeps its share of
    nearest neighbours, which moves by what that did to the mean distance of kept edges into positive training nodes; and
    the network over the kept edges (own row beside each relation's mean, weighted by its share) takes some
    steps. The scorer, the shares and the network thus learn along with each other, each from where it stood."""
    typed = materialize(typed.where(F.col("etype").isin(etypes)).select("src", "dst", "etype"), "typed")
    scorer = Network(nodes, [Block(("own",), (1,))], {"own": Same()}, seed)
    chooser, weights, net = Chooser({e: 0.5 for e in etypes}), None, None
    positive = nodes.where("part = 'train' and y = 1").select(F.col("node_id").alias("dst"))
    kinds = F.create_map(*[F.lit(x) for k, e in enumerate(etypes) for x in (e, k)])
    for _ in range(rounds):
        scorer.fit(epochs, 0.1, epochs)
        scores = scorer.scores().select("node_id", F.tanh(F.log(F.greatest("p", F.lit(1e-12)) / F.greatest(1 - F.col("p"), F.lit(1e-12)))).alias("s"))
        kept = materialize(nearest_share(typed, materialize(scores, "scores"), chooser.shares), "kept")
        found = kept.join(positive, "dst", "left_semi").groupBy("etype").agg(F.avg("d").alias("d")).collect()  # a row for each type
        shares = F.create_map(*[F.lit(x) for e, p in chooser.shares.items() for x in (e, float(p))])[F.col("etype")]
        rows = kept.select("src", "dst", kinds[F.col("etype")].alias("k"), shares.alias("p"))
        means = rows.join(rows.groupBy("dst", "k").agg(F.count("*").alias("n")), ["dst", "k"]).select("src", "dst", "k", (F.col("p") / F.col("n")).alias("w"))
        if net is not None:
            net.close()
        net = Network(nodes, [Block(("own", "kinds"), (hidden, 1))], {"own": Same(), "kinds": Relations(materialize(means, "weights"), len(etypes))}, seed)
        net.weights = weights or net.weights
        weights = net.fit(epochs, 0.05, epochs).weights
        chooser.learn({r.etype: r.d for r in found}, step)
    scorer.close()
    return net, chooser


def boosted_network(edges: DataFrame, nodes: DataFrame, rounds: int = 3, epochs: int = 5, hidden: int = 8, depth: int = 4, rate: float = 1.0, seed: int = 1) -> tuple[Network, list[float]]:
    """A network fed by boosted trees that are fitted to what the network sends back; and the training loss after each round.

    The first tree learns labels from the nodes' features; its output stands beside the features in the network's input. After some
    steps the network gives the gradient of its loss by that output, and the next tree learns how the output should
    move at the training nodes. Trees know features only, the network knows the edges."""
    from pyspark.ml.regression import DecisionTreeRegressor

    from .edges import reset_loops

    plain = Network(nodes, [Block(("own",), (1,))], {"own": Same()}, seed)
    base = materialize(plain.first.select("node_id", F.col("x").alias("feature"), "y", "part"), "scaled")
    plain.close()
    bank = {"own": Same(), "gcn": Edges(materialize(P.normalized_edges(reset_loops(edges, nodes)), "weights"))}
    vectors = as_vectors(base)
    tree = DecisionTreeRegressor(featuresCol="vec", labelCol="target", maxDepth=depth, seed=seed)
    output = base.select("node_id", F.lit(0.0).alias("u"))
    targets = base.where("part = 'train'").select("node_id", (2 * F.col("y") - 1).alias("target"))
    weights, net, losses = None, None, []
    for _ in range(rounds):
        model = tree.fit(vectors.join(targets, "node_id").select("vec", "target"))
        told = model.transform(vectors).select("node_id", F.col("prediction").alias("t"))
        before, output = output, materialize(output.join(told, "node_id").select("node_id", (F.col("u") + F.col("t")).alias("u")), "outputs")
        discard(before)
        if net is not None:
            net.close()
        fed = base.join(output, "node_id").select("node_id", F.concat("feature", F.array("u")).alias("feature"), "y", "part")
        net = Network(fed, [Block(("own", "gcn"), (hidden,)), Block(("own", "gcn"), (1,))], bank, seed, scaled=False)
        net.weights = weights or net.weights
        weights = net.fit(epochs, 0.05, epochs).weights
        losses.append(min(train for train, _ in net.history))
        back = net.input_gradient().join(base.where("part = 'train'").select("node_id"), "node_id")
        targets = materialize(back.select("node_id", (-rate * net.rows * F.element_at("back", -1)).alias("target")), "targets")
    return net, losses
