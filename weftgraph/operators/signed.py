"""A network whose edges learn whether their ends agree, together with the head that uses them.

A node's row is projected; an edge's sign, between -1 and 1, is learned from both projections and their products, and weighs what
the source sends. The loss is the head's cross-entropy, a hinge on the signs of edges between training nodes, and the distance
of each training node to its class's mean row, all descended at once: the projection hears from all three. An epoch joins the
edges with both ends' rows once forwards and once backwards; sums go by node, and by tree for the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from . import propagate as P
from .training import Network, Weights, _lists, _matrix, backward, forward, gradient_rows, initial_layers, judged, mean_weights, summed


def signs_of(u: np.ndarray, v: np.ndarray, judge: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The signs of edges from rows ``u`` to ``v``; the judge weighs source, target and their products."""
    a, b, c = np.split(judge[0][:, 0], 3)
    return np.tanh(u @ a + v @ b + (u * v) @ c + judge[1][0])


@dataclass
class SignedNetwork(Network):
    """Signed means over incoming ``edges`` beside the node's own row, and dense layers ``head``. ``hinge`` and ``pull`` weigh the
    losses of edges and of distances to class means; edges that agree and that do not count alike, as do both classes.
    ``blocks`` and ``banks`` are not used. A node without incoming edges has zeros for its mean."""

    edges: DataFrame | None = None
    hidden: int = 8
    head: tuple[int, ...] = (16, 1)
    hinge: float = 0.5
    pull: float = 0.1

    def __post_init__(self):
        plain = self._prepared().withColumnRenamed("feature", "x")
        self._keep(plain.join(self.labels, "node_id"))
        told = self.labels.where("part = 'train' and y is not null").select("node_id", "y")
        rows = mean_weights(self.edges.select("src", "dst"))
        for end in ("src", "dst"):
            rows = rows.join(told.select(F.col("node_id").alias(end), F.col("y").alias(f"y_{end}")), end, "left")
        alike = F.when(F.col("y_src") == F.col("y_dst"), 1.0).when(F.col("y_src") != F.col("y_dst"), -1.0).otherwise(0.0)
        self.edges = materialize(rows.select("src", "dst", "w", alike.alias("t")), "signed")
        self.known = {r.t: r.n for r in self.edges.where("t <> 0").groupBy("t").agg(F.count("*").alias("n")).collect()}  # two rows
        rng, h = np.random.default_rng(self.seed), self.hidden
        project = [(rng.normal(0, np.sqrt(1 / max(self.width, 1)), (self.width, h)), np.zeros(h))]
        judge = [(np.concatenate([np.zeros((2 * h, 1)), np.full((h, 1), 1 / h)]), np.zeros(1))]
        self.weights = [project, judge, initial_layers(rng, 2 * h, self.head)]

    def _projected(self, weights: Weights) -> DataFrame:
        w, b = weights[0][0]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), _lists(_matrix(batch.column("x")) @ w + b)], ["node_id", "z"])

        return materialize(self.first.select("node_id", "x").mapInArrow(run, "node_id long, z array<double>"), "projected")

    def _on_edges(self, projected: DataFrame, target: DataFrame | None = None) -> DataFrame:
        """Edges with both ends' rows as ``u`` and ``v``, and what ``target(dst, g)`` says of the target."""
        rows = self.edges.join(projected.select(F.col("node_id").alias("src"), F.col("z").alias("u")), "src")
        ends = projected.select(F.col("node_id").alias("dst"), F.col("z").alias("v"))
        return rows.join(ends if target is None else ends.join(target, "dst"), "dst")

    def _rows(self, projected: DataFrame, weights: Weights) -> DataFrame:
        """``node_id, x, y, part``: each node's own row beside the signed mean of what came in."""
        judge = weights[1][0]

        def send(batches):
            for batch in batches:
                if batch.num_rows:
                    u, v, w = _matrix(batch.column("u")), _matrix(batch.column("v")), batch.column("w").to_numpy()
                    yield pa.RecordBatch.from_arrays([batch.column("dst"), _lists(u * (signs_of(u, v, judge) * w)[:, None])], ["node_id", "s"])

        came = _sums(self._on_edges(projected).select("dst", "u", "v", "w").mapInArrow(send, "node_id long, s array<double>"))
        zeros = F.array_repeat(F.lit(0.0), self.hidden)
        rows = projected.join(came, "node_id", "left").join(self.labels, "node_id")
        return materialize(rows.select("node_id", F.concat("z", F.coalesce("s", zeros)).alias("x"), "y", "part"), "told")

    def _prototypes(self, rows: DataFrame) -> dict[float, tuple[np.ndarray, int]]:
        """Each class's mean row over training nodes, and their number."""
        here = rows.where("part = 'train' and y is not null").select("y", P.as_vector("x").alias("v"))
        found = here.groupBy("y").agg(Summarizer.mean(F.col("v")).alias("m"), F.count("*").alias("n"))
        return {r.y: (np.array(r.m), r.n) for r in found.select("y", vector_to_array("m").alias("m"), "n").collect()}  # a row for each class

    def gradient(self, weights: Weights) -> tuple[list[np.ndarray], float, float]:
        projected = self._projected(weights)
        rows = self._rows(projected, weights)
        back = materialize(self._judged(rows, weights), "back")
        target = back.where("node_id is not null").select(F.col("node_id").alias("dst"), F.slice("d", self.hidden + 1, self.hidden).alias("g"))
        sent = materialize(self._sent(self._on_edges(projected, target), weights), "sent")
        own = back.where("node_id is not null").select("node_id", F.slice("d", 1, self.hidden).alias("s"))
        by_node = _sums(sent.where("node_id is not null").select("node_id", F.col("d").alias("s")).unionByName(own))

        def collect(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    dz = _matrix(batch.column("s"))
                    grad = np.concatenate([(_matrix(batch.column("x")).T @ dz).ravel(), dz.sum(axis=0)])
                    total = grad if total is None else total + grad
            if total is not None:
                yield pa.RecordBatch.from_arrays(gradient_rows([(0, total)])[1:], ["about", "d"])

        parts = self.first.select("node_id", "x").join(by_node, "node_id").select("x", "s").mapInArrow(collect, "about int, d array<double>")
        for table in (back, sent):
            parts = parts.unionByName(table.where("about is not null").select("about", "d"))
        sums = summed(parts)
        discard(projected, rows, back, sent)
        loss = sums.get(-1, np.zeros(4))
        more = sum(float(sums[k][0]) for k in (-2, -3) if k in sums)
        sizes = [sum(w.size + b.size for w, b in layers) for layers in weights]
        return [sums.get(k, np.zeros(n)) for k, n in enumerate(sizes)], loss[0] / max(loss[1], 1e-12) + more, loss[2] / max(loss[3], 1e-12)

    def _judged(self, rows: DataFrame, weights: Weights) -> DataFrame:
        """``node_id, about, d``: the gradient by each node's row, by the head's weights, and the losses of head and distances."""
        layers, positive, total, pull, means = weights[2], self.positive, self.rows, self.pull, self._prototypes(rows)

        def run(batches):
            sums, loss, apart = None, np.zeros(4), 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("x"))
                states = forward(x, layers, True)
                d, cost = judged(states[-1][:, 0], batch, positive, total)
                loss += cost
                d, grad = backward(states, layers, d, True)
                sums = grad if sums is None else sums + grad
                y, train = np.array(batch.column("y").to_pylist(), float), np.array(batch.column("part").to_pylist(), object) == "train"
                for k, (mean, n) in means.items():
                    here = train & (y == k)
                    gap, scale = x[here] - mean, pull / (n * x.shape[1])
                    apart += scale * float((gap * gap).sum())
                    d[here] += 2 * scale * gap  # a mean's own share cancels out: gaps from it sum to nothing
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.nulls(len(d), pa.int32()), _lists(d)], ["node_id", "about", "d"])
            if sums is not None:
                yield pa.RecordBatch.from_arrays(gradient_rows([(2, sums), (-1, loss), (-3, np.array([apart]))]), ["node_id", "about", "d"])

        return rows.mapInArrow(run, "node_id long, about int, d array<double>")

    def _sent(self, rows: DataFrame, weights: Weights) -> DataFrame:
        """``node_id, about, d``: what edges send back to both ends, their gradient by the judge's weights, and the hinge's loss."""
        judge, hinge, known = weights[1][0], self.hinge, self.known

        def run(batches):
            sums, loss = None, 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                u, v, g = (_matrix(batch.column(c)) for c in ("u", "v", "g"))
                w, t = batch.column("w").to_numpy(), batch.column("t").to_numpy()
                s, share = signs_of(u, v, judge), np.zeros(len(t))
                for kind, n in known.items():
                    share[t == kind] = hinge / n
                short = np.maximum(1 - t * s, 0) * (t != 0)
                loss += float((share * short).sum())
                pre = (w * (g * u).sum(axis=1) - share * t * (short > 0)) * (1 - s * s)
                a, b, c = np.split(judge[0][:, 0], 3)
                grad = np.concatenate([pre @ u, pre @ v, pre @ (u * v), [pre.sum()]])
                sums = grad if sums is None else sums + grad
                for end, d in (("src", (s * w)[:, None] * g + pre[:, None] * (a + c * v)), ("dst", pre[:, None] * (b + c * u))):
                    yield pa.RecordBatch.from_arrays([batch.column(end), pa.nulls(len(d), pa.int32()), _lists(d)], ["node_id", "about", "d"])
            if sums is not None:
                yield pa.RecordBatch.from_arrays(gradient_rows([(1, sums), (-2, np.array([loss]))]), ["node_id", "about", "d"])

        return rows.select("src", "dst", "w", "t", "u", "v", "g").mapInArrow(run, "node_id long, about int, d array<double>")

    def outputs(self) -> DataFrame:
        layers = self.weights[2]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), _lists(forward(_matrix(batch.column("x")), layers, True)[-1])], ["node_id", "feature"])

        rows = self._rows(self._projected(self.weights), self.weights)
        return rows.select("node_id", "x").mapInArrow(run, "node_id long, feature array<double>")

    def signs(self) -> DataFrame:
        """``src, dst, sign`` of all edges, above 0 where the ends are held to agree."""
        judge = self.weights[1][0]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    s = signs_of(_matrix(batch.column("u")), _matrix(batch.column("v")), judge)
                    yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array(s)], ["src", "dst", "sign"])

        return self._on_edges(self._projected(self.weights)).select("src", "dst", "u", "v").mapInArrow(run, "src long, dst long, sign double")


def _sums(rows: DataFrame) -> DataFrame:
    found = rows.select("node_id", P.as_vector("s").alias("v")).groupBy("node_id").agg(Summarizer.sum(F.col("v")).alias("v"))
    return found.select("node_id", vector_to_array("v").alias("s"))
