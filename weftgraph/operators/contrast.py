"""Pre-training without labels: nodes against the summary of their cluster, with true and with shuffled features.

An encoder, one rectified dense layer over smoothed features, should give rows that a bilinear discriminator can tell by their own
cluster's summary (the sigmoid of the mean row): those of true features belong to it, those of features dealt to
other nodes do not. Clusters are found anew on a schedule from what the encoder has learned. Smoothing is linear and done
once for both; an epoch is two passes over the nodes, and what reaches the driver is a row of the parameters' size and a row for
each cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashed
from ..storage import discard, materialize
from . import layers as L
from . import propagate as P
from .order import numbered
from .training import Block, Network, Same, _lists, _matrix, _sigmoid, gradient_rows, summed


def shuffled(nodes: DataFrame, seed: int) -> DataFrame:
    """``node_id, feature`` with each feature at the node whose id has the rank of its own node's hash."""
    ids = numbered(nodes.select("node_id"), "node_id")
    dealt = numbered(nodes.select("node_id", "feature"), hashed(seed, "node_id"), F.col("node_id")).select("r", "feature")
    return ids.join(dealt, "r").select("node_id", "feature")


class Contrast:
    """Encoder ``w, b`` and discriminator ``m`` over rows ``node_id, true, dealt`` in ``clusters`` clusters."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, clusters: int = 8, hidden: int = 16, hops: int = 2, seed: int = 1):
        scaled = Network(nodes.select("node_id", "feature", F.lit(0).alias("y"), F.lit("train").alias("part")), [Block(("own",), (1,))], {"own": Same()}, seed)
        plain = materialize(scaled.first.select("node_id", F.col("x").alias("feature")), "scaled")
        scaled.close()
        true, dealt = L.gcn(edges, plain, hops), L.gcn(edges, shuffled(plain, seed), hops)
        rows = true.select("node_id", F.col("feature").alias("true")).join(dealt.select("node_id", F.col("feature").alias("dealt")), "node_id")
        self.rows, self.clusters, self.seed = materialize(rows, "contrast"), clusters, seed
        rng, d = np.random.default_rng(seed), scaled.width
        self.parameters = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), np.eye(hidden) / hidden]
        self.history: list[float] = []
        self.placed = self._clustered(self.rows.select("node_id", F.col("true").alias("feature")))

    def _clustered(self, vectors: DataFrame) -> DataFrame:
        """The rows with the cluster ``k`` of their vector."""
        data = vectors.select("node_id", P.as_vector("feature").alias("v"))
        model = KMeans(k=self.clusters, featuresCol="v", predictionCol="k", seed=self.seed).fit(data)
        return materialize(self.rows.join(model.transform(data).select("node_id", "k"), "node_id"), "placed")

    def encoded(self) -> DataFrame:
        """``node_id, feature``: what the encoder makes of the true features."""
        w, b, _ = self.parameters

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), _lists(np.maximum(_matrix(batch.column("true")) @ w + b, 0))], ["node_id", "feature"])

        return self.rows.select("node_id", "true").mapInArrow(run, "node_id long, feature array<double>")

    def _means(self) -> tuple[np.ndarray, np.ndarray]:
        """Each cluster's mean row and size."""
        (w, b, _), k = self.parameters, self.clusters

        def run(batches):
            total = np.zeros((k, len(b) + 1))
            for batch in batches:
                if batch.num_rows:
                    h = np.maximum(_matrix(batch.column("true")) @ w + b, 0)
                    np.add.at(total, batch.column("k").to_numpy(), np.column_stack((h, np.ones(len(h)))))
            yield pa.RecordBatch.from_arrays(gradient_rows([(0, total.ravel())])[1:], ["about", "d"])

        found = summed(self.placed.select("true", "k").mapInArrow(run, "about int, d array<double>"))[0].reshape(k, -1)
        return found[:, :-1] / np.maximum(found[:, -1:], 1), found[:, -1]

    def gradient(self) -> tuple[list[np.ndarray], float]:
        """Of the mean cross-entropy of both kinds of rows by encoder and discriminator; and the loss. A summary moves with its
        members: what the loss wants of it is known after the pass, so the pass gathers how each cluster's mean moves with the weights."""
        (w, b, m), k = self.parameters, self.clusters
        mean, size = self._means()
        summary = _sigmoid(mean)
        total = 2 * max(size.sum(), 1)
        d, hidden = w.shape

        def run(batches):
            grad = [np.zeros_like(w), np.zeros_like(b), np.zeros_like(m), np.zeros((k, hidden)), np.zeros((k, d + 1, hidden)), np.zeros(1)]
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column("k").to_numpy()
                s = summary[own]
                for name, label in (("true", 1.0), ("dealt", 0.0)):
                    x = _matrix(batch.column(name))
                    h = np.maximum(x @ w + b, 0)
                    p = _sigmoid(((h @ m) * s).sum(axis=1))
                    grad[5] -= np.log((p if label else 1 - p) + 1e-12).sum() / total
                    e = ((p - label) / total)[:, None]
                    dh = e * (s @ m.T) * (h > 0)
                    grad[0] += x.T @ dh
                    grad[1] += dh.sum(axis=0)
                    grad[2] += (h * e).T @ s
                    np.add.at(grad[3], own, e * (h @ m))
                    if label:
                        on = (h > 0).astype(float)
                        for c in np.unique(own):
                            here = own == c
                            grad[4][c] += np.vstack((x[here].T @ on[here], on[here].sum(axis=0)))
            yield pa.RecordBatch.from_arrays(gradient_rows([(0, np.concatenate([g.ravel() for g in grad]))])[1:], ["about", "d"])

        row = summed(self.placed.select("true", "dealt", "k").mapInArrow(run, "about int, d array<double>"))[0]
        sizes = [w.size, b.size, m.size, k * hidden, k * (d + 1) * hidden, 1]
        dw, db, dm, ds, moves, loss = np.split(row, np.cumsum(sizes)[:-1])
        wanted = ds.reshape(k, hidden) * summary * (1 - summary) / np.maximum(size, 1)[:, None]
        through = (moves.reshape(k, d + 1, hidden) * wanted[:, None, :]).sum(axis=0)
        return [dw.reshape(w.shape) + through[:-1], db + through[-1], dm.reshape(m.shape)], float(loss[0])

    def fit(self, epochs: int = 20, every: int = 5, rate: float = 0.02) -> "Contrast":
        """Adam; clusters are found anew after each ``every`` epochs."""
        first, second = [np.zeros_like(p) for p in self.parameters], [np.zeros_like(p) for p in self.parameters]
        for t in range(1, epochs + 1):
            grads, loss = self.gradient()
            self.history.append(loss)
            for i, g in enumerate(grads):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                self.parameters[i] = self.parameters[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
            if t % every == 0 and t < epochs:
                before, self.placed = self.placed, self._clustered(self.encoded())
                discard(before)
        return self
