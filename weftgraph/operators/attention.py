"""Attention over neighbours with several heads, learned through its softmax.

A node's row is projected to a value, a key and a query for each edge type and head. An edge's score is the leaky
sum of its source's key and its target's query ("additive") or their scaled product ("dot"); over the incoming edges of a
type the scores' softmax weighs the sources' values. Softmax needs no pass for each target's greatest score: a
bound from the greatest key of all nodes is taken off instead. Backwards, the sum that the softmax's derivative needs is the
product of a target's output and its gradient, so one pass over the edges sends all gradients to both ends. Edges meet both ends'
vectors in tiles (``tiles``), so no vector travels for each edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .tiles import Tiles, sums_by
from .training import Network, Weights, _lists, _matrix, backward, forward, gradient_rows, judged, summed

SLOPE = 0.2


def leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, SLOPE * x)


@dataclass(frozen=True)
class Heads:
    """Sizes: edge types, heads, and components of a value; how edges are scored."""

    types: int
    heads: int
    width: int
    kind: str

    @property
    def key(self) -> int:
        return 1 if self.kind == "additive" else self.width

    @property
    def values(self) -> int:
        return self.types * self.heads * self.width

    @property
    def keys(self) -> int:
        return self.types * self.heads * self.key

    def typed(self, x: np.ndarray, size: int) -> np.ndarray:
        """Rows of all types as (row, type, head, component)."""
        return x.reshape(len(x), self.types, self.heads, size)

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """What of a node's keys bounds scores: the key, or its length, for each type and head."""
        k = keys.reshape(len(keys), self.types * self.heads, self.key)
        return k[:, :, 0] if self.kind == "additive" else np.sqrt((k * k).sum(-1))

    def weights(self, k: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(score - bound) of edges, and the score's derivative by the inner sum."""
        if self.kind == "additive":
            pre = (k + q)[:, :, 0]
            return np.exp(leaky(pre) - leaky(bound + q[:, :, 0])), np.where(pre > 0, 1.0, SLOPE)
        scale = 1 / np.sqrt(self.width)
        pre = (k * q).sum(-1) * scale
        return np.exp(pre - np.sqrt((q * q).sum(-1)) * bound * scale), np.full(pre.shape, scale)


@dataclass
class AttentionNetwork(Network):
    """One layer of attention over typed edges ``src, dst, k`` and dense layers ``head`` on its output, beside the node's own
    row if ``separate``. ``blocks`` and ``banks`` are not used."""

    edges: DataFrame | None = None
    heads: Heads | None = None
    head: tuple[int, ...] = (16, 1)
    separate: bool = True
    #: Numbers of nodes that are one group, if edges never leave their group.
    stride: int | None = None

    def __post_init__(self):
        plain = self._prepared().withColumnRenamed("feature", "x")
        self._keep(plain.join(self.labels, "node_id"))
        self.edges = materialize(self.edges.select("src", "dst", "k"), "typed")
        self.tiles = Tiles(self.edges, self.stride)
        rng, h = np.random.default_rng(self.seed), self.heads
        out = h.values + 2 * h.keys
        width = h.values + (self.width if self.separate else 0)
        layers = []
        for wide in self.head:
            layers.append((rng.normal(0, np.sqrt(2 / width), (width, wide)), np.zeros(wide)))
            width = wide
        self.weights = [[(rng.normal(0, np.sqrt(1 / self.width), (self.width, out)), np.zeros(out))], layers]

    def _projected(self, weights: Weights) -> DataFrame:
        (w, b), h = weights[0][0], self.heads

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    z = _matrix(batch.column("x")) @ w + b
                    v, k, q = z[:, : h.values], z[:, h.values : h.values + h.keys], z[:, h.values + h.keys :]
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), _lists(v), _lists(k), _lists(q), _lists(h.bounds(k))], ["node_id", "v", "key", "query", "bound"])

        a = "array<double>"
        return materialize(self.first.select("node_id", "x").mapInArrow(run, f"node_id long, v {a}, key {a}, query {a}, bound {a}"), "projected")

    def _bound(self, projected: DataFrame) -> np.ndarray:
        found = projected.select(F.posexplode("bound").alias("i", "b")).groupBy("i").agg(F.max("b").alias("b")).collect()  # a row for each type and head
        return np.array([r.b for r in sorted(found)]).reshape(self.heads.types, self.heads.heads)

    def _gathered_values(self, projected: DataFrame, bound: np.ndarray) -> DataFrame:
        """``node_id, s``: for each type the weighted sum of values, and the sum of weights, of each head."""
        h = self.heads
        each = h.heads * (h.width + 1)

        def kernel(s, d, edge, x, y, ns, nd):
            kind = edge["k"]
            v, k, q = h.typed(x[:, : h.values], h.width), h.typed(x[:, h.values :], h.key), h.typed(y, h.key)

            def take(c):
                w, _ = h.weights(k[s[c], kind[c]], q[d[c], kind[c]], bound[kind[c]])
                return np.concatenate([(v[s[c], kind[c]] * w[:, :, None]).reshape(len(c), -1), w], axis=1)

            return [("dst", sums_by(d * h.types + kind, take, nd * h.types, each).reshape(nd, -1))]

        rows = self.tiles.run(kernel, projected.select("node_id", F.concat("v", "key").alias("feature")), projected.select("node_id", F.col("query").alias("feature")))
        return self.tiles.added(rows, "s")

    def _head(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The head's input, the attention's output (row, type and head, component) and the sums of weights."""
        h = self.heads
        s = s.reshape(len(s), h.types, h.heads * (h.width + 1))
        den = s[:, :, h.heads * h.width :].reshape(len(s), -1)
        num = s[:, :, : h.heads * h.width].reshape(len(s), h.types * h.heads, h.width)
        out = num / np.where(den > 0, den, 1.0)[:, :, None]
        flat_out = out.reshape(len(s), -1)
        return (np.concatenate([x, flat_out], axis=1) if self.separate else flat_out), out, den

    def _rows(self, sums: DataFrame) -> DataFrame:
        zeros = F.array_repeat(F.lit(0.0), self.heads.types * self.heads.heads * (self.heads.width + 1))
        return self.first.join(sums, "node_id", "left").withColumn("s", F.coalesce("s", zeros))

    def gradient(self, weights: Weights) -> tuple[list[np.ndarray], float, float]:
        h, layers, positive, total, own = self.heads, weights[1], self.positive, self.rows, self.width if self.separate else 0
        net = _Plain(self)
        projected = self._projected(weights)
        bound = self._bound(projected)

        def judge(batches):
            sums, loss = None, np.zeros(4)
            for batch in batches:
                if not batch.num_rows:
                    continue
                inputs, out, den = net.head(_matrix(batch.column("x")), _matrix(batch.column("s")))
                states = forward(inputs, layers, True)
                d, cost = judged(states[-1][:, 0], batch, positive, total)
                loss += cost
                d, grad = backward(states, layers, d, True)
                sums = grad if sums is None else sums + grad
                d = d[:, own:].reshape(out.shape)
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.nulls(len(d), pa.int32()), _lists(d.reshape(len(d), -1)), _lists(den), _lists((d * out).sum(-1))], ["node_id", "about", "d", "den", "q"])
            rows = [(1, sums)] * (sums is not None) + [(-1, loss)]
            nothing = pa.nulls(len(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*gradient_rows(rows), nothing, nothing], ["node_id", "about", "d", "den", "q"])

        a = "array<double>"
        rows = self._rows(self._gathered_values(projected, bound)).select("node_id", "x", "y", "part", "s")
        back = materialize(rows.mapInArrow(judge, f"node_id long, about int, d {a}, den {a}, q {a}"), "back")
        sizes = [h.heads * h.width, h.heads * h.key, h.heads * h.key]
        each, key = sum(sizes), h.values + h.keys

        def kernel(s, d, edge, x, y, ns, nd):
            kind = edge["k"]
            v, k = h.typed(x[:, : h.values], h.width), h.typed(x[:, h.values :], h.key)
            q, grad, den, less = (h.typed(y[:, a:b], n) for a, b, n in ((0, h.keys, h.key), (h.keys, key, h.width), (key, key + h.types * h.heads, 1), (key + h.types * h.heads, None, 1)))

            def send(c, to_source):
                a, b = (s[c], kind[c]), (d[c], kind[c])
                w, slope = h.weights(k[a], q[b], bound[kind[c]])
                alpha = w / den[b][:, :, 0]
                pre = (alpha * ((grad[b] * v[a]).sum(-1) - less[b][:, :, 0]) * slope)[:, :, None]
                if to_source:
                    parts = grad[b] * alpha[:, :, None], pre if h.kind == "additive" else pre * q[b]
                    return np.concatenate([p.reshape(len(c), -1) for p in parts], axis=1)
                return (pre if h.kind == "additive" else pre * k[a]).reshape(len(c), -1)

            out = {"src": np.zeros((ns, h.types, each)), "dst": np.zeros((nd, h.types, each))}
            cut = sizes[0] + sizes[1]
            out["src"][:, :, :cut] = sums_by(s * h.types + kind, lambda c: send(c, True), ns * h.types, cut).reshape(ns, h.types, -1)
            out["dst"][:, :, cut:] = sums_by(d * h.types + kind, lambda c: send(c, False), nd * h.types, sizes[2]).reshape(nd, h.types, -1)
            return [(end, z.reshape(len(z), -1)) for end, z in out.items()]

        target = projected.select("node_id", "query").join(back.where("node_id is not null").select("node_id", "d", "den", "q"), "node_id")
        target = target.select("node_id", F.concat("query", "d", "den", "q").alias("feature"))
        sent = self.tiles.added(self.tiles.run(kernel, projected.select("node_id", F.concat("v", "key").alias("feature")), target), "s")

        def collect(batches):
            total_grad = None
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("x"))
                    s = _matrix(batch.column("s")).reshape(len(x), h.types, each)
                    cuts = np.split(s, np.cumsum(sizes)[:-1], axis=2)
                    dz = np.concatenate([c.reshape(len(x), -1) for c in cuts], axis=1)
                    grad = np.concatenate([(x.T @ dz).ravel(), dz.sum(axis=0)])
                    total_grad = grad if total_grad is None else total_grad + grad
            if total_grad is not None:
                yield pa.RecordBatch.from_arrays(gradient_rows([(0, total_grad)])[1:], ["about", "d"])

        projection = self.first.select("node_id", "x").join(sent, "node_id").mapInArrow(collect, "about int, d array<double>")
        sums = summed(projection.unionByName(back.where("about is not null").select("about", "d")))
        discard(projected, back)
        loss = sums.get(-1, np.zeros(4))
        sizes_of = [sum(w.size + b.size for w, b in layers) for layers in weights]
        return [sums.get(k, np.zeros(n)) for k, n in enumerate(sizes_of)], loss[0] / max(loss[1], 1e-12), loss[2] / max(loss[3], 1e-12)

    def scores(self) -> DataFrame:
        projected, net, layers = self._projected(self.weights), _Plain(self), self.weights[1]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    z = forward(net.head(_matrix(batch.column("x")), _matrix(batch.column("s")))[0], layers, True)[-1][:, 0]
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["node_id", "p"])

        return self._rows(self._gathered_values(projected, self._bound(projected))).select("node_id", "x", "s").mapInArrow(run, "node_id long, p double")


class _Plain:
    """What tasks need of a network: its sizes, no tables."""

    def __init__(self, net: AttentionNetwork):
        self.heads, self.separate = net.heads, net.separate

    def head(self, x: np.ndarray, s: np.ndarray):
        return AttentionNetwork._head(self, x, s)


def gat_network(edges: DataFrame, nodes: DataFrame, heads: int = 2, width: int = 8, separate: bool = False, kind: str = "additive", seed: int = 1) -> AttentionNetwork:
    """Additive attention (or "dot", as transformers have it) over neighbours and, unless ``separate``, the node itself."""
    from .edges import reset_loops

    rows = (edges if separate else reset_loops(edges, nodes)).select("src", "dst", F.lit(0).alias("k"))
    return AttentionNetwork(nodes, [], {}, seed, edges=rows, heads=Heads(1, heads, width, kind), separate=separate)


def typed_attention_network(typed: DataFrame, nodes: DataFrame, etypes: list[str], heads: int = 2, width: int = 8, seed: int = 1) -> AttentionNetwork:
    """Scaled products with values, keys and queries of each edge type's own, beside the node's own row."""
    kinds = F.create_map(*[F.lit(x) for k, e in enumerate(etypes) for x in (e, k)])
    rows = typed.where(F.col("etype").isin(etypes)).select("src", "dst", kinds[F.col("etype")].alias("k"))
    return AttentionNetwork(nodes, [], {}, seed, edges=rows, heads=Heads(len(etypes), heads, width, "dot"), separate=True)
