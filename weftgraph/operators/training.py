"""Networks trained through their propagation.

A network is a list of blocks. A block gathers vectors along edges (its *banks*, linear maps over all nodes, side by side)
and then applies dense layers to each node's row. Gathering is a join and an aggregation; dense layers and their
gradients are matrix products over Arrow batches. Backwards, each bank gathers along reversed edges (its adjoint), and what
all nodes say about a block's weights is summed by tree: the driver sees one row for each block. What each block
gathered is written in each epoch; the first block's is constant and kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import discard, materialize
from . import propagate as P
from .tiles import Tiles

#: Groups in which the rows of gradients are summed before the last sum.
TREE = 32


class Same:
    """The node's own vector."""

    #: Vectors that a bank puts side by side.
    parts = 1

    def apply(self, vectors: DataFrame) -> DataFrame:
        return vectors

    adjoint = apply


class Edges:
    """Weighted sums over incoming edges ``src, dst, w`` (w above 0); backwards over outgoing ones. ``stride``: numbers of nodes that
    are one group, if edges never leave their group."""

    parts = 1

    def __init__(self, weights: DataFrame, stride: int | None = None):
        self.tiles = Tiles(weights, stride)

    def apply(self, vectors: DataFrame) -> DataFrame:
        return self.tiles.sums(vectors)

    def adjoint(self, vectors: DataFrame) -> DataFrame:
        return self.tiles.sums(vectors, back=True)


class Filters:
    """Polynomials of I - S of weighted sums S, side by side: one row of ``thetas`` for each, all of one degree. Each power is taken
    once, whatever the number of polynomials."""

    def __init__(self, weights: DataFrame, thetas: list[list[float]], stride: int | None = None):
        self.edges, self.thetas, self.parts, self.made = Edges(weights, stride), thetas, len(thetas), []

    def _written(self, rows: DataFrame) -> DataFrame:
        self.made.append(materialize(rows, "power"))
        return self.made[-1]

    def _less(self, vectors: DataFrame, back: bool) -> DataFrame:
        """(I - S) of vectors, or of its adjoint."""
        s = (self.edges.adjoint if back else self.edges.apply)(vectors).withColumnRenamed("feature", "__s")
        return vectors.join(s, "node_id", "left").select("node_id", F.coalesce(V.difference("feature", "__s"), "feature").alias("feature"))

    def apply(self, vectors: DataFrame) -> DataFrame:
        discard(*self.made)  # what the network made of them is written
        self.made = []
        power = self._written(vectors.select("node_id", F.col("feature").cast("array<double>").alias("feature")))
        out = power.select("node_id", F.array("feature").alias("__p"))
        for _ in range(len(self.thetas[0]) - 1):
            power = self._written(self._less(power, False))
            out = out.join(power, "node_id").select("node_id", F.concat("__p", F.array("feature")).alias("__p"))
        return out.select("node_id", F.concat(*[_mixed([F.col("__p")[k] for k in range(len(t))], t) for t in self.thetas]).alias("feature"))

    def adjoint(self, vectors: DataFrame) -> DataFrame:
        rows = self._written(vectors.select("node_id", F.col("feature").cast("array<double>").alias("feature")))
        width = F.expr(f"size(feature) div {self.parts}").cast("int")
        pieces = [F.slice("feature", k * width + 1, width) for k in range(self.parts)]
        term = lambda k: rows.select("node_id", _mixed(pieces, [t[k] for t in self.thetas]).alias("feature"))
        total = term(len(self.thetas[0]) - 1)
        for k in range(len(self.thetas[0]) - 2, -1, -1):
            came = self._less(self._written(total), True).withColumnRenamed("feature", "__c")
            total = term(k).join(came, "node_id").select("node_id", V.added("feature", "__c").alias("feature"))
        return total


def _mixed(arrays: list, scales: list[float]):
    """The weighted sum of arrays of one length."""
    out = F.transform(arrays[0], lambda x: x * scales[0])
    for a, s in zip(arrays[1:], scales[1:]):
        out = V.added(out, a, s)
    return out


class Relations:
    """Weighted sums over incoming edges ``src, dst, w, k`` of ``parts`` kinds, side by side, in one pass over the edges."""

    def __init__(self, weights: DataFrame, parts: int):
        self.tiles, self.parts = Tiles(weights), parts

    def apply(self, vectors: DataFrame) -> DataFrame:
        return self.tiles.sums_by_kind(vectors, self.parts)

    def adjoint(self, vectors: DataFrame) -> DataFrame:
        return self.tiles.sums_from_kinds(vectors, self.parts)


def mean_weights(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` of which sums are means over incoming edges."""
    deg = edges.groupBy("dst").agg(F.count("*").alias("__d"))
    return edges.join(deg, "dst").select("src", "dst", (1.0 / F.col("__d")).alias("w"))


@dataclass(frozen=True)
class Block:
    """Names of banks, and the widths of the dense layers after them."""

    banks: tuple[str, ...]
    widths: tuple[int, ...]


Weights = list[list[tuple[np.ndarray, np.ndarray]]]


def initial(blocks: list[Block], banks: dict, width: int, seed: int) -> Weights:
    """Weights drawn for rectified units; ``width`` is that of the nodes' features."""
    rng, out = np.random.default_rng(seed), []
    for block in blocks:
        width *= sum(banks[b].parts for b in block.banks)
        out.append(initial_layers(rng, width, block.widths))
        width = block.widths[-1]
    return out


def initial_layers(rng: np.random.Generator, width: int, widths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers = []
    for wide in widths:
        layers.append((rng.normal(0, np.sqrt(2 / max(width, 1)), (width, wide)), np.zeros(wide)))
        width = wide
    return layers


def forward(x: np.ndarray, layers, last: bool) -> list[np.ndarray]:
    """The input and what each dense layer makes of it; all but a network's last layer are rectified."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if last and i == len(layers) - 1 else np.maximum(z, 0))
    return out


def backward(states: list[np.ndarray], layers, d: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient by the input, and by all weights in a row, of ``d`` by the output."""
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        if not (last and i == len(layers) - 1):
            d = d * (states[i + 1] > 0)
        parts += [d.sum(axis=0), (states[i].T @ d).ravel()]
        d = d @ layers[i][0].T
    return d, np.concatenate(parts[::-1])


def flat(layers) -> np.ndarray:
    return np.concatenate([x.ravel() for w, b in layers for x in (w, b)])


def shaped(row: np.ndarray, like) -> list:
    out, at = [], 0
    for w, b in like:
        out.append((row[at : at + w.size].reshape(w.shape), row[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def judged(z: np.ndarray, batch: pa.RecordBatch, positive: float, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the weighted cross-entropy of training rows by the logits ``z``, and the summed loss and weight of both parts."""
    y = np.nan_to_num(batch.column("y").to_numpy(zero_copy_only=False).astype(float))
    part = np.array(batch.column("part").to_pylist(), object)
    p, w = _sigmoid(z), np.where(y == 1, positive, 1.0)
    cost = -w * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    loss = np.array([x for name in ("train", "val") for x in (cost[part == name].sum(), w[part == name].sum())])
    return (w * (p - y) * (part == "train") / total)[:, None], loss


#: Bounds of a learned logarithm of a variance.
LEAST_LOG, MOST_LOG = -4.0, 2.0


def fitted(z: np.ndarray, batch: pa.RecordBatch, total: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for a normal distribution: ``z`` holds means and logarithms of variances of the components of ``target``."""
    t = _matrix(batch.column("target"))
    d = t.shape[1]
    raw, apart = z[:, d:], t - z[:, :d]
    log = np.clip(raw, LEAST_LOG, MOST_LOG)
    square = apart**2 * np.exp(-log)
    part = np.array(batch.column("part").to_pylist(), object)
    cost = 0.5 * (log + square).sum(axis=1)
    loss = np.array([x for name in ("train", "val") for x in (cost[part == name].sum(), float((part == name).sum()))])
    free = (raw > LEAST_LOG) & (raw < MOST_LOG)
    grad = np.concatenate([-apart * np.exp(-log), 0.5 * (1 - square) * free], axis=1)
    return grad * (part == "train")[:, None] / total, loss


def gradient_rows(rows: list[tuple[int, np.ndarray]]) -> list[pa.Array]:
    """Rows without node: which block they are about, and the numbers."""
    return [pa.nulls(len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]


def summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """The sums of ``d`` over rows ``about, d``, by tree."""
    add = lambda df, *keys: df.groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v"))
    tree = add(rows.select("about", P.as_vector("d").alias("v"), F.pmod(F.spark_partition_id(), F.lit(TREE)).alias("part")), "about", "part")
    return {r.about: np.array(r.d) for r in add(tree, "about").select("about", vector_to_array("v").alias("d")).collect()}


@dataclass
class Network:
    """Blocks over ``nodes(node_id, feature, y, part)``: part is train, val or else; y may be null outside those.

    ``nodes`` is held by node in as many parts as ``spark.sql.shuffle.partitions`` and recomputed from its written table
    where an executor is lost. Rows of positives weigh negatives over positives. Features are brought to mean 0 and deviation 1
    unless ``scaled`` is false. With ``loss="normal"`` the network learns mean and variance of each component of ``nodes.target``
    instead of ``y``; the last layer has two outputs for each."""

    nodes: DataFrame
    blocks: list[Block]
    banks: dict[str, object]
    seed: int = 1
    scaled: bool = True
    loss: str = "label"
    history: list[tuple[float, float]] = field(default_factory=list)

    def __post_init__(self):
        plain = self._prepared()
        self._keep(self._gathered(0, plain, self.width).join(self.labels, "node_id"))
        self.weights = initial(self.blocks, self.banks, self.width, self.seed)

    def _keep(self, rows: DataFrame) -> None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.first = materialize(rows, "block-0").repartition(parts, "node_id").persist(StorageLevel.MEMORY_AND_DISK)

    def _prepared(self) -> DataFrame:
        """``node_id, feature`` with components of mean 0 and deviation 1; labels and their weights are kept."""
        scale = self.nodes.select(Summarizer.metrics("mean", "std").summary(P.as_vector("feature")).alias("s")).select(vector_to_array("s.mean").alias("m"), vector_to_array("s.std").alias("d")).first()
        self.width = len(scale.m or [])
        if not self.scaled:
            scale = Row(m=[0.0] * self.width, d=[1.0] * self.width)
        mean, std = (F.array(*[F.lit(float(x)) for x in v]) for v in (scale.m or [], [max(x, 1e-8) for x in scale.d or []]))
        plain = self.nodes.withColumn("feature", F.zip_with(F.zip_with(F.col("feature").cast("array<double>"), mean, lambda x, m: x - m), std, lambda x, s: x / s))
        told = ["target"] if self.loss == "normal" else []
        self.labels = plain.select("node_id", F.col("y").cast("double").alias("y"), "part", *told)
        count = {r.y: r.n for r in self.labels.where("part = 'train'").groupBy("y").agg(F.count("*").alias("n")).collect()}
        self.positive = count.get(0.0, 0) / max(count.get(1.0, 0), 1)
        self.rows = max(1.0, float(sum(count.values())) if told else count.get(0.0, 0) + self.positive * count.get(1.0, 0))
        return plain.select("node_id", "feature")

    def _gathered(self, at: int, vectors: DataFrame, width: int) -> DataFrame:
        """``node_id, x``: a block's banks side by side, zeros where nothing comes in."""
        out, banks = vectors.select("node_id", F.col("feature").alias("__own")), [self.banks[b] for b in self.blocks[at].banks]
        for k, bank in enumerate(banks):
            if isinstance(bank, Same):
                out = out.withColumn(f"__{k}", F.col("__own"))
            else:
                out = out.join(bank.apply(vectors).select("node_id", F.col("feature").alias(f"__{k}")), "node_id", "left")
        return out.select("node_id", F.concat(*[F.coalesce(f"__{k}", F.array_repeat(F.lit(0.0), width * bank.parts)) for k, bank in enumerate(banks)]).alias("x"))

    def _forward(self, rows: DataFrame, at: int, weights: Weights) -> DataFrame:
        layers, last = weights[at], at == len(self.blocks) - 1

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    out = forward(_matrix(batch.column("x")), layers, last)[-1]
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), _lists(out)], ["node_id", "feature"])

        return rows.select("node_id", "x").mapInArrow(run, "node_id long, feature array<double>")

    def _states(self, weights: Weights) -> list[DataFrame]:
        """What each block gathered: the first is kept, the others are written."""
        states = [self.first]
        for at in range(1, len(self.blocks)):
            hidden = self._forward(states[-1], at - 1, weights)
            found = self._gathered(at, hidden, self.blocks[at - 1].widths[-1])
            states.append(materialize(found.join(self.labels, "node_id"), f"block-{at}"))
        return states

    def _backward(self, rows: DataFrame, at: int, weights: Weights, inputs: bool = False) -> DataFrame:
        """``node_id, d`` by what the block gathered, and rows without node: a batch's gradient by the block's weights, and of
        the last block the summed loss of both parts. ``rows`` has ``back``, the gradient by the block's output, for
        all blocks but the last."""
        normal = self.loss == "normal"
        layers, last, positive, total, first = weights[at], at == len(self.blocks) - 1, self.positive, self.rows, at == 0 and not inputs

        def run(batches):
            sums, loss = None, np.zeros(4)
            for batch in batches:
                if not batch.num_rows:
                    continue
                states = forward(_matrix(batch.column("x")), layers, last)
                if last:
                    d, cost = fitted(states[-1], batch, total) if normal else judged(states[-1][:, 0], batch, positive, total)
                    loss += cost
                else:
                    d = _matrix(batch.column("back"))
                d, grad = backward(states, layers, d, last)
                sums = grad if sums is None else sums + grad
                if not first:
                    yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.nulls(len(d), pa.int32()), _lists(d)], ["node_id", "about", "d"])
            rows = [(at, sums)] * (sums is not None) + [(-1, loss)] * last
            if rows:
                yield pa.RecordBatch.from_arrays(gradient_rows(rows), ["node_id", "about", "d"])

        columns = ["node_id", "x", "y", "part", *["target"] * normal] if last else ["node_id", "x", "back"]
        return rows.select(*columns).mapInArrow(run, "node_id long, about int, d array<double>")

    def gradient(self, weights: Weights) -> tuple[list[np.ndarray], float, float]:
        """The gradient of the training loss by each block's weights, and the mean losses of both parts."""
        states, found, written = self._states(weights), [], []
        rows = states[-1]
        for at in range(len(self.blocks) - 1, -1, -1):
            back = self._backward(rows, at, weights)
            if at:
                back = materialize(back, "back")
                written.append(back)
                rows = self._sent_back(back, at, states[at - 1], self.blocks[at - 1].widths[-1])
            found.append(back.where("about is not null").select("about", "d"))
        all_ = found[0]
        for f in found[1:]:
            all_ = all_.unionByName(f)
        sums = summed(all_)
        discard(*states[1:], *written)
        loss = sums.get(-1, np.zeros(4))
        return [sums.get(k, np.zeros(flat(w).size)) for k, w in enumerate(weights)], loss[0] / max(loss[1], 1e-12), loss[2] / max(loss[3], 1e-12)

    def _sent_back(self, back: DataFrame, at: int, to: DataFrame, width: int) -> DataFrame:
        """Rows of ``to`` with ``back``: what a block's banks send back to the nodes, zeros where nothing comes."""
        total, first = None, 1
        for bank in [self.banks[b] for b in self.blocks[at].banks]:
            piece = back.where("node_id is not null").select("node_id", F.slice("d", first, width * bank.parts).alias("feature"))
            first += width * bank.parts
            came = bank.adjoint(piece).select("node_id", P.as_vector("feature").alias("v"))
            total = came if total is None else total.unionByName(came)
        came = total.groupBy("node_id").agg(Summarizer.sum(F.col("v")).alias("v")).select("node_id", vector_to_array("v").alias("__b"))
        return to.join(came, "node_id", "left").withColumn("back", F.coalesce("__b", F.array_repeat(F.lit(0.0), width)))

    def input_gradient(self) -> DataFrame:
        """``node_id, back``: the gradient of the training loss by each node's own feature."""
        states = self._states(self.weights)
        rows = states[-1]
        for at in range(len(self.blocks) - 1, 0, -1):
            back = materialize(self._backward(rows, at, self.weights), "back")
            rows = self._sent_back(back, at, states[at - 1], self.blocks[at - 1].widths[-1])
        back = materialize(self._backward(rows, 0, self.weights, inputs=True), "back")
        return self._sent_back(back, 0, self.labels, self.width).select("node_id", "back")

    def fit(self, epochs: int = 20, rate: float = 0.05, patience: int = 8) -> "Network":
        """Adam over all rows; the weights of the least validation loss are kept (of training, without validation rows)."""
        rows = [flat(w) for w in self.weights]
        mean, square, best, kept, stale = [np.zeros_like(r) for r in rows], [np.zeros_like(r) for r in rows], np.inf, rows, 0
        for t in range(1, epochs + 1):
            grads, train, val = self.gradient(self.weights)
            self.history.append((train, val))
            now = val or train
            if now < best:
                best, kept, stale = now, [r.copy() for r in rows], 0
            else:
                stale += 1
                if stale >= patience:
                    break
            for k, g in enumerate(grads):
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                rows[k] = rows[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
            self.weights = [shaped(r, w) for r, w in zip(rows, self.weights)]
        self.weights = [shaped(r, w) for r, w in zip(kept, self.weights)]
        return self

    def outputs(self) -> DataFrame:
        """``node_id, feature``: what the last layer says of all nodes."""
        return self._forward(self._states(self.weights)[-1], len(self.blocks) - 1, self.weights)

    def scores(self) -> DataFrame:
        """``node_id, p`` of all nodes."""
        out = self.outputs()
        return out.select("node_id", (1 / (1 + F.exp(-F.col("feature")[0]))).alias("p"))

    def close(self) -> None:
        self.first.unpersist()


def gcn_network(edges: DataFrame, nodes: DataFrame, hidden: int = 16, seed: int = 1) -> Network:
    """Two symmetrically normalised convolutions, edges with one loop at each node, and a head."""
    from .edges import reset_loops

    banks = {"gcn": Edges(materialize(P.normalized_edges(reset_loops(edges, nodes)), "weights"))}
    return Network(nodes, [Block(("gcn",), (hidden,)), Block(("gcn",), (hidden, 1))], banks, seed)


def gin_network(edges: DataFrame, nodes: DataFrame, hidden: int = 16, eps: float = 0.0, seed: int = 1) -> Network:
    """(1 + eps) times the own vector plus the neighbours' sum, through two dense layers, twice; and a head."""
    rows = edges.select("src", "dst", F.lit(1.0).alias("w")).unionByName(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0 + eps).alias("w")))
    banks = {"gin": Edges(materialize(rows, "weights"))}
    return Network(nodes, [Block(("gin",), (hidden, hidden)), Block(("gin",), (hidden, hidden, 1))], banks, seed)


def sage_network(edges: DataFrame, nodes: DataFrame, hidden: int = 16, seed: int = 1) -> Network:
    """The own vector beside the neighbours' mean, twice; and a head."""
    banks = {"own": Same(), "mean": Edges(materialize(mean_weights(edges), "weights"))}
    return Network(nodes, [Block(("own", "mean"), (hidden,)), Block(("own", "mean"), (hidden, 1))], banks, seed)


def rgcn_network(typed: DataFrame, nodes: DataFrame, etypes: list[str], hidden: int = 16, seed: int = 1) -> Network:
    """The own vector beside the neighbours' mean of each edge type, with weights of their own, twice; and a head."""
    kinds = F.create_map(*[F.lit(x) for k, e in enumerate(etypes) for x in (e, k)])
    rows = typed.where(F.col("etype").isin(etypes)).select("src", "dst", kinds[F.col("etype")].alias("k"))
    weights = rows.join(rows.groupBy("dst", "k").agg((1.0 / F.count("*")).alias("w")), ["dst", "k"])
    banks = {"own": Same(), "kinds": Relations(materialize(weights, "weights"), len(etypes))}
    return Network(nodes, [Block(("own", "kinds"), (hidden,)), Block(("own", "kinds"), (hidden, 1))], banks, seed)


def wavelet_network(edges: DataFrame, nodes: DataFrame, hidden: int = 16, degree: int = 2, seed: int = 1) -> Network:
    """Dense layers, then the band-pass filters of a Bernstein basis side by side over what they make, and a head."""
    from ..functions.vectors import bernstein_theta

    weights = materialize(P.normalized_edges(edges), "weights")
    banks = {"own": Same(), "bands": Filters(weights, bernstein_theta(degree))}
    return Network(nodes, [Block(("own",), (hidden, hidden)), Block(("bands",), (hidden, 1))], banks, seed)


def feature_network(edges: DataFrame, nodes: DataFrame, labels: int, hidden: int = 16, seed: int = 1) -> Network:
    """Features given labels: a node's own label and the shares of labels among its neighbours tell mean and variance of each
    component. ``nodes(node_id, feature, label, part)``, labels from 0."""
    one_hot = F.array(*[(F.col("label") == k).cast("double") for k in range(labels)])
    width = nodes.select(F.size("feature")).first()[0]
    rows = nodes.select("node_id", one_hot.alias("feature"), F.lit(0).alias("y"), "part", F.col("feature").cast("array<double>").alias("target"))
    banks = {"own": Same(), "mean": Edges(materialize(mean_weights(edges), "weights"))}
    return Network(rows, [Block(("own", "mean"), (hidden, 2 * width))], banks, seed, scaled=False, loss="normal")


def drawn_features(told: DataFrame, seed: int) -> DataFrame:
    """``node_id, feature``: a draw from each node's means and clamped logarithms of variances, the first and second half of
    ``told(node_id, feature)``. Normal numbers come from hashes, so draws repeat."""
    d = F.expr("size(feature) div 2").cast("int")
    u = lambda salt, i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "node_id", i), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda i: F.sqrt(-2 * F.log(u(1, i))) * F.cos(6.283185307179586 * u(2, i))
    log = lambda i: F.greatest(F.least(F.element_at("feature", i + d + 1), F.lit(MOST_LOG)), F.lit(LEAST_LOG))
    value = lambda i: F.element_at("feature", i + 1) + F.exp(log(i) / 2) * normal(i)
    return told.select("node_id", F.transform(F.sequence(F.lit(0), d - 1), value).alias("feature"))
