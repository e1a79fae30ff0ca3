"""Predictors over node tables: pyspark.ml estimators on raw or propagated features, link scorers,
and a small network trained by trials."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from . import propagate as P
from .tiles import EDGES, PairTiles, matrix, on_pairs

#: Name of a predictor to what builds its estimator.
REGISTRY: dict[str, Callable] = {
    "rf": lambda seed=1: RandomForestClassifier(featuresCol="vec", labelCol="y", weightCol="w", numTrees=50, maxDepth=6, seed=seed),
    "gbt": lambda seed=1: GBTClassifier(featuresCol="vec", labelCol="y", weightCol="w", maxIter=15, maxDepth=4, seed=seed),
    "lr": lambda seed=1: LogisticRegression(featuresCol="vec", labelCol="y", weightCol="w", maxIter=50, regParam=1e-3),
    "mlp": lambda seed=1: MultilayerPerceptronClassifier(featuresCol="vec", labelCol="y", layers=[0, 16, 2], maxIter=60, seed=seed),
    "svm": lambda seed=1: LinearSVC(featuresCol="vec", labelCol="y", weightCol="w", maxIter=30, regParam=1e-3),
}


def weighted(train: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Positives weigh negatives over positives."""
    c = (train if told is None else told).agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    return train.withColumn("w", F.when(F.col("y") == 1, float((c.n - (c.p or 0)) / max(c.p or 0, 1))).otherwise(1.0))


def as_vectors(rows: DataFrame, column: str = "feature") -> DataFrame:
    return rows.withColumn("vec", array_to_vector(F.col(column).cast("array<double>")))


def fit_predict(name: str, train: DataFrame, test: DataFrame, column: str = "feature", seed: int = 1, told: DataFrame | None = None) -> DataFrame:
    """``test`` with a score ``p``: the probability of 1, or the margin where there is none. A network has as
    many inputs as the feature has components; where rows cannot be weighed, positives are repeated. ``told``: a table of the same ``y``
    that is cheaper to count."""
    estimator, rows = REGISTRY[name](seed), weighted(train, told)
    if name == "mlp":
        width = rows.select(F.size(column)).first()[0]
        estimator = estimator.setLayers([width, *estimator.getLayers()[1:]])
        rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round("w").cast("int")))).alias("__copy")).drop("__copy")
    model = estimator.fit(as_vectors(rows, column))
    out = model.transform(as_vectors(test, column))
    score = vector_to_array("probability")[1] if "probability" in out.columns else vector_to_array("rawPrediction")[1]
    return out.withColumn("p", score).drop("vec", "rawPrediction", "probability", "prediction")


def random_search(rows: DataFrame, space: dict[str, dict[str, list]], trials: int, seed: int) -> DataFrame:
    """``model, config, score, best, test_score`` of ``trials`` drawn settings for each model: fitted on the training rows of ``node_id,
    feature, y, role``, compared by the area under the curve on validation rows; the best one is scored on test rows."""
    from .metrics import rank_metrics

    area = lambda found: rank_metrics(found.select(F.col("node_id").alias("id"), "y", "p")).first().auroc
    part = {r: materialize(weighted(rows.where(F.col("role") == r)) if r == "train" else rows.where(F.col("role") == r), r) for r in ("train", "val", "test")}
    rng, out = np.random.default_rng(seed), []
    for name, values in space.items():
        best = None
        for _ in range(trials):
            config = {p: v[int(rng.integers(len(v)))] for p, v in values.items()}
            estimator = REGISTRY[name](seed % 1000)
            model = estimator.copy({estimator.getParam(p): v for p, v in config.items()}).fit(as_vectors(part["train"]))
            judged = lambda t, m=model: m.transform(as_vectors(t)).withColumn("p", vector_to_array("probability")[1])
            score = area(judged(part["val"]))
            row = [name, json.dumps(config, sort_keys=True), float(score), 0, None]
            out.append(row)
            if best is None or score > best[0]:
                best = (score, row, judged)
        best[1][3], best[1][4] = 1, float(area(best[2](part["test"])))
    return rows.sparkSession.createDataFrame(out, "model string, config string, score double, best int, test_score double")


def hop_features(edges: DataFrame, nodes: DataFrame, k: int, normalized: bool = False) -> DataFrame:
    """Nodes whose feature is x followed by its propagations, as tree ensembles on graphs use them."""
    if normalized:
        w, terms = P.normalized_edges(edges), [nodes.select("node_id", "feature")]
        for _ in range(k):
            terms.append(materialize(P.smoothed(w, terms[-1]), "smoothed"))
    else:
        terms = P.hops(edges, nodes, k)
    out = nodes.withColumn("feature", F.col("feature").cast("array<double>")).withColumn("__n", F.size("feature"))
    for t in terms[1:]:
        out = out.join(t.select("node_id", F.col("feature").alias("__h")), "node_id", "left").withColumn("feature", F.concat("feature", F.coalesce("__h", F.array_repeat(F.lit(0.0), F.col("__n"))))).drop("__h")
    return out.drop("__n")


def sgc(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Nodes with S^k x."""
    w, now = P.normalized_edges(edges), nodes.select("node_id", "feature")
    for _ in range(k):
        now = materialize(P.smoothed(w, now), "smoothed")
    return nodes.drop("feature").join(now, "node_id")


def pair_features(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the products of both ends' features. Pairs meet the vectors of both ends in tiles, which are written: no vector travels
    for each pair, and trainers that read the products several times shuffle nothing."""
    return PairTiles(pairs, _written(nodes)).products()


def logistic_pairs(train: DataFrame, nodes: DataFrame, test: DataFrame, others: DataFrame | None = None, penalty: float = 1e-3, steps: int = 50) -> DataFrame:
    """``test`` pairs with ``p`` by the logistic regression of ``REGISTRY`` on the products of both ends' features: of ``nodes`` for ``train``, of
    ``others`` (else ``nodes``) for ``test``. The same loss and penalty, solved by Newton's steps over packed tiles: Spark's solver keeps a
    row of all products for each pair, here a pass gives sums as large as the products' second moments. Where only one class is
    met, its chance is 1."""
    from .training import summed

    c = train.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    if not c.n:
        raise ValueError("no pair to train on")
    nodes = _written(nodes)
    ends = nodes if others is None else _written(others)
    if c.p in (0, c.n):
        return on_pairs(test, ends, lambda x, y: pa.array(np.full(len(x), float(c.p > 0))), "double", "p", EDGES)
    heavy, tiles = float((c.n - c.p) / c.p), PairTiles(train, nodes)

    def told(kernel):
        def run(pieces):
            total = None
            for pairs, x, y in pieces:
                of = pairs.column("y").to_numpy()
                row = kernel(x * y, of.astype(float), np.where(of == 1, heavy, 1.0))
                total = row if total is None else total + row
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["about", "d"])

        return summed(tiles.each(run, "about int, d array<double>", whole=True)).get(0)

    moments = told(lambda z, y, w: np.concatenate([[w.sum(), w @ w], w @ z, w @ (z * z)]))
    if moments is None:
        raise ValueError("no pair has vectors at both ends")
    (weight, squares), (mean, square) = moments[:2], np.split(moments[2:] / moments[0], 2)
    spread = np.sqrt(np.maximum(square - mean * mean, 0) * weight / max(weight - squares / weight, 1e-300))
    scale = np.where(spread > 1e-12 * np.sqrt(square + 1e-300), 1 / np.where(spread > 0, spread, 1), 0.0)
    at, width = np.zeros(len(mean) + 1), len(mean) + 1
    ridge = np.append(np.full(width - 1, penalty), 0.0)
    best, move = None, None

    def judged(at):
        def kernel(z, y, w):
            z = np.column_stack([(z - mean) * scale, np.ones(len(z))])
            m = z @ at
            q = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
            loss = w @ (np.logaddexp(0, m) - y * m)
            return np.concatenate([[loss], z.T @ (w * (q - y)), ((z.T * (w * q * (1 - q))) @ z).ravel()])

        row = told(kernel) / weight
        return row[0] + ridge @ (at * at) / 2, row[1:width + 1] + ridge * at, row[width + 1:].reshape(width, width) + np.diag(ridge)

    for _ in range(steps):
        loss, slope, curve = judged(at)
        if best is not None and loss > best[0] + 1e-12:  # too far: half the way
            move = move / 2
            at = best[1] - move
            if np.abs(move).max() < 1e-9:
                at = best[1]
                break
            continue
        done = best is not None and best[0] - loss <= 1e-10 * max(abs(loss), 1e-12)
        best = loss, at
        if done:
            break
        move = np.linalg.lstsq(curve, slope, rcond=None)[0]
        at = at - move
    at = best[1]
    weights = at[:-1] * scale
    start = at[-1] - mean @ weights
    score = lambda x, y: pa.array(1 / (1 + np.exp(-np.clip((x * y) @ weights + start, -500, 500))) if len(x) else np.zeros(0))
    return on_pairs(test, ends, score, "double", "p", EDGES)


def dot_scores(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, y, p``: the sigmoid of the dot product of both ends."""
    score = lambda x, y: pa.array(1 / (1 + np.exp(-(x * y).sum(axis=1))))
    return on_pairs(pairs, _written(nodes), score, "double", "p", EDGES)


def _written(nodes: DataFrame) -> DataFrame:
    """What trainers read several times is computed once."""
    return nodes if hasattr(nodes, "written_to") else materialize(nodes.select("node_id", "feature"), "ends")


def train_trials(rows: DataFrame, hidden: int = 16, epochs: int = 60, rate: float = 0.05, patience: int = 20) -> DataFrame:
    """``trial, node_id, y, p`` of the test rows: a two-layer network for each trial of
    ``trial, node_id, feature, y, role``, full-batch Adam on weighted cross-entropy, the weights of the
    best validation loss kept. All trials are trained in the same passes over the rows, batch by batch; gradients are
    summed by tree. With propagated features it is a graph convolution whose smoothing has been done beforehand."""
    from .training import summed

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = materialize(rows.select(F.col("trial").cast("int").alias("trial"), "node_id", F.col("feature").cast("array<double>").alias("feature"), F.col("y").cast("int").alias("y"), "role"), "trials")
    moments = Summarizer.metrics("mean", "variance").summary(F.col("vec")).alias("m")
    told = as_vectors(written.where("role = 'train'")).groupBy("trial").agg(moments, F.sum("y").alias("p"), F.count("*").alias("n"))
    scale, trials = {}, {}
    for r in told.select("trial", vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"), "p", "n").collect():  # a row for each trial
        scale[r.trial] = np.array(r["mean"]), np.sqrt(np.array(r["var"]) * (r.n - 1) / r.n) + 1e-8, (r.n - r.p) / max(r.p, 1), r.n
        rng, width = np.random.default_rng(3407 + r.trial), len(r["mean"])
        par = [rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        trials[r.trial] = _Trial(par)
    data = written.repartition(parts, "trial", "node_id").persist(StorageLevel.MEMORY_AND_DISK)
    forward = lambda x, p: (h := np.maximum(x @ p[0] + p[1], 0), 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))))

    def by_trial(batches, asked):
        for batch in batches:
            trial = batch.column("trial").to_numpy()
            for k in np.unique(trial) if batch.num_rows else []:
                if k in asked:
                    mine = batch.filter(pa.array(trial == k))
                    mean, std, weight, n = scale[k]
                    yield int(k), mine, (matrix(mine.column("feature")) - mean) / std, weight, n

    def told_by(asked):
        def run(batches):
            sums = {}
            for k, mine, x, weight, n in by_trial(batches, asked):
                role, y = np.array(mine.column("role").to_pylist(), object), mine.column("y").to_numpy().astype(float)
                tr, va, w, p = role == "train", role == "val", np.where(y == 1, weight, 1.0), asked[k]
                h, q = forward(x, p)
                e = (q - y)[tr] * w[tr] / n
                back = np.outer(e, p[2]) * (h[tr] > 0)
                cost = -(w * (y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12)))[va].sum()
                row = np.concatenate([(x[tr].T @ back).ravel(), back.sum(0), h[tr].T @ e, [e.sum(), cost, va.sum()]])
                sums[k] = sums.get(k, 0) + row
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["about", "d"])

        return summed(data.mapInArrow(run, "about int, d array<double>"))

    for t in range(epochs + 1):  # a pass judges the weights of the step before and gives the next one's gradient
        asked = {k: s.par for k, s in trials.items() if s.open}
        if not asked:
            break
        for k, row in told_by(asked).items():
            if t:
                trials[k].judge(row[-2] / row[-1] if row[-1] else -t, patience)
            trials[k].step(row[:-2], t + 1, rate)
    best = {k: s.kept for k, s in trials.items()}

    def scored(batches):
        for k, mine, x, _, _ in by_trial(batches, best):
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in ("trial", "node_id", "y")), pa.array(forward(x, best[k])[1])], ["trial", "node_id", "y", "p"])

    out = materialize(data.where("role = 'test'").mapInArrow(scored, "trial int, node_id long, y int, p double"), "scored")
    data.unpersist()
    discard(written)
    return out


class _Trial:
    """One trial's weights, the moments of Adam, and the best weights so far."""

    def __init__(self, par: list[np.ndarray]):
        self.par, self.best, self.kept, self.stale, self.open = par, np.inf, par, 0, True
        self.mean, self.square = np.zeros(sum(p.size for p in par)), np.zeros(sum(p.size for p in par))

    def judge(self, loss: float, patience: int) -> None:
        if loss < self.best:
            self.best, self.kept, self.stale = loss, self.par, 0
        else:
            self.stale += 1
            self.open = self.stale <= patience

    def step(self, grad: np.ndarray, t: int, rate: float) -> None:
        self.mean, self.square = 0.9 * self.mean + 0.1 * grad, 0.999 * self.square + 0.001 * grad * grad
        move = rate * (self.mean / (1 - 0.9**t)) / (np.sqrt(self.square / (1 - 0.999**t)) + 1e-8)
        cuts = np.cumsum([p.size for p in self.par])[:-1]
        self.par = [p - m.reshape(p.shape) for p, m in zip(self.par, np.split(move, cuts))]
