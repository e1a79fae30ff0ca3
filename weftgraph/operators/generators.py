"""Synthetic graphs, sequences and features; feature quantisation with group sizes."""

from __future__ import annotations

from secrets import token_hex

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import hashed
from ..storage import discard, materialize
from .clustering import constrained_kmeans
from .neighbors import anonymity
from .order import running_sums


def uniform(seed: int, *columns: str):
    """A fixed number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0x165667B19E3779F9)
    return h ^ h >> np.uint64(32)


def uniform_of(seed: int, *columns: np.ndarray) -> np.ndarray:
    """The same numbers as ``uniform`` for whole numbers of 64 bits, in a task: XXH64 of the seed, then of each column, each seeded by the one before."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    long = lambda h, x: _mixed(turned(h + five + np.uint64(8) ^ turned(x * two, 31) * one, 27) * one + four)
    short = -(1 << 31) <= seed < 1 << 31
    h, x = np.full(1, 42, np.uint64), np.array([seed & (0xFFFFFFFF if short else 0xFFFFFFFFFFFFFFFF)], np.uint64)
    h = _mixed(turned(h + five + np.uint64(4) ^ x * one, 23) * two + three) if short else long(h, x)
    for c in columns:
        h = long(h, np.asarray(c, np.int64).view(np.uint64))
    return (h & np.uint64((1 << 52) - 1)).astype(float) / float(1 << 52)


def grid_graph(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    cell = spark.range(rows * cols).select(F.col("id").alias("u"), F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"))
    right = cell.where(F.col("j") < cols - 1).select("u", (F.col("u") + 1).alias("v"))
    return right.unionByName(cell.where(F.col("i") < rows - 1).select("u", (F.col("u") + cols).alias("v")))


def random_graph(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """Each pair with probability ``p``. Rows draw their gaps between entries, so work follows the edges and not the pairs."""
    expected = max(1, int(n * p) + 10)

    def draw(batches):
        for batch in batches:
            for i in batch.id:
                rng = np.random.default_rng((seed, int(i)))
                at, cols = -1, []
                while True:
                    at += rng.geometric(p) if p < 1 else 1
                    if at >= i:
                        break
                    cols.append(at)
                yield pd.DataFrame({"u": np.array(cols, np.int64), "v": np.full(len(cols), i, np.int64)})

    return spark.range(n).repartition(max(1, n * expected // 1_000_000 + 1)).mapInPandas(draw, "u long, v long") if p > 0 else spark.createDataFrame([], "u long, v long")


def grown_graphs(spark: SparkSession, sizes: list[int], kind: str, seed: int) -> DataFrame:
    """``graph_id, u, v``: preferential attachment ("ba", two edges a node) or "lobster" graphs, one a task."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        g, n = int(part.graph_id.iloc[0]), int(part.n.iloc[0])
        rng, edges = np.random.default_rng((seed, g)), []
        if kind == "ba":
            ends = [0, 1]
            edges.append((0, 1))
            for v in range(2, n):
                chosen: set[int] = set()
                while len(chosen) < 2:
                    chosen.add(int(ends[rng.integers(len(ends))]))
                for u in sorted(chosen):
                    edges.append((u, v))
                    ends += [u, v]
        else:
            spine = max(1, n // 3)
            edges = [(i, i + 1) for i in range(spine - 1)]
            depth, near = [0] * spine, list(range(spine))
            for v in range(spine, n):
                u = near[rng.integers(len(near))]
                edges.append((u, v))
                depth.append(depth[u] + 1)
                if depth[v] < 2:
                    near.append(v)
        return pd.DataFrame({"graph_id": g, "u": [a for a, _ in edges], "v": [b for _, b in edges]})

    return spark.createDataFrame(list(enumerate(sizes)), "graph_id long, n long").groupBy("graph_id").applyInPandas(one, "graph_id long, u long, v long")


def lobster_graphs(sizes: DataFrame, seed: int) -> DataFrame:
    """``graph_id, u, v`` for ``graph_id, n``: a spine of a third of the nodes, half of the others hanging from it at a hashed place, and the
    rest from those. Every edge is worked out by itself, so a graph may have any size."""
    spine, near = F.greatest(F.lit(1), F.expr("n div 3")), F.expr("(n - greatest(1, n div 3) + 1) div 2")
    rows = sizes.where("n > 1").select("graph_id", spine.alias("s"), near.alias("k"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("v"))
    draw = F.conv(F.substring(hashed(seed, "graph_id", "v"), 1, 8), 16, 10).cast("long")
    parent = F.when(F.col("v") < F.col("s"), F.col("v") - 1).when(F.col("v") < F.col("s") + F.col("k"), draw % F.col("s")).otherwise(F.col("s") + draw % F.col("k"))
    return rows.select("graph_id", parent.cast("long").alias("u"), "v")


def class_gaussian(nodes: DataFrame, wanted: DataFrame, seed: int, low: float = -4.0, high: float = 2.0) -> DataFrame:
    """``node_id, dim, v`` for ``wanted(node_id, label)``: drawn from each label's mean and variance of
    each component, the logarithm of the variance clamped."""
    rows = nodes.select("label", F.posexplode("feature").alias("dim", "v"))
    stats = rows.groupBy("label", "dim").agg(F.avg("v").alias("m"), F.log(F.greatest(F.var_pop("v"), F.lit(1e-12))).alias("lv"))
    drawn = wanted.join(F.broadcast(stats), "label")
    a, b = F.greatest(uniform(seed, "node_id", "dim"), F.lit(1e-12)), uniform(seed + 1, "node_id", "dim")
    normal = F.sqrt(-2 * F.log(a)) * F.cos(6.283185307179586 * b)
    return drawn.select("node_id", F.col("dim").cast("long").alias("dim"), (F.col("m") + F.exp(F.least(F.greatest("lv", F.lit(low)), F.lit(high)) / 2) * normal).alias("v"))


def token_model(sequences: DataFrame, labels: DataFrame, fanout: int) -> DataFrame:
    """``label, parent, token, n``: how often a token hangs below a parent's token, by the root's label. ``tokens[0]`` is the start."""
    rows = sequences.join(labels, "root").select("label", "tokens", F.posexplode("tokens").alias("i", "token")).where("i > 0")
    parent = F.element_at("tokens", F.when(F.col("i") == 1, 1).otherwise(F.expr(f"(i - 2) div {fanout} + 2").cast("int")))
    return rows.select("label", parent.alias("parent"), "token").groupBy("label", "parent", "token").agg(F.count("*").alias("n"))


def generate_tokens(model: DataFrame, roots: DataFrame, depth: int, fanout: int, start: int, empty: int, seed: int) -> DataFrame:
    """``root, tokens`` for ``roots(root, label)``, level by level: each slot draws from its parent's
    distribution by inverse cumulated counts. A root is never empty; below an empty slot all is empty."""
    run = W.partitionBy("label", "parent").orderBy("token")
    steps = model.withColumn("hi", F.sum("n").over(run.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(W.partitionBy("label", "parent")))
    steps = steps.select("label", "parent", "token", ((F.col("hi") - F.col("n")) / F.col("all")).alias("a"), (F.col("hi") / F.col("all")).alias("b"))
    first = model.where((F.col("parent") == start) & (F.col("token") != empty))
    top = W.partitionBy("label").orderBy("token")
    firsts = first.withColumn("hi", F.sum("n").over(top.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(W.partitionBy("label")))
    firsts = firsts.select("label", "token", ((F.col("hi") - F.col("n")) / F.col("all")).alias("a"), (F.col("hi") / F.col("all")).alias("b"))
    level = roots.withColumn("pos", F.lit(0).cast("long")).withColumn("u", uniform(seed, "root", "pos")).join(F.broadcast(firsts), "label").where("u >= a and u < b").select("root", "label", "pos", "token")
    out = level
    for _ in range(depth):
        slots = level.select("root", "label", F.col("token").alias("parent"), F.explode(F.sequence(F.col("pos") * fanout + 1, F.col("pos") * fanout + fanout)).alias("pos")).withColumn("u", uniform(seed, "root", "pos"))
        level = slots.join(F.broadcast(steps), ["label", "parent"], "left").where("token is null or (u >= a and u < b)").select("root", "label", "pos", F.coalesce("token", F.lit(empty)).alias("token"))
        out = out.unionByName(level)
    return out.groupBy("root").agg(F.concat(F.array(F.lit(start).cast("long")), F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"])).alias("tokens"))


def row_tree_model(decisions: DataFrame) -> DataFrame:
    """``size_class, p_left, p_right``: how often a range of 2^size_class columns has entries in its halves, given that it has any."""
    return decisions.groupBy(F.floor(F.log2(F.col("hi") - F.col("lo"))).cast("int").alias("size_class")).agg(F.avg("has_left").alias("p_left"), (F.sum(F.expr("has_left * has_right")) / F.greatest(F.sum("has_left"), F.lit(1))).alias("p_right"))


def row_tree_model_of(entries: DataFrame) -> DataFrame:
    """``row_tree_model`` of the decisions of ``row_id, col_id`` (column below row), which are counted where a row's entries lie
    side by side and are not sent themselves."""

    def counted(row: np.ndarray, col: np.ndarray) -> pa.RecordBatch:
        lo, hi, found = np.zeros(len(row), np.int64), row.copy(), []
        while len(row):
            open_ = hi - lo > 1
            row, col, lo, hi = row[open_], col[open_], lo[open_], hi[open_]
            if not len(row):
                break
            mid = (lo + hi) // 2
            left = col < mid
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lo[1:] != lo[:-1])))
            has_left, has_right = np.logical_or.reduceat(left, first), np.logical_or.reduceat(~left, first)
            found.append(np.column_stack([(hi - lo)[first], has_left, has_left & has_right]))
            lo, hi = np.where(left, lo, mid), np.where(left, mid, hi)
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        size, at = np.unique(found[:, 0], return_inverse=True)
        sums = [np.bincount(at, found[:, c], len(size)).astype(np.int64) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(size), pa.array(np.bincount(at, minlength=len(size)).astype(np.int64)), *map(pa.array, sums)], ["size", "n", "l", "b"])

    def walk(batches):
        row, col = np.zeros(0, np.int64), np.zeros(0, np.int64)  # entries of a row that may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                row, col = (np.append(x, batch.column(k).to_numpy()) for k, x in ((0, row), (1, col)))
                whole = np.searchsorted(row, row[-1])
                yield counted(row[:whole], col[:whole])
                row, col = row[whole:], col[whole:]
        yield counted(row, col)

    rows = entries.select(F.col("row_id").cast("long"), F.col("col_id").cast("long")).where("row_id is not null and col_id is not null")
    told = rows.repartition("row_id").sortWithinPartitions("row_id", "col_id").mapInArrow(walk, "size long, n long, l long, b long")
    sums = told.groupBy(F.floor(F.log2("size")).cast("int").alias("size_class")).agg(*[F.sum(c).alias(c) for c in "nlb"])
    return sums.select("size_class", (F.col("l") / F.col("n")).alias("p_left"), (F.col("b") / F.greatest("l", F.lit(1))).alias("p_right"))


#: Levels of halving between written tables.
LEVELS = 6


def generate_rows(model: DataFrame, rows: DataFrame, seed: int, bounds: DataFrame | None = None) -> DataFrame:
    """``row_id, col_id``: each row with entries halves its columns and draws which halves have any
    (the right one must if the left has none), until single columns are left, however wide rows are. The model, a row for each
    power of two, is part of the plan, so halving sends nothing.

    ``bounds(row_id, lb, ub)`` keeps each row's number of entries between its bounds: the left half gets
    what the right cannot hold at least and the upper bound at most, a draw decides how many, and the
    right half gets the rest; a half without room is empty, one with a least number is not."""
    limited = bounds is not None
    start = rows.where("row_id > 0").select("row_id", F.lit(0).cast("long").alias("lo"), F.col("row_id").alias("hi"))
    if limited:
        ub = F.least(F.coalesce("ub", F.col("hi")), F.col("hi"))
        start = start.join(bounds, "row_id", "left").select("row_id", "lo", "hi", F.least(F.coalesce("lb", F.lit(0)), ub).cast("long").alias("lb"), ub.cast("long").alias("ub"))
        # how many entries a row has, fixed at the top, so that no half needs to know what another drew
        spread = (F.col("ub") - F.greatest("lb", F.lit(1)) + 1).cast("double")
        start = start.where("ub > 0").withColumn("want", (F.greatest("lb", F.lit(1)) + F.floor(uniform(seed, "row_id") * spread)).cast("long")).drop("lb", "ub")
    shares = {r.size_class: (r.p_left, r.p_right) for r in model.collect()}
    share = lambda k: F.coalesce(F.element_at(F.array(*[F.lit(float(x if (x := shares.get(c, (None, None))[k]) is not None else 0.5)) for c in range(64)]), F.floor(F.log2(F.col("hi") - F.col("lo"))).cast("int") + 1), F.lit(0.5))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live, before = materialize(start.repartition(parts, "row_id"), "rows"), None
    last = live.agg(F.max("hi")).first()[0] or 1
    for depth in range((last - 1).bit_length()):
        left = uniform(seed + depth, "row_id", "lo", "hi") < share(0)
        right = (uniform(seed + depth + 1000, "row_id", "lo", "hi") < share(1)) | ~left
        mid = F.expr("(lo + hi) div 2")
        whole = F.array(F.struct("lo", "hi", *["want"] * limited))
        if limited:
            room_left, room_right = mid - F.col("lo"), F.col("hi") - mid
            least, most = F.greatest(F.col("want") - room_right, F.lit(0)), F.least(F.col("want"), room_left)
            drawn = least + F.floor(uniform(seed + depth + 2000, "row_id", "lo", "hi") * (most - least + 1).cast("double")).cast("long")
            own = F.when(left & ~right, most).when(~left, least).otherwise(drawn).cast("long")
            halves = F.filter(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi"), own.alias("want")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"), (F.col("want") - own).alias("want"))), lambda x: x["want"] > 0)
        else:
            halves = F.filter(F.array(F.when(left, F.struct(F.col("lo").alias("lo"), mid.alias("hi"))), F.when(right, F.struct(mid.alias("lo"), F.col("hi").alias("hi")))), lambda x: x.isNotNull())
        live = live.select("row_id", F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(whole)).alias("h")).select("row_id", "h.*")
        if depth % LEVELS == LEVELS - 1:
            live = materialize(live.repartition(parts, "row_id", "lo"), "rows")
            discard(before)
            before = live
    return live.select("row_id", F.col("lo").alias("col_id"))


def quantize(nodes: DataFrame, clusters: int, components: int, k: int, sample: int = 5000, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Centres, assignment and group sizes: principal components of a bounded sample (centred first), then k-means of all
    nodes there in which each of exactly ``clusters`` groups (or as many as the nodes suffice for) has ``k`` nodes or more, and
    centres taken back. Fewer than ``k`` nodes are an error."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = nodes.select("node_id", array_to_vector(F.col("feature").cast("array<double>")).alias("vec"))
    part = data.orderBy(F.xxhash64("node_id"), "node_id").limit(sample)
    centred = StandardScaler(inputCol="vec", outputCol="c", withMean=True, withStd=False).fit(part)
    pca = PCA(k=components, inputCol="c", outputCol="z").fit(centred.transform(part))
    clusters = min(clusters, nodes.count() // k)
    if not clusters:
        raise ValueError(f"fewer than {k} nodes")
    low = materialize(pca.transform(centred.transform(data)).select("node_id", vector_to_array("z").alias("feature")), "components")
    found, assigned = constrained_kmeans(low, clusters, k, seed=seed)
    basis, mean = pca.pc.toArray(), centred.mean.toArray()
    rows = [(r.cid, [float(x) for x in basis @ r.feature + mean]) for r in found.collect()]  # a row for each centre
    centres = nodes.sparkSession.createDataFrame(rows, "cid int, feature array<double>")
    return centres, assigned.select("node_id", "cid"), anonymity(assigned, k)


def private_means(assigned: DataFrame, nodes: DataFrame, epsilon: float, secret: str | None = None, bound: float = 1.0, centres: DataFrame | None = None) -> DataFrame:
    """``cid, feature``: centres of noisy sums over noisy counts, features clipped to ``bound``. Half of the
    budget goes to the counts and half to the sums, which it is split among by their number, as one
    node changes each of them by ``2 * bound`` at most. The Laplace noise is drawn from a hash of a
    ``secret`` (a new random one by default), so who does not know it cannot take the noise off. Every group of
    ``centres(cid)``, by default those with nodes, gets a row: one without nodes is noise only, so that its absence tells nothing."""
    secret = secret or token_hex(32)
    width = nodes.select(F.size("feature")).first()[0]
    rows = assigned.join(nodes.select("node_id", "feature"), "node_id")
    every = (assigned if centres is None else centres).select("cid").distinct()
    draw = lambda scale, *columns: _laplace(F.sha2(F.concat_ws(":", F.lit(secret), *[c.cast("string") for c in columns]), 256), scale)
    counts = every.join(rows.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left").na.fill(0, ["n"]).select("cid", F.greatest(F.col("n") + draw(2 / epsilon, F.col("cid"), F.lit("n")), F.lit(1.0)).alias("n"))
    clipped = F.greatest(F.least(F.col("v").cast("double"), F.lit(bound)), F.lit(-bound))
    sums = rows.select("cid", F.posexplode("feature").alias("dim", "v")).groupBy("cid", "dim").agg(F.sum(clipped).alias("s"))
    slots = every.select("cid", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dim"))
    sums = slots.join(sums, ["cid", "dim"], "left").na.fill(0.0, ["s"])
    noisy = sums.withColumn("s", F.col("s") + draw(2 * width * 2 * bound / epsilon, F.col("cid"), F.col("dim"))).join(counts, "cid")
    return noisy.withColumn("v", F.col("s") / F.col("n")).groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("feature"))


def _laplace(digest, scale: float):
    """Laplace noise from the first 52 bits of a hexadecimal digest."""
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) - 0.5
    return -F.signum(u) * F.log1p(-2 * F.abs(u)) * scale


def as_graph(pairs: DataFrame, n_nodes: int, width: int, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes(node_id, feature, label)`` and ``edges(src, dst)`` of generated ``u, v``: both directions, isolated
    nodes too; features (``node_id, feature, label``) where given, else zeros."""
    ids = pairs.sparkSession.range(n_nodes).withColumnRenamed("id", "node_id")
    zeros = F.array_repeat(F.lit(0.0), width)
    if features is None:
        nodes = ids.select("node_id", zeros.alias("feature"), F.lit(0).alias("label"))
    else:
        nodes = ids.join(features, "node_id", "left").select("node_id", F.coalesce(F.col("feature").cast("array<double>"), zeros).alias("feature"), F.coalesce("label", F.lit(0)).alias("label"))
    both = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(pairs.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    return nodes, both.where("src <> dst").distinct()


def drawn_sizes(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """``draw, n``: node counts drawn from those of ``graph_id, n``: the size at a hashed place in their order."""
    counted = sizes.groupBy("n").agg(F.count("*").alias("c"))
    run = running_sums(counted, ["n"], hi=F.col("c"))
    total = sizes.count()
    place = F.conv(F.substring(hashed(seed, "id"), 1, 8), 16, 10).cast("long") % max(total, 1)
    picks = sizes.sparkSession.range(draws).select(F.col("id").alias("draw"), place.alias("k"))
    return picks.join(F.broadcast(run), (F.col("k") < F.col("hi")) & (F.col("k") >= F.col("hi") - F.col("c"))).select("draw", "n")


def tempered(weights: DataFrame, temperature: float, seed: int, *keys: str) -> DataFrame:
    """``<keys>, item``: one item for each key, drawn by the softmax of ``w`` over the temperature: the greatest
    of ``w / t`` plus a hashed Gumbel number."""
    u = (F.conv(F.substring(hashed(seed, *keys, "item"), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    score = F.round(F.col("w") / temperature - F.log(-F.log(u)), 9)
    return weights.groupBy(*keys).agg(F.max_by("item", F.struct(score, F.col("item"))).alias("item"))


def scattered(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """``node_id, feature`` with the rows of each part in place of those before it."""
    out = base.select("node_id", "feature")
    for part in parts:
        out = out.join(part.select("node_id", F.col("feature").alias("__p")), "node_id", "left").select("node_id", F.coalesce("__p", "feature").alias("feature"))
    return out
