"""Predictors and generators over the test graph; results hang on solvers, so rows only are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SEEDS, node_count, table, test_graph
from ..operators import edges as E
from ..operators import generators as G
from ..operators import growth as Y
from ..operators import metrics as M
from ..operators import predictors as L
from ..operators import splits as U
from ..operators import structure as S
from ..operators import training as R
from ..storage import materialize
from .basic import roles
from .catalog import query
from .graphs import sequences


def parts(spark, d, nodes):
    r = roles(spark, d)
    return nodes.join(r.where("role = 'train'"), "node_id"), nodes.join(r.where("role = 'test'"), "node_id")


def detector(name, features):
    def run(spark, d):
        g = test_graph(spark, d)
        train, test = parts(spark, d, features(g))
        return L.fit_predict(name, train, test).select("node_id", "y", "p")

    return run


for _key, _name, _features in (
    ("rf", "rf", lambda g: g.nodes), ("svm", "svm", lambda g: g.nodes), ("gbt", "gbt", lambda g: g.nodes), ("rfgraph", "rf", lambda g: L.hop_features(g.edges, g.nodes, 2)),
    ("gbtgraph", "gbt", lambda g: L.hop_features(g.edges, g.nodes, 2)), ("sgc_lr", "lr", lambda g: L.sgc(g.edges, g.nodes, 2)),
):
    query(_key)(detector(_name, _features))


def link_pairs(spark, d):
    g = test_graph(spark, d)
    e = E.canonical(g.edges).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    n = e.count()
    pos = e.withColumn("y", F.lit(1))
    neg = U.random_negatives(E.symmetrize(e), g.nodes.count(), n, 3407, spare=2).withColumn("y", F.lit(0))
    pairs = materialize(pos.unionByName(neg).withColumn("h", F.pmod(F.xxhash64("src", "dst"), F.lit(10))), "pairs")
    return g, pairs.where("h < 8").drop("h"), pairs.where("h >= 8").drop("h")


@query("lp_gbt")
def lp_gbt(spark, d):
    g, train, test = link_pairs(spark, d)
    return L.fit_predict("gbt", L.pair_features(train, g.nodes), L.pair_features(test, g.nodes), told=train).select("src", "dst", "y", "p")


@query("lp_dot")
def lp_dot(spark, d):
    g, _, test = link_pairs(spark, d)
    return L.dot_scores(test, g.nodes)


@query("cross_graph_rf")
def cross_graph_rf(spark, d):
    """Trained on features drawn by class, tested on the real ones."""
    g = test_graph(spark, d)
    made = G.class_gaussian(g.nodes, g.nodes.select("node_id", "label"), 11)
    from ..operators.propagate import gathered

    synthetic = g.nodes.drop("feature").join(gathered(made), "node_id")
    train, _ = parts(spark, d, synthetic)
    _, test = parts(spark, d, g.nodes.withColumn("feature", F.col("feature").cast("array<double>")))
    return L.fit_predict("rf", train, test).select("node_id", "y", "p")


@query("mlp_trials")
def mlp_trials(spark, d):
    g = test_graph(spark, d)
    splits = U.trials(U.stratified_split, g.nodes, SEEDS)
    rows = splits.join(L.hop_features(g.edges, g.nodes, 1).select("node_id", "feature", "y"), "node_id").select(F.col("trial").cast("int").alias("trial"), "node_id", "feature", "y", "role")
    return L.train_trials(rows)


@query("trial_benchmark")
def trial_benchmark(spark, d):
    """Mean and deviation of the ranking metrics over ten trials."""
    scored = mlp_trials(spark, d).select("trial", F.col("node_id").alias("id"), "y", "p")
    found = M.rank_metrics(scored, ("trial",)).withColumn("dataset", F.lit("test")).withColumn("model", F.lit("mlp"))
    return M.trial_report(found)


@query("pca_kmeans")
def pca_kmeans(spark, d):
    return G.quantize(test_graph(spark, d).nodes, 10, 8, 20)[2]


@query("token_generator")
def token_generator(spark, d):
    g = test_graph(spark, d)
    labels = g.nodes.select(F.col("node_id").alias("root"), "label")
    return G.generate_tokens(G.token_model(sequences(spark, d), labels, 3), labels, 2, 3, 11, 10, 5)


@query("rowtree_generator")
def rowtree_generator(spark, d):
    pairs = materialize(E.canonical(test_graph(spark, d).edges).select(F.col("v").alias("row_id"), F.col("u").alias("col_id")), "entries")
    return G.generate_rows(G.row_tree_model_of(pairs), pairs.select("row_id").distinct(), 3)


@query("rowtree_conditioned")
def rowtree_conditioned(spark, d):
    """Rows that know what earlier rows drew, fitted to the test graph."""
    pairs = materialize(E.canonical(test_graph(spark, d).edges).select(F.col("v").alias("row_id"), F.col("u").alias("col_id")), "entries")
    return Y.RowModel.fit(pairs).generate(pairs.select("row_id"), 3)


@query("random_graph")
def random_graph(spark, d):
    """As many nodes as the graph has, four neighbours each on average."""
    n = node_count(spark, d)
    return G.random_graph(spark, n, 4 / n, 4)


SIDE = "(SELECT count(*) // 20 FROM embeddings)"


@query("grid_graph", f"SELECT u, v FROM (SELECT a AS u, a + 1 AS v, a % 20 < 19 AS ok FROM (SELECT unnest(range(20 * {SIDE})) AS a) q UNION ALL SELECT a, a + 20, a < 20 * ({SIDE} - 1) FROM (SELECT unnest(range(20 * {SIDE})) AS a) q) r WHERE ok")
def grid_graph(spark, d):
    """Twenty columns, and rows for the graph's nodes."""
    return G.grid_graph(spark, node_count(spark, d) // 20, 20)


@query("grown_lobsters", "SELECT c_nationkey AS graph_id, CASE WHEN c_nationkey % 2 = 1 THEN 0 ELSE 1 END AS is_lobster FROM customer GROUP BY c_nationkey HAVING count(*) > 8")
def grown_lobsters(spark, d):
    """For each nation a lobster of as many nodes as it has customers; every other one with a cycle."""
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("graph_id")).agg(F.count("*").alias("n")).where("n > 8")
    pairs = G.lobster_graphs(sizes, 2)
    closing = sizes.where("graph_id % 2 = 1").select("graph_id", F.lit(0).cast("long").alias("u"), (F.expr("n div 3") - 1).cast("long").alias("v")).where("v > 1")
    short = sizes.where("graph_id % 2 = 1 and n div 3 <= 2").select("graph_id", F.lit(0).cast("long").alias("u"), (F.col("n") - 1).cast("long").alias("v"))
    return S.lobsters(pairs.unionByName(closing).unionByName(short).distinct()).select(F.col("graph_id").cast("int").alias("graph_id"), "is_lobster")


#: Values that the search draws from, for each model.
SEARCHED = {"lr": {"regParam": [1e-4, 1e-3, 1e-2, 1e-1], "elasticNetParam": [0.0, 0.5, 1.0]}, "rf": {"maxDepth": [3, 5, 7], "numTrees": [10, 20, 40]}}


@query("random_search")
def random_search(spark, d):
    """Three draws a model on smoothed features, fitted on training nodes, the best by validation, scored on test nodes."""
    g = test_graph(spark, d)
    rows = L.sgc(g.edges, g.nodes, 1).join(roles(spark, d), "node_id")
    return L.random_search(rows, SEARCHED, 3, 11)


@query("class_gaussian")
def class_gaussian(spark, d):
    n = test_graph(spark, d).nodes
    return G.class_gaussian(n, n.select("node_id", "label"), 11)


@query("feature_heads")
def feature_heads(spark, d):
    """Features drawn from means and variances learned for each node's label and its neighbours' labels; tested by their deviations."""
    g = test_graph(spark, d)
    nodes = g.nodes.join(roles(spark, d).withColumnRenamed("role", "part"), "node_id")
    labels = g.nodes.agg(F.max("label")).first()[0] + 1
    net = R.feature_network(g.edges, nodes, labels).fit(10, 0.05)
    made = R.drawn_features(net.outputs(), 11)
    return made.select("node_id", F.posexplode("feature").alias("dim", "v")).select("node_id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))
