"""Scalar functions, orders and smaller operators as queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..model import table, test_graph
from ..operators import edges as E
from ..operators import generators as G
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import propagate as P
from ..operators import scaling as S
from ..operators import structure as B
from ..operators import trees as T
from .basic import roles, rounded
from .catalog import query
from .common import ROLES, with_graph
from .graphs import BOTH, REACHED, centres, clusters, links, recursive


@query("activations", with_graph("""SELECT node_id, dim, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(v, 0), 6) AS relu, round(CASE WHEN v > 0 THEN v ELSE 0.01 * v END, 6) AS leaky, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) AS elu,
round(v / (1 + exp(-v)), 6) AS swish, round(0.5 * v * (1 + (exp(2 * t) - 1) / (exp(2 * t) + 1)), 6) AS gelu, round(greatest(least(v * 100, 2), -4), 6) AS clamped FROM (SELECT node_id, dim, v, 0.7978845608028654 * (v + 0.044715 * v * v * v) AS t FROM x) q"""))
def activations(spark, d):
    x = P.long_form(test_graph(spark, d).nodes)
    made = {"sigmoid": V.sigmoid("v"), "relu": V.relu("v"), "leaky": V.leaky_relu("v"), "elu": V.elu("v"), "swish": V.swish("v"), "gelu": V.gelu("v"), "clamped": V.log_variance(F.col("v") * 100)}
    return x.select("node_id", "dim", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("feature_softmax", with_graph("SELECT node_id, dim, round(exp(v) / sum(exp(v)) OVER (PARTITION BY node_id), 6) AS v FROM x"))
def feature_softmax(spark, d):
    return rounded(P.long_form(test_graph(spark, d).nodes.select("node_id", V.softmax(F.transform("feature", lambda x: x.cast("double"))).alias("feature"))), "v")


@query("row_normalized", with_graph("SELECT node_id, dim, round((v - lo) / greatest(s, 1), 5) AS v FROM (SELECT node_id, dim, v, min(v) OVER (PARTITION BY node_id) AS lo, sum(v) OVER (PARTITION BY node_id) - count(*) OVER (PARTITION BY node_id) * min(v) OVER (PARTITION BY node_id) AS s FROM x) q"))
def row_normalized(spark, d):
    wide = test_graph(spark, d).nodes.select("node_id", F.transform("feature", lambda x: x.cast("double")).alias("f"))
    return rounded(P.long_form(wide.select("node_id", V.row_normalized("f").alias("feature"))), "v", digits=5)


@query("position_encoding", "SELECT vec_id AS pos, i, round(sin(vec_id / power(10000.0, (i - i % 2) / 8.0) + CASE WHEN i % 2 = 1 THEN 1.5707963267948966 ELSE 0 END), 6) AS v FROM embeddings CROSS JOIN (SELECT unnest(range(8)) AS i) b")
def position_encoding(spark, d):
    """Encodings of every node's place in the order of ids."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.posexplode(V.position_encoding("vec_id", 8)).alias("i", "v"))
    return rows.select("pos", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("best_config", "SELECT o_orderstatus AS dataset, o_orderpriority AS model, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS config, max(o_totalprice) AS score FROM orders GROUP BY 1, 2")
def best_config(spark, d):
    return M.best_config(table(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("config"), F.col("o_totalprice").alias("score")))


@query("fenwick_parts", "SELECT row_id, (row_id >> (b + 1)) << (b + 1) AS part_lo, ((row_id >> (b + 1)) << (b + 1)) + (CAST(1 AS BIGINT) << b) AS part_hi FROM (SELECT vec_id AS row_id FROM embeddings) a CROSS JOIN (SELECT unnest(range(40)) AS b) q WHERE (row_id >> b) % 2 = 1")
def fenwick(spark, d):
    """The blocks before every node's row."""
    return T.fenwick_parts(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id")))


@query("largest_component", recursive("SELECT src, dst FROM edges JOIN lb ON a = src WHERE src <> dst AND m = (SELECT m FROM lb GROUP BY m ORDER BY count(*) DESC, m LIMIT 1)", BOTH, REACHED, "lb AS (SELECT a, min(b) AS m FROM rc GROUP BY a)"))
def largest_component(spark, d):
    return B.largest_component(links(spark, d))


@query("component_sizes", recursive("SELECT m AS component, count(*) AS n FROM (SELECT a, min(b) AS m FROM rc GROUP BY a) q GROUP BY m", BOTH, REACHED))
def component_sizes(spark, d):
    return B.connected_components(links(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query("bfs_relabel")
def bfs_relabel(spark, d):
    g = test_graph(spark, d)
    return B.relabeled(g.edges, B.bfs_order(g.edges, g.nodes))


@query("minmax_train", with_graph("SELECT node_id, dim, round((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 5) AS v FROM x JOIN (SELECT dim, min(v) AS lo, max(v) AS hi FROM x JOIN roles USING (node_id) WHERE role = 'train' GROUP BY dim) q USING (dim)", ROLES))
def minmax_train(spark, d):
    g = test_graph(spark, d)
    return rounded(S.minmaxed(g.nodes, g.nodes.join(roles(spark, d).where("role = 'train'"), "node_id", "left_semi")), "v", digits=5)


@query("knn_bucketed")
def knn_bucketed(spark, d):
    return N.knn_by_bucket(test_graph(spark, d).nodes, 5).select("dst", "src", "rnk")


@query("private_centres")
def private_centres(spark, d):
    return G.private_means(clusters(spark, d), test_graph(spark, d).nodes, 1.0, centres=centres(test_graph(spark, d)))


@query("induced_train_val", with_graph("SELECT src, dst FROM edges JOIN roles a ON a.node_id = src JOIN roles b ON b.node_id = dst WHERE a.role <> 'test' AND b.role <> 'test'", ROLES))
def induced_train_val(spark, d):
    return E.induced(test_graph(spark, d).edges, roles(spark, d).where("role <> 'test'"))


@query("edge_distances", with_graph("SELECT src, dst, round(sum(abs(a.v - b.v)), 5) AS l1, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 5) AS l2 FROM edges JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst AND b.dim = a.dim GROUP BY src, dst"))
def edge_distances(spark, d):
    g = test_graph(spark, d)
    rows = E.with_ends(g.edges, g.nodes, "feature")
    return rows.select("src", "dst", F.round(V.l1_distance("src_feature", "dst_feature"), 5).alias("l1"), F.round(F.sqrt(V.squared_l2_distance("src_feature", "dst_feature")), 5).alias("l2"))
