"""Edges, propagation, metrics, reports, splits, scaling over the test graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..model import SEEDS, table, test_graph
from ..operators import edges as E
from ..operators import metrics as M
from ..operators import propagate as P
from ..operators import scaling as S
from ..operators import splits as U
from .catalog import query
from .common import PAIRS, ROLES, SCORES, WEIGHTS, laplace_sql, smooth_sql, with_graph

ROUND = "SELECT node_id, dim, round(v, 6) AS v FROM "


def rounded(rows, *columns, digits=6):
    return rows.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in rows.columns])


def scored(spark, d):
    g = test_graph(spark, d)
    mean = P.aggregated(g.edges, g.nodes, name="m")
    return g.nodes.join(mean, "node_id").select(F.col("node_id").alias("id"), "y", F.round(1 - V.dot("m", "feature"), 9).alias("p"))


AUROC = "SELECT (sum(CASE WHEN y = 1 THEN r END) - max(np) * (max(np) + 1) / 2.0) / (max(np) * max(nn)) AS auroc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, sum(y) OVER () AS np, count(*) OVER () - sum(y) OVER () AS nn FROM scores) q"
AUPRC = "SELECT sum(pos * tp / seen) / max(np) AS auprc FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS np FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM scores GROUP BY p) a) q"
RECALL = "SELECT sum(CASE WHEN r <= k THEN y ELSE 0 END) / CAST(max(k) AS DOUBLE) AS recall_at_k FROM (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS r, sum(y) OVER () AS k FROM scores) q"


@query("flagship_rank_metrics", with_graph(f"SELECT round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(recall_at_k, 6) AS recall_at_k FROM ({AUROC}) a, ({AUPRC}) b, ({RECALL}) c", SCORES))
def flagship(spark, d):
    """Neighbour means, scores and the three ranking metrics."""
    return rounded(M.rank_metrics(scored(spark, d)), "auroc", "auprc", "recall_at_k")


for _name, _sql in (("auroc", AUROC), ("auprc", AUPRC), ("recall_at_k", RECALL)):
    query(_name, with_graph(f"SELECT round({_name}, 6) AS {_name} FROM ({_sql}) a", SCORES))(lambda spark, d, n=_name: rounded(M.rank_metrics(scored(spark, d)).select(n), n))


@query("graph_summary", with_graph("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE src = dst) AS loops, (SELECT CAST(sum(y) AS BIGINT) FROM nodes) AS anomalies, (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)) AS zero_indeg"))
def graph_summary(spark, d):
    g = test_graph(spark, d)
    return E.graph_summary(g.nodes, g.edges)


@query("edges_symmetrize", with_graph("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges"))
def symmetrize(spark, d):
    return E.symmetrize(test_graph(spark, d).edges)


@query("edges_selfloop_reset", with_graph("SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT node_id, node_id FROM nodes"))
def selfloops(spark, d):
    g = test_graph(spark, d)
    return E.reset_loops(g.edges, g.nodes)


@query("edges_canonical", with_graph("SELECT u, v FROM pairs", PAIRS))
def canonical(spark, d):
    return E.canonical(test_graph(spark, d).edges)


DEGREES = "dg AS (SELECT node_id, (SELECT count(*) FROM edges WHERE dst = node_id) AS in_deg, (SELECT count(*) FROM edges WHERE src = node_id) AS out_deg FROM nodes)"


def degrees_of(spark, d):
    g = test_graph(spark, d)
    return E.degrees(g.edges, g.nodes)


query("degree_table", with_graph("SELECT * FROM dg", DEGREES))(degrees_of)


@query("degree_histogram", with_graph("SELECT k AS degree, count(node_id) AS n FROM (SELECT unnest(range((SELECT max(in_deg) FROM dg) + 1)) AS k) q LEFT JOIN dg ON in_deg = k GROUP BY k", DEGREES))
def degree_histogram(spark, d):
    return E.degree_histogram(degrees_of(spark, d))


@query("degree_stats", with_graph("SELECT round(avg(in_deg), 6) AS mean_deg, CAST(median(in_deg) AS DOUBLE) AS median_deg, max(in_deg) AS max_deg FROM dg", DEGREES))
def degree_stats(spark, d):
    return degrees_of(spark, d).agg(F.round(F.avg("in_deg"), 6).alias("mean_deg"), F.median("in_deg").alias("median_deg"), F.max("in_deg").alias("max_deg"))


def roles(spark, d):
    return U.random_split(test_graph(spark, d).nodes, 3407)


@query("induced_subgraph_train", with_graph("SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM roles WHERE role = 'train') AND dst IN (SELECT node_id FROM roles WHERE role = 'train')", ROLES))
def induced(spark, d):
    return E.induced(test_graph(spark, d).edges, roles(spark, d).where("role = 'train'"))


@query("edge_labels_homophily", with_graph("SELECT src, dst, CASE WHEN a.y = b.y THEN 1 ELSE -1 END AS lab, CASE WHEN ra.role = 'train' AND rb.role = 'train' THEN 1 ELSE 0 END AS in_train FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst JOIN roles ra ON ra.node_id = src JOIN roles rb ON rb.node_id = dst", ROLES))
def homophily(spark, d):
    g = test_graph(spark, d)
    return E.homophily(g.edges, g.nodes, roles(spark, d).where("role = 'train'"))


TYPED = "typed AS (SELECT DISTINCT o_orderkey % (SELECT count(*) FROM embeddings) AS src, o_custkey % (SELECT count(*) FROM embeddings) AS dst, o_orderpriority AS etype FROM orders)"


@query("etype_homogenize", with_graph("SELECT src, dst FROM typed", TYPED))
def homogenize(spark, d):
    return test_graph(spark, d).typed.select("src", "dst")


@query("etype_mean", with_graph("SELECT node_id, dim, round(avg(v), 6) AS v FROM (SELECT dst AS node_id, etype, dim, avg(v) AS v FROM typed JOIN x ON x.node_id = src GROUP BY dst, etype, dim) q GROUP BY node_id, dim", TYPED))
def etype_mean(spark, d):
    g = test_graph(spark, d)
    return rounded(P.relation_mean(g.typed, g.nodes), "v")


@query("etype_weighted_sum", with_graph("SELECT node_id, dim, round(sum(v), 6) AS v FROM (SELECT dst AS node_id, dim, avg(v) * CASE etype WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 0.25 ELSE 0 END AS v FROM typed JOIN x ON x.node_id = src GROUP BY dst, etype, dim UNION ALL SELECT node_id, dim, v FROM x) q GROUP BY node_id, dim", TYPED))
def etype_weighted(spark, d):
    g = test_graph(spark, d)
    return rounded(P.relation_mean(g.typed, g.nodes, {"1-URGENT": 0.5, "2-HIGH": 0.25}), "v")


for _how, _agg in (("mean", "avg(v)"), ("sum", "sum(v)"), ("max", "max(v)"), ("min", "min(v)"), ("std", "sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0) + 1e-5)")):

    def _neighbour(spark, d, how=_how):
        g = test_graph(spark, d)
        return rounded(P.neighbour(g.edges, g.nodes, how), "v")

    query(f"nbr_{_how}", with_graph(f"SELECT dst AS node_id, dim, round({_agg}, 6) AS v FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim"))(_neighbour)


@query("principal_aggregate", with_graph("""SELECT node_id, agg, dim, round(v, 6) AS v FROM (UNPIVOT (SELECT dst AS node_id, dim, avg(v) AS mean, max(v) AS max, min(v) AS min, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0) + 1e-5) AS std
FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim) ON mean, max, min, std INTO NAME agg VALUE v)"""))
def principal(spark, d):
    g = test_graph(spark, d)
    return rounded(P.principal(g.edges, g.nodes), "v")


@query("sym_norm_prop", with_graph(ROUND + "s1", WEIGHTS, smooth_sql("s1", "x")))
def sym_norm(spark, d):
    g = test_graph(spark, d)
    return rounded(P.long_form(P.smoothed(P.normalized_edges(g.edges), g.nodes)), "v")


@query("poly_laplacian_d2", with_graph("SELECT x.node_id, x.dim, round(3 * l1.v - 1.5 * l2.v, 6) AS v FROM x JOIN l1 USING (node_id, dim) JOIN l2 USING (node_id, dim)", WEIGHTS, laplace_sql("l1", "x"), laplace_sql("l2", "l1")))
def poly(spark, d):
    g = test_graph(spark, d)
    return rounded(P.long_form(P.polynomial_filter(g.edges, g.nodes, V.bernstein_theta(2)[1])), "v")


@query("bernstein_k2", with_graph(
    "SELECT node_id, dim, round(0.25 * (4 * x.v - 4 * l1.v + l2.v) + 0.25 * (2 * l1.v - l2.v) + 0.0625 * l2.v, 6) AS v FROM x JOIN l1 USING (node_id, dim) JOIN l2 USING (node_id, dim)", WEIGHTS, laplace_sql("l1", "x"), laplace_sql("l2", "l1")))
def bernstein(spark, d):
    g = test_graph(spark, d)
    return rounded(P.long_form(P.bernstein_filter(g.edges, g.nodes, [1.0, 0.5, 0.25])), "v")


@query("cheb_k2", with_graph("SELECT node_id, 0 AS k, dim, round(v, 6) AS v FROM x UNION ALL SELECT node_id, 1, dim, round(-v, 6) FROM s1 UNION ALL SELECT node_id, 2, dim, round(2 * s2.v - x.v, 6) FROM s2 JOIN x USING (node_id, dim)", WEIGHTS, smooth_sql("s1", "x"), smooth_sql("s2", "s1")))
def cheb(spark, d):
    g = test_graph(spark, d)
    return rounded(P.stacked(P.chebyshev(g.edges, g.nodes, 2), "k"), "v")


@query("gin_noparam_2hop", with_graph("SELECT node_id, 0 AS hop, dim, round(v, 6) AS v FROM x UNION ALL SELECT node_id, 1, dim, round(v, 6) FROM h1 UNION ALL SELECT node_id, 2, dim, round(v, 6) FROM h2",
    "h1 AS (SELECT dst AS node_id, dim, avg(v) AS v FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim)", "h2 AS (SELECT dst AS node_id, dim, avg(v) AS v FROM edges JOIN h1 ON h1.node_id = src GROUP BY dst, dim)"))
def gin(spark, d):
    g = test_graph(spark, d)
    return rounded(P.stacked(P.hops(g.edges, g.nodes, 2)), "v")


@query("gin_smooth", with_graph("SELECT x.node_id, x.dim, round(x.v + m.v, 6) AS v FROM x JOIN (SELECT dst AS node_id, dim, avg(v) AS v FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim) m USING (node_id, dim)"))
def gin_smooth(spark, d):
    g = test_graph(spark, d)
    return rounded(P.long_form(P.gin_smooth(g.edges, g.nodes)), "v")


@query("nonzero_mean", with_graph("SELECT dst AS node_id, dim, round(sum(v) / greatest(count(*), 1), 6) AS v FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim"))
def nonzero_mean(spark, d):
    g = test_graph(spark, d)
    return rounded(P.nonzero_mean(g.edges, g.nodes), "v")


DOTS = "dots AS (SELECT src, dst, sum(a.v * b.v) AS s FROM edges JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst AND b.dim = a.dim GROUP BY src, dst)"


@query("edge_softmax_attention", with_graph("SELECT q.dst AS node_id, dim, round(sum(q.w * x.v), 6) AS v FROM (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY dst) AS w FROM dots) q JOIN x ON x.node_id = q.src GROUP BY q.dst, dim", DOTS))
def attention(spark, d):
    g = test_graph(spark, d)
    return rounded(P.attention(g.edges, g.nodes), "v")


@query("edge_score_dot", with_graph("SELECT src, dst, round(s, 6) AS s FROM dots", DOTS))
def edge_dot(spark, d):
    g = test_graph(spark, d)
    return E.with_ends(g.edges, g.nodes, "feature").select("src", "dst", F.round(V.dot("src_feature", "dst_feature"), 6).alias("s"))


@query("edge_hadamard", with_graph("SELECT src, dst, a.dim, round(a.v * b.v, 6) AS v FROM edges JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst AND b.dim = a.dim"))
def edge_hadamard(spark, d):
    g = test_graph(spark, d)
    return E.with_ends(g.edges, g.nodes, "feature").select("src", "dst", F.posexplode(V.hadamard("src_feature", "dst_feature")).alias("dim", "v")).select("src", "dst", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


@query("f1_micro_macro", with_graph("""SELECT round(sum(t) / sum(a), 6) AS f1_micro, round(avg(2 * t / (a + b)), 6) AS f1_macro FROM (SELECT c, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(t) AS DOUBLE) AS t FROM
(SELECT label AS c, 1 AS a, 0 AS b, CASE WHEN label = node_id % 7 THEN 1 ELSE 0 END AS t FROM nodes UNION ALL SELECT node_id % 7, 0, 1, 0 FROM nodes) q GROUP BY c) r"""))
def f1(spark, d):
    return rounded(M.f1_scores(test_graph(spark, d).nodes.select(F.col("label").cast("long").alias("y"), (F.col("node_id") % 7).alias("yhat"))), "f1_micro", "f1_macro")


TRIALS = "trials AS (SELECT o_orderpriority AS model, o_orderstatus AS dataset, o_totalprice AS auroc, o_totalprice / 2 AS auprc FROM orders)"


@query("trial_report", f"WITH {TRIALS} SELECT dataset, model, count(*) AS trials, round(avg(auroc), 4) AS auroc_mean, round(stddev_pop(auroc), 4) AS auroc_std, round(avg(auprc), 4) AS auprc_mean, round(stddev_pop(auprc), 4) AS auprc_std FROM trials GROUP BY dataset, model")
def trial_report(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset"), F.col("o_totalprice").cast("double").alias("auroc"), (F.col("o_totalprice").cast("double") / 2).alias("auprc"))
    return rounded(M.trial_report(t, ("auroc", "auprc")), "auroc_mean", "auroc_std", "auprc_mean", "auprc_std", digits=4)


@query("trial_pivot", "SELECT o_orderpriority AS model, round(avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderstatus = 'O'), 4) AS O FROM orders GROUP BY o_orderpriority")
def trial_pivot(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("dataset"), F.col("o_totalprice").cast("double").alias("auroc"))
    return rounded(M.trial_pivot(t, "auroc", "model", "dataset", ["F", "O"]), "F", "O", digits=4)


EPOCHS = "ep AS (SELECT p_partkey AS epoch, CAST(p_retailprice AS DOUBLE) AS score FROM part)"


def epochs(spark, d, name):
    return table(spark, d, "part").select(F.col("p_partkey").alias("epoch"), F.col("p_retailprice").cast("double").alias(name))


@query("early_stop_trace", f"""WITH {EPOCHS} SELECT epoch, score, best, epoch - last AS counter, CASE WHEN epoch - last > 3 THEN 1 ELSE 0 END AS stop FROM (SELECT epoch, score, best, max(up) OVER (ORDER BY epoch) AS last FROM
(SELECT epoch, score, max(score) OVER (ORDER BY epoch) AS best, CASE WHEN before IS NULL OR score > before THEN epoch END AS up FROM (SELECT epoch, score, max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ep) a) b) c""")
def early_stop(spark, d):
    return M.early_stop(epochs(spark, d, "score"), 3)


@query("window_stop_trace", f"""WITH {EPOCHS} SELECT epoch, score AS loss, CASE WHEN min(up) OVER w = 1 AND count(*) OVER w = 3 THEN 1 ELSE 0 END AS stop FROM (SELECT epoch, score, CASE WHEN score > lag(score) OVER (ORDER BY epoch) THEN 1 ELSE 0 END AS up FROM ep) q
WINDOW w AS (ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def window_stop(spark, d):
    return M.window_stop(epochs(spark, d, "loss"), 3)


query("split_402040", with_graph("SELECT node_id, role FROM roles", ROLES))(roles)
H = "md5(concat_ws(':', '{}', CAST(node_id AS VARCHAR))), node_id"


@query("split_stratified", with_graph(f"SELECT node_id, CASE WHEN 10 * r <= 4 * n THEN 'train' WHEN 10 * r <= 6 * n THEN 'val' ELSE 'test' END AS role FROM (SELECT node_id, row_number() OVER (PARTITION BY y ORDER BY {H.format(3407)}) AS r, count(*) OVER (PARTITION BY y) AS n FROM nodes) q"))
def stratified(spark, d):
    return U.stratified_split(test_graph(spark, d).nodes, 3407)


@query("split_trials", with_graph(" UNION ALL ".join(f"SELECT {k} AS trial, node_id, CASE WHEN 10 * r <= 4 * n THEN 'train' WHEN 10 * r <= 6 * n THEN 'val' ELSE 'test' END AS role FROM (SELECT node_id, row_number() OVER (PARTITION BY y ORDER BY {H.format(s)}) AS r, count(*) OVER (PARTITION BY y) AS n FROM nodes) q{k}" for k, s in enumerate(SEEDS))))
def split_trials(spark, d):
    return U.trials(U.stratified_split, test_graph(spark, d).nodes, SEEDS)


@query("split_semi", with_graph(f"SELECT node_id, CASE WHEN r <= q THEN 'train' WHEN r <= 2 * q THEN 'val' ELSE 'test' END AS role FROM (SELECT node_id, CASE WHEN y = 1 THEN 20 ELSE 80 END AS q, row_number() OVER (PARTITION BY y ORDER BY {H.format(3407)}) AS r FROM nodes) t"))
def semi(spark, d):
    return U.few_label_split(test_graph(spark, d).nodes, 3407)


@query("split_quota", with_graph(f"SELECT node_id, CASE WHEN r <= 100 THEN 'train' WHEN r <= 150 THEN 'val' ELSE 'test' END AS role FROM (SELECT node_id, row_number() OVER (ORDER BY {H.format(42)}) AS r FROM nodes) t"))
def quota(spark, d):
    quotas = spark.createDataFrame([(0, 100, "train"), (100, 150, "val"), (150, 2**40, "test")], "lo long, hi long, role string")
    return U.quota_split(test_graph(spark, d).nodes, 42, quotas)


@query("balanced_sample", with_graph(f"SELECT node_id, y FROM (SELECT node_id, y, row_number() OVER (PARTITION BY y ORDER BY {H.format(5)}) AS r FROM nodes) t WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM nodes GROUP BY y) q)"))
def balanced(spark, d):
    return U.balanced(test_graph(spark, d).nodes, 5)


@query("feature_permutation", with_graph(f"SELECT a.node_id, x.dim, round(x.v, 6) AS v FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) AS r FROM nodes) a JOIN (SELECT node_id, row_number() OVER (ORDER BY {H.format(9)}) AS r FROM nodes) b USING (r) JOIN x ON x.node_id = b.node_id"))
def permuted(spark, d):
    return rounded(P.long_form(U.permuted(test_graph(spark, d).nodes, 9)), "v")


@query("neg_hard", with_graph("""SELECT a.src, b.dst FROM (SELECT src, dst AS mid FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws(':', '3407', CAST(src AS VARCHAR), CAST(dst AS VARCHAR))), dst) AS r FROM edges) q WHERE r = 1) a
JOIN (SELECT src AS mid, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws(':', '3408', CAST(src AS VARCHAR), CAST(dst AS VARCHAR))), dst) AS r FROM edges) q WHERE r = 1) b USING (mid) WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a.src AND e.dst = b.dst)"""))
def neg_hard(spark, d):
    return U.hard_negatives(test_graph(spark, d).edges, 3407)


@query("neg_random", with_graph("""SELECT src, dst FROM (SELECT CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % (SELECT count(*) FROM nodes) AS src, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % (SELECT count(*) FROM nodes) AS dst, min(h) AS h
FROM (SELECT md5(concat_ws(':', '3407', CAST(id AS VARCHAR))) AS h FROM (SELECT unnest(range(2100)) AS id) r) q GROUP BY 1, 2) t WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = t.src AND e.dst = t.dst) ORDER BY h, src, dst LIMIT 1000"""))
def neg_random(spark, d):
    g = test_graph(spark, d)
    return U.random_negatives(g.edges, g.nodes.count(), 1000, 3407)


DIM = "(SELECT dim, avg(v) AS m, stddev_samp(v) AS s, min(v) AS lo, max(v) AS hi FROM x GROUP BY dim) q"


@query("zscore", with_graph(f"SELECT node_id, dim, round((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS v FROM x JOIN {DIM} USING (dim)"))
def zscore(spark, d):
    return rounded(S.zscored(test_graph(spark, d).nodes), "v")


@query("minmax", with_graph(f"SELECT node_id, dim, round((v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS v FROM x JOIN {DIM} USING (dim)"))
def minmax(spark, d):
    return rounded(S.minmaxed(test_graph(spark, d).nodes), "v")


@query("l2norm", with_graph("SELECT x.node_id, dim, round(v / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS v FROM x JOIN (SELECT node_id, sqrt(sum(v * v)) AS s FROM x GROUP BY node_id) q USING (node_id)"))
def l2norm(spark, d):
    return rounded(P.long_form(test_graph(spark, d).nodes.select("node_id", V.l2_normalized("feature").alias("feature"))), "v")


@query("fidelity_bias_std", with_graph("""SELECT round(avg(abs(mb - ma)), 6) AS bias, round(avg(sb / greatest(sa, 1e-8)), 6) AS std_ratio FROM (SELECT dim, avg(v) AS ma, stddev_pop(v) AS sa FROM x GROUP BY dim) a
JOIN (SELECT dim, avg(v) AS mb, stddev_pop(v) AS sb FROM (SELECT dst, dim, avg(v) AS v FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim) q GROUP BY dim) b USING (dim)"""))
def fidelity(spark, d):
    g = test_graph(spark, d)
    return rounded(S.fidelity(g.nodes, P.aggregated(g.edges, g.nodes)), "bias", "std_ratio")


@query("class_weight", with_graph("SELECT round((count(*) - sum(y)) / CAST(greatest(sum(y), 1) AS DOUBLE), 6) AS weight FROM nodes JOIN roles USING (node_id) WHERE role = 'train'", ROLES))
def class_weight(spark, d):
    return test_graph(spark, d).nodes.join(roles(spark, d).where("role = 'train'"), "node_id").agg(F.round((F.count("*") - F.sum("y")) / F.greatest(F.sum("y"), F.lit(1)), 6).alias("weight"))


@query("split_counts", with_graph("SELECT role, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM nodes JOIN roles USING (node_id) GROUP BY role", ROLES))
def split_counts(spark, d):
    return test_graph(spark, d).nodes.join(roles(spark, d), "node_id").groupBy("role").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("class_prototypes", with_graph("SELECT CAST(label AS BIGINT) AS label, dim, round(avg(v), 6) AS v FROM x JOIN nodes USING (node_id) GROUP BY label, dim"))
def prototypes(spark, d):
    g = test_graph(spark, d)
    return rounded(P.long_form(g.nodes).join(g.nodes.select("node_id", "label"), "node_id").groupBy(F.col("label").cast("long").alias("label"), "dim").agg(F.avg("v").alias("v")), "v")


@query("losses", "WITH q AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, (doc_id % 11 + 1) / 13.0 AS p, (doc_id % 17) / 4.0 - 2 AS z FROM labels) SELECT round(avg(-(2 * y * ln(p) + (1 - y) * ln(1 - p))), 6) AS ce, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(greatest(1 - (2 * y - 1) * z, 0)), 6) AS hinge FROM q")
def losses(spark, d):
    q = table(spark, d, "labels").select(F.col("quality").cast("double").alias("y"), ((F.col("doc_id") % 11 + 1) / 13.0).alias("p"), ((F.col("doc_id") % 17) / 4.0 - 2).alias("z"))
    return q.agg(F.round(F.avg(V.weighted_cross_entropy("y", "p", 2.0)), 6).alias("ce"), F.round(F.avg(V.bce_with_logits("y", "z")), 6).alias("bce"), F.round(F.avg(V.hinge(2 * F.col("y") - 1, "z")), 6).alias("hinge"))
