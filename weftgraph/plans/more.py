"""Collections, layers of graph predictors, evaluation on synthetic features, detectors with trained heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..model import table, test_collection, test_graph
from ..operators import attention as A
from ..operators import collections as C
from ..operators import contrast as X
from ..operators import edges as E
from ..operators import forests as Q
from ..operators import generators as G
from ..operators import layers as L
from ..operators import neighbors as N
from ..operators import outliers as O
from ..operators import predictors as M
from ..operators import propagate as P
from ..operators import relational as B
from ..operators import signed as S
from ..operators import splits as U
from ..operators import training as R
from ..operators import trees as T
from ..storage import materialize
from .basic import TYPED, rounded, roles
from .catalog import query
from .common import COLLECTION, ROLES, WEIGHTS, laplace_sql, smooth_sql, with_graph
from .graphs import CENTRES, GDEG, GPAIRS, MMD, KERNEL, NEAR, PMF, TOKENS, TREES, centres, graph_pairs, sequences, trees
from .models import link_pairs, parts

ETYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def long_rounded(nodes, digits=6):
    return rounded(P.long_form(nodes), "v", digits=digits)


@query("collection_report", with_graph("SELECT max(n) AS max_nodes, round(avg(n), 6) AS mean_nodes, max(m) AS max_edges, round(avg(m), 6) AS mean_edges FROM (SELECT graph_id, count(*) AS n FROM gd GROUP BY graph_id) a JOIN (SELECT graph_id, count(*) AS m FROM gp GROUP BY graph_id) b USING (graph_id)", COLLECTION, GPAIRS, GDEG))
def collection_report(spark, d):
    return rounded(C.collection_report(graph_pairs(spark, d)), "mean_nodes", "mean_edges")


@query("attribute_order", with_graph("SELECT graph_id, u, v, row_number() OVER (PARTITION BY graph_id ORDER BY v, u) - 1 AS place FROM gp", COLLECTION, GPAIRS))
def attribute_order(spark, d):
    return C.attribute_order(graph_pairs(spark, d))


@query("motif_totals", with_graph("""SELECT gd.graph_id, round(max(p3.n) / CAST(count(*) AS DOUBLE), 6) AS path3, round(coalesce(max(c4.n), 0) / CAST(count(*) AS DOUBLE), 6) AS cycle4 FROM gd
JOIN (SELECT x.graph_id, 3 * count(*) / 2 AS n FROM gb x JOIN gb y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b <> x.a WHERE NOT EXISTS (SELECT 1 FROM gb z WHERE z.graph_id = x.graph_id AND z.a = x.a AND z.b = y.b) GROUP BY x.graph_id) p3 USING (graph_id)
LEFT JOIN (SELECT x.graph_id, count(*) / 2 AS n FROM gb x JOIN gb y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b <> x.a JOIN gb z ON z.graph_id = x.graph_id AND z.a = y.b AND z.b <> x.b AND z.b <> x.a JOIN gb w ON w.graph_id = x.graph_id AND w.a = z.b AND w.b = x.a
 WHERE NOT EXISTS (SELECT 1 FROM gb e WHERE e.graph_id = x.graph_id AND e.a = x.a AND e.b = y.b) AND NOT EXISTS (SELECT 1 FROM gb e WHERE e.graph_id = x.graph_id AND e.a = x.b AND e.b = z.b) GROUP BY x.graph_id) c4 USING (graph_id) GROUP BY gd.graph_id""",
    COLLECTION, GPAIRS, GDEG, "gb AS (SELECT graph_id, u AS a, v AS b FROM gp UNION ALL SELECT graph_id, v, u FROM gp)"))
def motif_totals(spark, d):
    return rounded(C.motif_totals(C.graph_orbits(graph_pairs(spark, d))), "path3", "cycle4")


@query("mmd_orbits")
def mmd_orbits(spark, d):
    """Mean orbit vectors of two collections; tested against the orbits by hand."""
    from ..operators import distances as D

    v = C.mean_orbits(C.graph_orbits(graph_pairs(spark, d)))
    return rounded(D.mmd(v.where("graph_id < 12"), v.where("graph_id >= 12"), lambda a, b: D.gaussian_tv(a, b, 30.0)), "mmd")


@query("mmd_spectral")
def mmd_spectral(spark, d):
    from ..operators import distances as D
    from ..operators import structure as S

    v = D.vectors(S.spectra(graph_pairs(spark, d)))
    return rounded(D.mmd(v.where("graph_id < 12"), v.where("graph_id >= 12")), "mmd")


@query("collection_cleaned")
def collection_cleaned(spark, d):
    return C.cleaned(test_collection(spark, d))


@query("before_gap")
def before_gap(spark, d):
    return C.before_gap(test_collection(spark, d))


@query("canonical_bfs_order")
def canonical_bfs(spark, d):
    return C.canonical_order(graph_pairs(spark, d), "bfs")


@query("canonical_dfs_order")
def canonical_dfs(spark, d):
    return C.canonical_order(graph_pairs(spark, d), "dfs")


H = "md5(concat_ws(':', '17', CAST(node_id AS VARCHAR)))"


@query("random_search_order", with_graph(f"SELECT node_id, row_number() OVER (ORDER BY depth NULLS LAST, {H}, node_id) - 1 AS place FROM nodes LEFT JOIN (SELECT node_id, min(depth) AS depth FROM bf GROUP BY node_id) q USING (node_id)",
    "bo AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)",
    f"bf(node_id, depth) AS (SELECT node_id, CAST(0 AS BIGINT) FROM (SELECT node_id FROM nodes ORDER BY {H}, node_id LIMIT 1) r UNION SELECT bo.b, depth + 1 FROM bf JOIN bo ON bo.a = bf.node_id WHERE depth < 600)").replace("WITH ", "WITH RECURSIVE ", 1))
def random_search(spark, d):
    g = test_graph(spark, d)
    return C.random_search_order(g.edges, g.nodes, 17)


@query("log_degree_hist", with_graph("SELECT graph_id, least(CAST(floor((ln(d) - ln(1.0)) / ((ln(100.0) - ln(1.0)) / 50) + 1e-9) AS BIGINT), 49) AS bin, count(*) AS n FROM gd WHERE d BETWEEN 1 AND 100 GROUP BY 1, 2", COLLECTION, GPAIRS, GDEG))
def log_degree(spark, d):
    from .graphs import graph_degrees

    return C.log_bins(graph_degrees(spark, d), 50, 1.0, 100.0)


LOOPED = "lo AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT node_id, node_id FROM nodes), ld AS (SELECT dst AS node_id, count(*) AS d FROM lo GROUP BY dst), lw AS (SELECT lo.src, lo.dst, 1 / sqrt(CAST(a.d * b.d AS DOUBLE)) AS w FROM lo JOIN ld a ON a.node_id = lo.src JOIN ld b ON b.node_id = lo.dst)"
GCN = "g1 AS (SELECT lw.dst AS node_id, dim, sum(w * v) AS v FROM lw JOIN x ON x.node_id = lw.src GROUP BY lw.dst, dim), g2 AS (SELECT lw.dst AS node_id, dim, sum(w * v) AS v FROM lw JOIN g1 ON g1.node_id = lw.src GROUP BY lw.dst, dim)"


@query("layer_gcn", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM g2", LOOPED, GCN))
def layer_gcn(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.gcn(g.edges, g.nodes))


NBR = "(SELECT dst AS node_id, dim, avg(v) AS v FROM edges JOIN {of} ON {of}.node_id = src GROUP BY dst, dim)"


@query("layer_gin", with_graph("SELECT node_id, dim, round(h1.v + coalesce(m.v, 0), 6) AS v FROM h1 LEFT JOIN " + NBR.format(of="h1") + " m USING (node_id, dim)", "h1 AS (SELECT node_id, dim, x.v + coalesce(m.v, 0) AS v FROM x LEFT JOIN " + NBR.format(of="x") + " m USING (node_id, dim))"))
def layer_gin(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.gin(g.edges, g.nodes))


@query("layer_sage", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT x.node_id, x.dim + 64, round(coalesce(m.v, 0), 6) FROM x LEFT JOIN " + NBR.format(of="x") + " m USING (node_id, dim)"))
def layer_sage(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.sage(g.edges, g.nodes))


@query("layer_sage_pool", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT x.node_id, x.dim + 64, round(coalesce(m.v, 0), 6) FROM x LEFT JOIN (SELECT dst AS node_id, dim, max(greatest(v, 0)) AS v FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim) m USING (node_id, dim)"))
def layer_sage_pool(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.sage(g.edges, g.nodes, "pool"))


@query("layer_pna", with_graph("""SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT x.node_id, x.dim + 64 * (1 + q.k), round(coalesce(q.v, 0), 6) FROM x JOIN (SELECT n.node_id, k.k, d.dim, s.v FROM nodes n CROSS JOIN (SELECT unnest(range(8)) AS k) k CROSS JOIN (SELECT DISTINCT dim FROM x) d
LEFT JOIN (SELECT node_id, dim, k % 4 + 4 * j AS k, v * CASE WHEN j = 1 THEN sc ELSE 1 END AS v FROM st CROSS JOIN (SELECT unnest([0, 1]) AS j) jj JOIN sc USING (node_id)) s ON s.node_id = n.node_id AND s.k = k.k AND s.dim = d.dim) q ON q.node_id = x.node_id AND q.dim = x.dim""",
    "dg AS (SELECT dst AS node_id, ln(1 + count(*)) AS l FROM edges GROUP BY dst), sc AS (SELECT node_id, l / (SELECT avg(l) FROM dg) AS sc FROM dg)",
    """st AS (SELECT node_id, dim, CASE agg WHEN 'mean' THEN 0 WHEN 'max' THEN 1 WHEN 'min' THEN 2 ELSE 3 END AS k, v FROM (UNPIVOT (SELECT dst AS node_id, dim, avg(v) AS mean, max(v) AS max, min(v) AS min, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0) + 1e-5) AS std
FROM edges JOIN x ON x.node_id = src GROUP BY dst, dim) ON mean, max, min, std INTO NAME agg VALUE v))"""))
def layer_pna(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.pna(g.edges, g.nodes))


@query("layer_chebyshev", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT node_id, dim + 64, round(-v, 6) FROM s1 UNION ALL SELECT node_id, dim + 128, round(2 * s2.v - x.v, 6) FROM s2 JOIN x USING (node_id, dim)", WEIGHTS, smooth_sql("s1", "x"), smooth_sql("s2", "s1")))
def layer_chebyshev(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.chebyshev_bank(g.edges, g.nodes))


@query("layer_bernstein", with_graph("""SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT x.node_id, x.dim + 64, round(3 * x.v - 3 * l1.v + 0.75 * l2.v, 6) FROM x JOIN l1 USING (node_id, dim) JOIN l2 USING (node_id, dim)
UNION ALL SELECT node_id, dim + 128, round(3 * l1.v - 1.5 * l2.v, 6) FROM l1 JOIN l2 USING (node_id, dim) UNION ALL SELECT node_id, dim + 192, round(0.75 * v, 6) FROM l2""", WEIGHTS, laplace_sql("l1", "x"), laplace_sql("l2", "l1")))
def layer_bernstein(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.bernstein_bank(g.edges, g.nodes))


@query("layer_two_filters", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT node_id, dim + 64, round(x.v + s1.v, 6) FROM x JOIN s1 USING (node_id, dim) UNION ALL SELECT node_id, dim + 128, round(x.v - s1.v, 6) FROM x JOIN s1 USING (node_id, dim)", WEIGHTS, smooth_sql("s1", "x")))
def layer_two_filters(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.two_filters(g.edges, g.nodes))


@query("layer_rgcn", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT x.node_id, x.dim + 64 * e.k, round(coalesce(m.v, 0), 6) FROM x CROSS JOIN (VALUES " + ", ".join(f"({k}, '{e}')" for k, e in enumerate(ETYPES, 1)) + ") e(k, etype) LEFT JOIN (SELECT dst AS node_id, etype, dim, avg(v) AS v FROM typed JOIN x ON x.node_id = src GROUP BY dst, etype, dim) m ON m.node_id = x.node_id AND m.dim = x.dim AND m.etype = e.etype", TYPED))
def layer_rgcn(spark, d):
    g = test_graph(spark, d)
    return long_rounded(L.rgcn(g.typed, g.nodes, ETYPES))


@query("layer_signed_attention", with_graph("SELECT node_id, dim, round(v, 6) AS v FROM x UNION ALL SELECT x.node_id, x.dim + 64, round(coalesce(m.v, 0), 6) FROM x LEFT JOIN (SELECT q.dst AS node_id, x.dim, sum(q.w * x.v) AS v FROM (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY dst) * CASE WHEN a.y = b.y THEN 1 ELSE -1 END AS w FROM (SELECT src, dst, sum(a.v * b.v) AS s FROM edges JOIN x a ON a.node_id = src JOIN x b ON b.node_id = dst AND b.dim = a.dim GROUP BY src, dst) t JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst) q JOIN x ON x.node_id = q.src GROUP BY q.dst, x.dim) m USING (node_id, dim)"))
def layer_signed(spark, d):
    g = test_graph(spark, d)
    agree = E.with_ends(g.edges, g.nodes, "y").select("src", "dst", F.when(F.col("src_y") == F.col("dst_y"), 1).otherwise(-1).alias("sign"))
    return long_rounded(L.signed_attention(g.edges, g.nodes, agree))


@query("features_overwritten", with_graph("SELECT x.node_id, x.dim, round(CASE WHEN role = 'test' THEN x.v ELSE ce.v END, 6) AS v FROM x JOIN roles USING (node_id) JOIN nc USING (node_id) JOIN ce ON ce.cid = nc.cid AND ce.dim = x.dim", ROLES, CENTRES))
def features_overwritten(spark, d):
    """Training and validation nodes with the centre of their tree's root, test nodes as they are."""
    g = test_graph(spark, d)
    made = L.root_features(sequences(spark, d).join(roles(spark, d).where("role <> 'test'").select(F.col("node_id").alias("root")), "root", "left_semi"), centres(g))
    return long_rounded(L.overwritten(g.nodes, made))


@query("tree_split_features", with_graph("""SELECT root AS node_id, role, dim, round(v, 6) AS v FROM (SELECT root, x.dim, x.v / n.s AS v FROM tree JOIN x ON x.node_id = tree.node_id JOIN (SELECT node_id, sqrt(sum(v * v)) AS s FROM x GROUP BY node_id) n ON n.node_id = x.node_id WHERE pos = 0
UNION ALL SELECT t.root, d.dim + 64, sum(coalesce(x.v / n.s, 0)) / 12 FROM tree t CROSS JOIN (SELECT DISTINCT dim FROM x) d LEFT JOIN x ON x.node_id = t.node_id AND x.dim = d.dim LEFT JOIN (SELECT node_id, sqrt(sum(v * v)) AS s FROM x GROUP BY node_id) n ON n.node_id = x.node_id WHERE pos > 0 GROUP BY t.root, d.dim) q JOIN roles ON roles.node_id = root""", ROLES, TREES))
def tree_splits(spark, d):
    """Sampled trees of original nodes by role: the root's normalised feature beside the mean of its slots."""
    g = test_graph(spark, d)
    unit = g.nodes.withColumn("feature", V.l2_normalized("feature"))
    return long_rounded(L.tree_features(trees(spark, d), unit)).join(roles(spark, d), "node_id").select("node_id", "role", "dim", "v")


@query("multigraph_merge", with_graph("SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY d, src) AS r FROM (SELECT a.node_id AS dst, b.node_id AS src, round(1 - sum(a.v * b.v) / (max(na.s) * max(nb.s)), 9) AS d FROM x a JOIN nodes n ON n.node_id = a.node_id AND n.y = 1 JOIN x b ON a.dim = b.dim AND a.node_id <> b.node_id JOIN (SELECT node_id, sqrt(sum(v * v)) AS s FROM x GROUP BY 1) na ON na.node_id = a.node_id JOIN (SELECT node_id, sqrt(sum(v * v)) AS s FROM x GROUP BY 1) nb ON nb.node_id = b.node_id GROUP BY 1, 2) t) k WHERE r <= 5) q GROUP BY src, dst"))
def multigraph_merge(spark, d):
    """Edges and those to the five nearest nodes of each anomaly, repeats counted."""
    g = test_graph(spark, d)
    return L.with_nearest(g.edges, g.nodes, 5, g.nodes.where("y = 1")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("filtered_relations", with_graph("""SELECT src, dst, etype, d FROM (SELECT src, dst, etype, d, row_number() OVER (PARTITION BY dst, etype ORDER BY d, src) AS r, count(*) OVER (PARTITION BY dst, etype) AS n
FROM (SELECT t.src, t.dst, t.etype, round(abs(a.s - b.s), 9) AS d FROM typed t JOIN sc a ON a.node_id = t.src JOIN sc b ON b.node_id = t.dst) q) z WHERE r <= ceil(n * 0.5)""", ROLES, TYPED,
    "pm AS (SELECT x.dim, avg(x.v) AS m FROM x JOIN nodes n ON n.node_id = x.node_id AND n.y = 1 JOIN roles r ON r.node_id = x.node_id AND r.role = 'train' GROUP BY x.dim)",
    "sc AS (SELECT x.node_id, tanh(sum(x.v * pm.m)) AS s FROM x JOIN pm ON pm.dim = x.dim GROUP BY x.node_id)"))
def filtered_relations(spark, d):
    """Of each node's incoming edges of a type the nearer half, by the similarity to the positive class's mean."""
    g = test_graph(spark, d)
    return B.nearest_share(g.typed, alike_scores(g, roles(spark, d)), {e: 0.5 for e in ETYPES})


def alike_scores(g, r):
    mean = P._stats(g.nodes.where("y = 1").join(r.where("role = 'train'"), "node_id").select(F.lit(1).alias("k"), P.as_vector("feature").alias("__f")), ["mean"], "k")
    return g.nodes.withColumn("k", F.lit(1)).join(F.broadcast(mean), "k").select("node_id", F.tanh(V.dot("feature", "mean")).alias("s"))


def detect(name, head, build):
    def run(spark, d):
        g, r = test_graph(spark, d), roles(spark, d)
        train, test = parts(spark, d, build(g, r))
        return M.fit_predict(head, train, test).select("node_id", "y", "p")

    run.__doc__ = f"{name}: features by propagation, a trained {head} head; test nodes scored."
    query(f"det_{name}")(run)


def contrasted(g, r):
    """What an encoder learns without labels, by contrast with shuffled features, beside the features."""
    return L.joined(g.nodes, X.Contrast(g.edges, g.nodes).fit(epochs=8, every=4).encoded())


def with_parts(g, r):
    """Nodes with the role as ``part``."""
    return g.nodes.join(r.withColumnRenamed("role", "part"), "node_id")


def trained(name, fit):
    def run(spark, d):
        g, r = test_graph(spark, d), roles(spark, d)
        net = fit(g, with_parts(g, r))
        found = materialize(net.scores(), "scores")
        net.close()
        return r.where("role = 'test'").select("node_id").join(g.nodes, "node_id").select("node_id", "y").join(found, "node_id")

    run.__doc__ = f"{name}: trained through its propagation; test nodes scored."
    query(f"det_{name}")(run)


#: Epochs of the registered networks.
EPOCHS = 10
NETWORKS = {
    "gcn": lambda g, nodes: R.gcn_network(g.edges, nodes),
    "gin": lambda g, nodes: R.gin_network(g.edges, nodes),
    "sage": lambda g, nodes: R.sage_network(g.edges, nodes),
    "rgcn": lambda g, nodes: R.rgcn_network(g.typed, nodes, ETYPES),
    "bwgnn": lambda g, nodes: R.wavelet_network(g.edges, nodes),
    "gat": lambda g, nodes: A.gat_network(g.edges, nodes),
    "gat_sep": lambda g, nodes: A.gat_network(g.edges, nodes, separate=True),
    "gt": lambda g, nodes: A.gat_network(g.edges, nodes, kind="dot"),
    "gt_sep": lambda g, nodes: A.gat_network(g.edges, nodes, separate=True, kind="dot"),
    "hgt": lambda g, nodes: A.typed_attention_network(g.typed, nodes, ETYPES),
}
for _name, _build in NETWORKS.items():
    trained(_name, lambda g, nodes, build=_build: build(g, nodes).fit(EPOCHS, 0.05))
trained("caregnn", lambda g, nodes: B.chosen_neighbours(g.typed, nodes, ETYPES, rounds=4, epochs=2)[0])
trained("h2fd", lambda g, nodes: S.SignedNetwork(nodes, [], {}, edges=g.edges).fit(EPOCHS, 0.05))
for _kind in ("sgc", "gcn", "gin", "gat"):
    trained(f"tree_{_kind}", lambda g, nodes, kind=_kind: Q.tree_network(T.sample_trees(g.edges, g.nodes, 2, 3, 3407), nodes, kind, 2, 3).fit(EPOCHS, 0.05))
trained("bgnn", lambda g, nodes: B.boosted_network(g.edges, nodes, rounds=2, epochs=4)[0])

def with_outlier_scores(nodes):
    """Nodes with the scores of five detectors without labels behind their features."""
    near = materialize(N.knn(nodes, nodes, 10, "l2"), "near")
    scores = [found.select("node_id", F.array("p").alias("feature")) for found in (O.isolation_scores(nodes), O.local_outlier_factor(near))]
    return L.joined(nodes, L.outlier_scores(nodes, near), *scores)


DETECTORS = {
    "pna": ("lr", lambda g, r: L.pna(g.edges, g.nodes)),
    "bernstein": ("lr", lambda g, r: L.bernstein_bank(g.edges, g.nodes)),
    "amnet": ("lr", lambda g, r: L.two_filters(g.edges, g.nodes)),
    "chebnet": ("lr", lambda g, r: L.chebyshev_bank(g.edges, g.nodes)),
    "gas": ("lr", lambda g, r: L.nearest_gcn(g.edges, g.nodes)),
    "ghrn": ("lr", lambda g, r: L.bernstein_bank(N.prune_laplacian(g.edges, g.nodes, (5, 100)), g.nodes)),
    "pcgnn": ("lr", lambda g, r: L.chebyshev_bank(L.with_nearest(L.alike_edges(g.edges, g.nodes), g.nodes, 5, g.nodes.join(r.where("role = 'train'"), "node_id", "left_semi").where("y = 1")), g.nodes)),
    "dci": ("lr", contrasted),
    "xgbod": ("gbt", lambda g, r: with_outlier_scores(g.nodes)),
    "tree": ("lr", lambda g, r: L.tree_features(T.sample_trees(g.edges, g.nodes, 2, 3, 3407), g.nodes).join(g.nodes.select("node_id", "y"), "node_id")),
}
for _name, (_head, _build) in DETECTORS.items():
    detect(_name, _head, _build)


@query("isolation_forest")
def isolation_forest(spark, d):
    """Trees drawn at random: tested on planted outliers."""
    g = test_graph(spark, d)
    return O.isolation_scores(g.nodes).join(g.nodes.select("node_id", "y"), "node_id").select("node_id", "y", "p")


@query("local_outliers", with_graph("""SELECT node_id, round(a / l, 6) AS p FROM (SELECT nn.dst AS node_id, avg(lr.l) AS a FROM nn JOIN lr ON lr.node_id = nn.src GROUP BY nn.dst) q JOIN lr USING (node_id)""",
    "dd AS (SELECT a.node_id AS dst, b.node_id AS src, round(sum((a.v - b.v) * (a.v - b.v)), 9) AS d FROM x a JOIN x b ON a.dim = b.dim AND a.node_id <> b.node_id GROUP BY 1, 2)",
    "nn AS (SELECT dst, src, sqrt(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY d, src) AS r FROM dd) q WHERE r <= 10)",
    "kd AS (SELECT dst AS src, max(d) AS kd FROM nn GROUP BY dst)",
    "lr AS (SELECT dst AS node_id, 1 / greatest(avg(greatest(d, kd)), 1e-10) AS l FROM nn JOIN kd USING (src) GROUP BY dst)"))
def local_outliers(spark, d):
    g = test_graph(spark, d)
    return rounded(O.local_outlier_factor(N.knn(g.nodes, g.nodes, 10, "l2")), "p")


@query("det_nagnn")
def nagnn(spark, d):
    """Scores of a filter bank plus the mean score of the nearest nodes."""
    found = M.fit_predict("lr", *parts(spark, d, L.bernstein_bank(test_graph(spark, d).edges, test_graph(spark, d).nodes))).select("node_id", "y", "p")
    nodes = test_graph(spark, d).nodes.join(found.select("node_id"), "node_id", "left_semi")
    return N.smooth_scores(N.knn(nodes, nodes, 5, "l2"), found.select("node_id", "p")).join(found.select("node_id", "y"), "node_id")


@query("det_synthetic_trees")
def synthetic_trees(spark, d):
    """Trained on generated token trees with cluster centres, tested on sampled trees of original nodes."""
    g = test_graph(spark, d)
    unit = g.nodes.withColumn("feature", V.l2_normalized("feature"))
    labels = g.nodes.select(F.col("node_id").alias("root"), "label")
    made = G.generate_tokens(G.token_model(sequences(spark, d), labels, 3), labels, 2, 3, 11, 10, 5)
    train = L.sequence_features(made, centres(test_graph(spark, d))).join(g.nodes.select("node_id", "y"), "node_id").join(roles(spark, d).where("role = 'train'"), "node_id")
    test = L.tree_features(trees(spark, d), unit).join(g.nodes.select("node_id", "y"), "node_id").join(roles(spark, d).where("role = 'test'"), "node_id")
    return M.fit_predict("rf", train, test).select("node_id", "y", "p")


def link_model(spark, d, features, head):
    g, train, test = link_pairs(spark, d)
    nodes = materialize(features(g).select("node_id", "feature"), "ends")
    if head == "lr":
        return M.logistic_pairs(train, nodes, test).select("src", "dst", "y", "p")
    return M.fit_predict(head, M.pair_features(train, nodes), M.pair_features(test, nodes), told=train).select("src", "dst", "y", "p")


@query("lp_gcn_mlp")
def lp_gcn(spark, d):
    """Products of both ends' smoothed features, a trained network as decoder."""
    return link_model(spark, d, lambda g: L.gcn(g.edges, g.nodes), "mlp")


@query("lp_graph_gbt")
def lp_graph(spark, d):
    """Products of both ends' features and neighbour means, boosted trees."""
    return link_model(spark, d, lambda g: M.hop_features(g.edges, g.nodes, 1), "gbt")


@query("lp_trees")
def lp_trees(spark, d):
    """Products of both ends' tree features."""
    return link_model(spark, d, lambda g: L.tree_features(trees(spark, d), g.nodes), "lr")


@query("lp_cross_graph")
def lp_cross(spark, d):
    """Trained on pairs with features drawn by class, tested with the real ones."""
    g, train, test = link_pairs(spark, d)
    made = g.nodes.drop("feature").join(P.gathered(G.class_gaussian(g.nodes, g.nodes.select("node_id", "label"), 11)), "node_id")
    return M.logistic_pairs(train, made, test, g.nodes).select("src", "dst", "y", "p")


@query("split_replicated", with_graph("SELECT t AS trial, node_id, role FROM roles CROSS JOIN (SELECT unnest(range(10)) AS t) q", ROLES))
def split_replicated(spark, d):
    return U.replicated_split(roles(spark, d), 10)


@query("redrawn_sample", with_graph("SELECT dr.draw, r.node_id, CAST(dr.y AS INTEGER) AS y FROM (SELECT y, n, draw, CAST('0x' || substr(md5(concat_ws(':', '5', CAST(y AS VARCHAR), CAST(draw AS VARCHAR))), 1, 8) AS BIGINT) % n + 1 AS k FROM (SELECT y, count(*) AS n FROM nodes GROUP BY y) q CROSS JOIN (SELECT unnest(range(200)) AS draw) z) dr JOIN (SELECT node_id, y, row_number() OVER (PARTITION BY y ORDER BY node_id) AS k FROM nodes) r ON r.y = dr.y AND r.k = dr.k"))
def redrawn(spark, d):
    return U.redrawn(test_graph(spark, d).nodes, 5, 200)


@query("mask_id_lists", with_graph("SELECT role, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS ids FROM roles GROUP BY role", ROLES))
def mask_ids(spark, d):
    """Ids of each role as one list, as a file of splits holds them."""
    ids = roles(spark, d).groupBy("role").agg(F.array_sort(F.collect_list("node_id")).alias("ids"))
    return ids.select("role", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("flat_table", with_graph("SELECT node_id, label, role, " + ", ".join(f"round(CAST(feature[{k + 1}] AS DOUBLE), 6) AS f{k}" for k in range(64)) + " FROM nodes JOIN roles USING (node_id)", ROLES))
def flat_table(spark, d):
    """A column for each component, with label and role."""
    rows = test_graph(spark, d).nodes.join(roles(spark, d), "node_id")
    return rows.select("node_id", "label", "role", *[F.round(F.col("feature")[k].cast("double"), 6).alias(f"f{k}") for k in range(64)])


MODELS = [("gcn", 0), ("gin", 0), ("caregnn", 1), ("h2fd", 1)]


@query("model_rules", with_graph("""SELECT model, graph_id, CASE WHEN m > (SELECT avg(m) FROM sz) THEN 16 ELSE 32 END AS hidden FROM sz CROSS JOIN (VALUES ('gcn', 0), ('gin', 0), ('caregnn', 1), ('h2fd', 1)) q(model, typed) WHERE typed = 0 OR kinds = 5""",
    "sz AS (SELECT CAST(c_nationkey AS BIGINT) AS graph_id, count(*) AS m, count(DISTINCT o_orderpriority) AS kinds FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"))
def model_rules(spark, d):
    """Which model runs on which nation's graph: two of them need all kinds of edges; graphs larger than the mean get narrower layers."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    sizes = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("graph_id")).agg(F.count("*").alias("m"), F.count_distinct("o_orderpriority").alias("kinds"))
    mean = sizes.agg(F.avg("m").alias("mean"))
    models = spark.createDataFrame(MODELS, "model string, typed int")
    every = sizes.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(models)).where("typed = 0 or kinds = 5")
    return every.select("model", "graph_id", F.when(F.col("m") > F.col("mean"), 16).otherwise(32).alias("hidden"))


@query("edge_keys", with_graph("SELECT src, dst, src * (SELECT count(*) FROM nodes) + dst AS key FROM edges"))
def edge_keys(spark, d):
    g = test_graph(spark, d)
    return g.edges.select("src", "dst", (F.col("src") * g.nodes.count() + F.col("dst")).alias("key"))


@query("row_children")
def row_children(spark, d):
    """For each range of row trees the ranges of the next depth, left before right, numbered in each depth."""
    pairs = E.canonical(test_graph(spark, d).edges).select(F.col("v").alias("row_id"), F.col("u").alias("col_id"))
    return T.row_children(T.row_decisions(pairs))
