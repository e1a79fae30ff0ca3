"""Shared pieces of the oracle SQL: the test graph as common table expressions."""

from __future__ import annotations

GRAPH = """nodes AS (SELECT vec_id AS node_id, embedding AS feature, label, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
edges AS (SELECT DISTINCT o_orderkey % (SELECT count(*) FROM embeddings) AS src, o_custkey % (SELECT count(*) FROM embeddings) AS dst FROM orders),
x AS (SELECT node_id, unnest(range(len(feature))) AS dim, CAST(unnest(feature) AS DOUBLE) AS v FROM nodes)"""
PAIRS = "pairs AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst)"
ROLES = """roles AS (SELECT node_id, CASE WHEN 10 * r <= 4 * n THEN 'train' WHEN 10 * r <= 6 * n THEN 'val' ELSE 'test' END AS role
FROM (SELECT node_id, row_number() OVER (ORDER BY md5(concat_ws(':', '3407', CAST(node_id AS VARCHAR))), node_id) AS r, count(*) OVER () AS n FROM nodes) q)"""
COLLECTION = """g AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS graph_id, o_orderkey % (SELECT count(*) FROM embeddings) AS src, o_custkey % (SELECT count(*) FROM embeddings) AS dst
FROM orders JOIN customer ON o_custkey = c_custkey)"""
WEIGHTS = """deg AS (SELECT dst AS node_id, count(*) AS d FROM edges GROUP BY dst),
w AS (SELECT e.src, e.dst, 1 / sqrt(coalesce(a.d, 1) * CAST(b.d AS DOUBLE)) AS w FROM edges e LEFT JOIN deg a ON a.node_id = e.src JOIN deg b ON b.node_id = e.dst)"""
#: Scores of the flagship: 1 less the dot product of a node and the mean of its sources.
SCORES = """nm AS (SELECT dst AS node_id, dim, avg(v) AS v FROM edges JOIN x ON x.node_id = edges.src GROUP BY dst, dim),
scores AS (SELECT nodes.node_id AS id, y, round(1 - sum(nm.v * x.v), 9) AS p FROM nodes JOIN x USING (node_id) JOIN nm ON nm.node_id = x.node_id AND nm.dim = x.dim GROUP BY nodes.node_id, y)"""


def with_graph(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join([GRAPH, *parts]) + "\n" + body


def smooth_sql(name: str, of: str) -> str:
    """CTE ``name``: D^-1/2 A D^-1/2 of the long-form table ``of``."""
    return f"{name} AS (SELECT t.node_id, t.dim, coalesce(s.v, 0) AS v FROM {of} t LEFT JOIN (SELECT w.dst AS node_id, z.dim, sum(w.w * z.v) AS v FROM w JOIN {of} z ON z.node_id = w.src GROUP BY w.dst, z.dim) s USING (node_id, dim))"


def laplace_sql(name: str, of: str) -> str:
    return f"{smooth_sql(name + '_s', of)},\n{name} AS (SELECT t.node_id, t.dim, t.v - s.v AS v FROM {of} t JOIN {name}_s s USING (node_id, dim))"
