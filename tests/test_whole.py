"""Structure queries against brute force on the smallest tables, beside their SQL."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.model import test_collection as collection_of
from weftgraph.model import test_graph as graph_of
from weftgraph.operators.order import numbered_within, running_sums
from weftgraph.operators.splits import random_negatives
from weftgraph.operators.structure import bfs, orbits4, spanning_forest
from weftgraph.plans import load_catalog

QUERIES = load_catalog().QUERIES
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    g = graph_of(spark, DATA)
    return {(r.src, r.dst) for r in g.edges.collect()}, {r.node_id: np.array(r.feature, float) for r in g.nodes.select("node_id", "feature").collect()}


@pytest.fixture(scope="module")
def near(graph):
    out = defaultdict(set)
    for a, b in graph[0]:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def depths(near, root):
    seen, layer = {root: 0}, [root]
    while layer:
        layer = sorted({b for a in layer for b in near[a]} - seen.keys())
        seen |= {b: max(seen.values()) + 1 for b in layer}
    return seen


def rows(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, DATA).collect()))


def test_components(spark, graph, near):
    comp = {a: min(depths(near, a)) for a in near}
    size = Counter(comp.values())
    assert rows(spark, "components") == sorted(comp.items())
    assert rows(spark, "component_sizes") == sorted(size.items())
    top = min(size, key=lambda c: (-size[c], c))
    assert rows(spark, "largest_component") == sorted((a, b) for a, b in graph[0] if a != b and comp[a] == top)
    assert rows(spark, "spanning_forest_size") == [(len(comp) - len(size),)]


def test_search(spark, graph, near):
    seen = depths(near, min(near, key=lambda a: (-len(near[a]), a)))
    assert rows(spark, "bfs_depth") == sorted(seen.items())
    assert len(rows(spark, "bfs_relabel")) == len({(min(e), max(e)) for e in graph[0] if e[0] != e[1]})


def test_orbits(spark, near):
    got = {r.node_id: (r.o0, r.o1, r.o2, r.o3) for r in QUERIES["orbits4"](spark, DATA).collect()}
    want = {}
    for a in near:
        t = sum(len(near[a] & near[b]) for b in near[a]) // 2
        d = len(near[a])
        want[a] = (d, sum(len(near[b]) - 1 for b in near[a]) - 2 * t, d * (d - 1) // 2 - t, t)
    assert got == want


def induced_orbits(edges, n):
    """All 15 orbits by listing sets of two, three and four nodes; a set's kind is its degree sequence."""
    adj = {a: set() for a in range(n)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    place = {(1, 1): {1: 0}, (1, 1, 2): {1: 1, 2: 2}, (2, 2, 2): {2: 3}, (1, 1, 2, 2): {1: 4, 2: 5}, (1, 1, 1, 3): {1: 6, 3: 7}, (2, 2, 2, 2): {2: 8}, (1, 2, 2, 3): {1: 9, 2: 10, 3: 11}, (2, 2, 3, 3): {2: 12, 3: 13}, (3, 3, 3, 3): {3: 14}}
    out = {a: [0] * 15 for a in range(n) if adj[a]}
    for size in (2, 3, 4):
        for group in itertools.combinations(range(n), size):
            deg = {a: len(adj[a] & set(group)) for a in group}
            seen, todo = set(), [group[0]]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += adj[a] & set(group)
            if len(seen) == size:
                for a in group:
                    out[a][place[tuple(sorted(deg.values()))][deg[a]]] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_orbits(spark, seed):
    rng = random.Random(seed)
    n = 22
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(60 + 40 * seed)} | {(0, k) for k in range(1, 15)})
    got = {r.node_id: [r[f"o{k}"] for k in range(15)] for r in orbits4(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == induced_orbits(edges, n)


def test_long_path(spark):
    """Searches go on however deep a graph is."""
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    assert spanning_forest(e).count() == 70
    assert bfs(e, spark.createDataFrame([(0,)], "node_id long")).agg({"depth": "max"}).first()[0] == 70


def test_all_free_pairs(spark):
    """As many negatives as are asked for, down to the last free pair, and an error beyond."""
    n = 6
    free = {(0, 1), (2, 5), (3, 4), (4, 0), (5, 3)}
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b and (a, b) not in free], "src long, dst long")
    assert {tuple(r) for r in random_negatives(e, n, 5, 1).collect()} == free
    with pytest.raises(ValueError):
        random_negatives(e, n, 6, 1)


def test_orders(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x long").repartition(7)
    want, seen = {}, 0
    for k, (i, g, x) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        seen += x
        want[i] = (k, seen)
    got = running_sums(df, [F.desc("x"), F.col("id")], r=F.lit(1).cast("long"), s=F.col("x"))
    assert {r.id: (r.r, r.s) for r in got.collect()} == want
    inside = {r.id: (r.r, r.n) for r in numbered_within(df, "g", "x", "id").collect()}
    for g in "ab":
        own = sorted((x, i) for i, h, x in rows if h == g)
        assert all(inside[i] == (k, len(own)) for k, (_, i) in enumerate(own, 1))


def test_vectors(spark, graph):
    edges, x = graph
    got = {(r.src, r.dst): (r.l1, r.l2) for r in QUERIES["edge_distances"](spark, DATA).collect()}
    assert got.keys() == edges
    assert all(abs(got[a, b][0] - abs(x[a] - x[b]).sum()) < 1e-4 and abs(got[a, b][1] - np.sqrt(((x[a] - x[b]) ** 2).sum())) < 1e-4 for a, b in edges)
    made = QUERIES["activations"](spark, DATA).select("node_id", "dim", "relu").collect()
    assert len(made) == sum(map(len, x.values())) and all(abs(r.relu - max(x[r.node_id][r.dim], 0)) < 1e-5 for r in made)


def test_traces(spark):
    part = sorted((r.p_partkey, float(r.p_retailprice)) for r in spark.read.parquet(f"{DATA}/part.parquet").collect())
    best, last, ups, want, wind = None, None, [], [], []
    for e, s in part:
        ups.append(int(bool(wind) and s > wind[-1][1]))
        if best is None or s > best:
            best, last = s, e
        want.append((e, s, best, e - last, int(e - last > 3)))
        wind.append((e, s, int(len(ups) >= 3 and min(ups[-3:]) == 1)))
    cols = ["epoch", "score", "best", "counter", "stop"]
    assert sorted(map(tuple, QUERIES["early_stop_trace"](spark, DATA).select(*cols).collect())) == want
    assert sorted(map(tuple, QUERIES["window_stop_trace"](spark, DATA).select("epoch", "loss", "stop").collect())) == wind


def test_clauses(spark):
    want = defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect():
        want[r.l_partkey % 97].add(r.l_suppkey % 60)
    text = {c: " ".join(str(k + 1 if k < 30 else -(k - 29)) for k in sorted(v)) + " 0" for c, v in want.items()}
    assert {r.clause_id: r.clause for r in QUERIES["cnf_export"](spark, DATA).collect()} == text


def test_emd(spark):
    deg = defaultdict(Counter)
    for g, a, b in {(r.graph_id, min(r.src, r.dst), max(r.src, r.dst)) for r in collection_of(spark, DATA).collect() if r.src != r.dst}:
        deg[g][a] += 1
        deg[g][b] += 1
    top = max(max(c.values()) for c in deg.values()) + 1
    cum = {g: np.cumsum(np.bincount(list(c.values()), minlength=top) / len(c)) for g, c in deg.items()}
    got = {(r.ga, r.gb): r.emd for r in QUERIES["emd_degree"](spark, DATA).collect()}
    assert got.keys() == {(a, b) for a in deg for b in deg if a < b}
    assert all(abs(v - abs(cum[a] - cum[b]).sum()) < 1e-5 for (a, b), v in got.items())
