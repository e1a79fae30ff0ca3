"""Rows that know earlier rows: state against counting, and nearness to a source against rows that know nothing."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import distances as D
from weftgraph.operators import generators as G
from weftgraph.operators import growth as Y
from weftgraph.operators import structure as S
from weftgraph.operators import trees as T


def source(spark, n=260, seed=5):
    """New nodes link to old ones by their degree, and to neighbours of those."""
    rng = np.random.default_rng(seed)
    near = {0: {1}, 1: {0}}
    ends, rows = [0, 1], [(1, 0)]
    for i in range(2, n):
        chosen = set()
        while len(chosen) < min(3, i):
            a = int(rng.choice(ends))
            chosen.add(a)
            if len(chosen) < min(3, i) and rng.random() < 0.8:
                chosen.add(int(rng.choice(sorted(near[a]))))
        near[i] = set()
        for a in chosen:
            near[i].add(a)
            near[a].add(i)
            ends += [i, a]
            rows.append((i, a))
    return spark.createDataFrame(rows, "row_id long, col_id long")


def far(spark, a, b, of):
    x, y = (D.vectors(of(e.select(F.col("col_id").alias("u"), F.col("row_id").alias("v")))) for e in (a, b))
    return D.mmd(x, y, lambda p, q: D.gaussian_emd(p, q, 1.0, 1.0)).first()[0]


def degrees(pairs):
    return S.both_ways(pairs).groupBy("a").count().groupBy(F.lit(0).alias("graph_id"), F.col("count").alias("bin")).agg(F.count("*").alias("n"))


def clusterings(pairs):
    return D.histogram(S.clustering(pairs).select(F.lit(0).alias("graph_id"), F.col("cc").alias("x")), 20, 0.0, 1.0)


def test_known_before_counts_ends(spark):
    rows = [(1, 0), (2, 0), (3, 1), (3, 2), (7, 3)]
    known = {(r.s, r.c): (r.deg, r.before) for r in Y.known_before(spark.createDataFrame(rows, "row_id long, col_id long"), [1, 3, 5]).collect()}
    assert len(known) == 2 + 4 + 6
    for s in (1, 3, 5):
        ends = [c for r in rows if r[0] < s for c in r]
        for c in range(s + 1):
            assert known[s, c][0] == ends.count(c)
            assert known[s, c][1] - known[s, 0][1] == sum(e < c for e in ends)


def test_rounds_cover_all_rows():
    assert Y.starts_until(1, 1.5) == [1] and Y.starts_until(10, 1.5) == [1, 2, 3, 4, 6, 9]
    assert len(Y.starts_until(10**9, 1.5)) < 60


def test_nearer_to_the_source_than_rows_that_know_nothing(spark):
    real = source(spark)
    ids = real.select("row_id").distinct()
    model = Y.RowModel.fit(real)
    made = model.generate(ids, 3).collect()
    assert {r.row_id for r in made} == set(range(1, 260)) and len(set(made)) == len(made) and all(0 <= r.col_id < r.row_id for r in made)
    grown = spark.createDataFrame(made, "row_id long, col_id long")
    free = spark.createDataFrame(G.generate_rows(G.row_tree_model(T.row_decisions(real)), ids, 3).collect(), "row_id long, col_id long")
    figures = {of.__name__: [far(spark, real, e, of) for e in (grown, free)] for of in (degrees, clusterings)}
    assert all(a < b for a, b in figures.values()), figures


def test_odd_rows(spark):
    """Null, repeated and no rows, and a source of one entry."""
    model = Y.RowModel.fit(spark.createDataFrame([(1, 0)], "row_id long, col_id long"))
    rows = spark.createDataFrame([(0,), (1,), (1,), (4,), (None,)], "row_id long")
    made = sorted(model.generate(rows, 1).collect())
    assert {r.row_id for r in made} == {1, 4} and made == sorted(model.generate(rows, 1).collect())
    assert model.generate(rows.limit(0), 1).count() == 0


@pytest.fixture
def without_broadcast(spark):
    """Joins as of tables that are too large to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, kept)


def sent(spark, run):
    """Rows shuffled while ``run`` works."""
    context = spark.sparkContext
    store, number, tasks = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(None, False, False, number, tasks)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > before)


def test_no_range_is_sent_for_each_level(spark, without_broadcast):
    """Each range of a row's halving was joined with the sums at its borders."""
    rng = np.random.default_rng(2)
    rows = sorted({(max(a, b), min(a, b)) for a, b in rng.integers(300, size=(9000, 2)).tolist() if a != b})
    entries = spark.createDataFrame(rows, "row_id long, col_id long")
    assert sent(spark, lambda: Y.RowModel.fit(entries)) < 12 * len(rows)


def test_uniform_of_equals_uniform(spark):
    a, b = [0, 1, -1, 12345678901234, (1 << 62) + 3], [7, -9, 0, 1 << 40, 5]
    rows = spark.createDataFrame(list(zip(range(5), a, b)), "k int, a long, b long")
    for seed in (0, 3, -8, 1 << 40, (1 << 31) - 1, 1 << 31):
        want = [r.u for r in rows.select("k", G.uniform(seed, "a", "b").alias("u")).orderBy("k").collect()]
        assert G.uniform_of(seed, np.array(a), np.array(b)).tolist() == want


def parts_of(model):
    return [sorted(map(tuple, t.collect())) for t in (model.halves, model.sizes, model.closing)]


def test_rows_are_those_that_joins_gave(spark):
    """Digests of what the joins of ranges with running sums gave, of the model and of the rows."""
    real = source(spark, 120)
    model = Y.RowModel.fit(real)
    made = sorted(map(tuple, model.generate(real.select("row_id").distinct(), 3).collect()))
    found = [hashlib.sha256(json.dumps(x).encode()).hexdigest()[:16] for x in [*parts_of(model), made]]
    assert found == ["1e290b4cf05dc621", "f7bcf516167b1d1e", "bcd8723317f946be", "9dc333640a115f97"]


def test_blocks_and_tiles_change_no_row(spark, monkeypatch):
    """Ranges wider than a block, several tiles of rows and pieces of a tile."""
    real = source(spark, 40)
    ids = real.select("row_id").distinct()
    model = Y.RowModel.fit(real, 3.0)
    made = sorted(model.generate(ids, 3, 3.0).collect())
    for name, value in (("WIDTH", 6), ("TILE", 20), ("AT_ONCE", 5)):
        monkeypatch.setattr(Y, name, value)
    small = Y.RowModel.fit(real, 3.0)
    assert parts_of(small) == parts_of(model)
    assert sorted(small.generate(ids, 3, 3.0).collect()) == made


def test_edges_go_to_triangle_tiles_packed(spark):
    """A row was sent for each edge and colour."""
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "p int, q int")
    found = []
    assert sent(spark, lambda: found.extend(map(tuple, S.tiled_triangles(edges, 4).collect()))) < 2 * 780
    assert sorted(found) == [(i, j, k) for i in range(40) for j in range(i + 1, 40) for k in range(j + 1, 40)]
