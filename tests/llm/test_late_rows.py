"""Late rows against brute force: layouts, files left alone, slices, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import late_rows
from weftgraph.llm.late_rows import DailyTable, fit_slices, latest, overwrite_days
from weftgraph.llm.queries import op13_late_rows

EPOCH = datetime(1970, 1, 1)
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def sales(n=900, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sold = None if rng.random() < 0.02 else datetime(2024, 4, 1) + timedelta(days=rng.randrange(18), seconds=rng.choice([0, 0, rng.randrange(86_400)]), microseconds=rng.choice([0, rng.randrange(10**6)]))
        arrived = (sold or datetime(2024, 4, 5)) + timedelta(hours=rng.choice([0, 1, 5, 200]))
        out.append((i * 7 - 20, rng.randrange(9), rng.choice(["done", None]), rng.choice([None, 0.125, 7.5, round(rng.random() * 900, 2)]), sold, arrived, rng.randrange(5)))
    rng.shuffle(out)
    return out


def brute(rows):
    n, size, cutoff = len(rows), 1 + len(rows) // 700, datetime(2024, 4, 10)
    copies = []
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        day = -1 if r[4] is None else us(r[4]) // late_rows.DAY
        if h % 3 == 0 and day % 7 == 0:
            copies.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), r[5] + timedelta(days=1 + h % 97), r[6]))
    everything = rows + copies

    def kept(some):
        best = {}
        for r in some:
            if r[0] not in best or r[5] > best[r[0]][5]:
                best[r[0]] = r
        return best

    day_of = lambda r: -1 if r[4] is None else us(r[4]) // late_rows.DAY
    start, end = kept([r for r in everything if r[5] < cutoff]), kept(everything)
    changed = set()
    for k, r in end.items():
        if r[5] >= cutoff:
            changed |= {day_of(r)} | ({day_of(start[k])} if k in start else set())
    days = defaultdict(list)
    for r in end.values():
        days[day_of(r)].append(r)
    out = {}
    for day, own in days.items():
        own.sort(key=lambda r: (r[4] or EPOCH, r[0]))
        for k in range(0, len(own), size):
            part = own[k : k + size]
            crc = sum(zlib.crc32(f"{r[0]}:{'' if r[4] is None else us(r[4])}:{us(r[5])}".encode()) for r in part)
            cents = sum(0 if r[3] is None else int((100 * r[3] + 0.5) // 1) for r in part)
            out[day, k // size] = (len(part), cents, crc, hashlib.sha256(",".join(str(r[0]) for r in part).encode()).hexdigest(), day in changed)
    assert n and changed and len(changed) < len(days) + 1
    return out


@pytest.mark.parametrize("rows", [sales(), sales(2_500, 9)])
def test_query_against_brute_force(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(late_rows, "SLICE_ROWS", 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/sales.parquet")
    got = op13_late_rows(spark, str(tmp_path)).collect()
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == brute(rows)
    names = "sale_id,client_id,status,total,sold_at,arrived_at,priority"
    assert {r.columns for r in got} == {names}
    for r in got:
        held = pq.read_table(r.path, partitioning=None)
        assert held.num_rows == r.n_rows and ",".join(held.column_names) == names
        assert hashlib.sha256(",".join(map(str, held.column("sale_id").to_pylist())).encode()).hexdigest() == r.ids_sha256
    root = Path(got[0].path).parents[2]
    assert {str(p) for p in root.rglob("*.parquet")} == {r.path for r in got}


def test_first_layout_with_over_full_slices(spark, tmp_path, monkeypatch):
    """Slices that are split in the first layout too, where nothing is stored yet."""
    found = []
    monkeypatch.setattr(late_rows, "fit_slices", lambda keys: found.append(fit_slices(keys, slice_rows=8, most_rows=12)) or found[-1])
    rows = sales(700, 5)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/sales.parquet")
    got = op13_late_rows(spark, str(tmp_path)).collect()
    assert len(found) == 2 and all(len(s.splits) > 1 for s in found)
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == brute(rows)


def test_other_files_stay_as_they_are(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, 1, "x", 1.0, base + timedelta(hours=i), base + timedelta(hours=i), 1) for i in range(24 * 6)]
    at = DailyTable(f"file://{tmp_path}/t", spark.createDataFrame(rows, SCHEMA).schema, 5)
    overwrite_days(at, spark.createDataFrame(rows, SCHEMA))
    files = lambda: {str(p.relative_to(tmp_path)): p.read_bytes() for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    assert len(before) == 6 * 5
    # all of the second day moves to the fourth; one sale of the fifth arrives again; one is older than what is stored
    late = [(i, 1, "x", 2.0, base + timedelta(days=3, minutes=i), base + timedelta(days=50), 1) for i in range(24, 48)]
    late += [(100, 1, "y", 3.0, base + timedelta(hours=100), base + timedelta(days=60), 1), (0, 1, "old", 3.0, base, base - timedelta(days=1), 1), (0, 1, "no arrival", 3.0, base, None, 1)]
    days = overwrite_days(at, spark.createDataFrame(late, SCHEMA))
    first = us(base) // late_rows.DAY
    assert {r.day - first for r in days.collect()} == {1, 3, 4}
    after = files()
    day = lambda name: int(name.split("day=")[1].split("/")[0]) - first
    assert {k: v for k, v in before.items() if day(k) in (0, 2, 5)} == {k: v for k, v in after.items() if day(k) in (0, 2, 5)}
    assert {d: sum(day(k) == d for k in after) for d in range(6)} == {0: 5, 1: 0, 2: 5, 3: 10, 4: 5, 5: 5}
    assert not set(after) & {k for k in before if day(k) in (1, 3, 4)}
    assert not (tmp_path / "t" / f"day={first + 1}").exists()
    assert overwrite_days(at, spark.createDataFrame(late, SCHEMA)).isEmpty() and files() == after  # a repeated run changes nothing
    assert overwrite_days(at, spark.createDataFrame([], SCHEMA)).isEmpty() and files() == after


def test_odd_rows(spark, tmp_path):
    t = datetime(2024, 5, 1, 12)
    rows = [(None, 1, None, None, None, None, None), (None, 2, None, None, t, t, None), (1, 1, "a", 1.0, t, None, 1), (1, 1, "b", 1.0, t, None, 1), (2, 1, "a", 1.0, t, t, 1), (2, 1, "a", 1.0, t, t, 1), (3, None, None, None, None, t, None)]
    schema = SCHEMA + ", day string, t string, id string, rank int, slice int, file_rows int, arrived int, old int"
    frame = spark.createDataFrame([(*r, "d", "t", "i", 1, 2, 3, 4, 5) for r in rows], schema)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    at = DailyTable(f"file://{tmp_path}/t", frame.select(*names).schema, 2)
    overwrite_days(at, frame)
    got = sorted(((r.sale_id or 0, r.status, r.sold_at, r.day, r.file_no) for r in at.stored(spark).collect()), key=str)
    day = us(t) // late_rows.DAY
    assert got == sorted([(0, None, t, day, 0), (1, "b", t, day, 0), (2, "a", t, day, 1), (3, None, None, -1, 0)], key=str)
    assert overwrite_days(DailyTable(f"file://{tmp_path}/none", at.columns, 2), frame.limit(0)).isEmpty()


def test_slices_split_hot_moments(spark):
    """A third of the rows at one moment, another third within a second: no piece over-full, order kept."""
    rng = random.Random(4)
    rows = [(5, 0, i) for i in range(4_000)] + [(6, 1_000_000 + rng.randrange(1_000_000), -i) for i in range(4_000)] + [(rng.randrange(9), rng.randrange(late_rows.DAY), i) for i in range(4_000)]
    keys = spark.createDataFrame(rows, "day long, t long, id long")
    slices = fit_slices(keys, slice_rows=100, most_rows=300)
    placed = slices.place(keys)
    assert slices.splits and placed.groupBy("day", "slice", "piece").count().agg(F.max("count")).first()[0] <= 300
    got = [(r.day, r.slice, r.piece) for r in placed.orderBy("day", "t", "id").collect()]
    assert got == sorted(got) and len(got) == len(rows)


def test_latest_reduces_before_the_shuffle(spark):
    plan = latest(spark.createDataFrame(sales(50), SCHEMA), "sale_id", "arrived_at")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
