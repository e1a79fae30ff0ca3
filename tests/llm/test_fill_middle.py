"""Fill-in-the-middle against brute force, in one task and over tasks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm.fill_middle import fill_in_middle, restored


def brute(doc, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(5)
    pieces = ["\n", "a", "ß", "€", "😀", "<", "P", ">", "\r", " ", "\n\n", "line"]
    out = [(i, "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 20, 200])))) for i in range(300)]
    out += [(900, None), (901, ""), (902, "\n"), (903, "\n\n\n"), (904, "one line"), (905, "x<P"), (906, "<P>"), (907, "a\n<M>\nb"), (908, "<S"), (909, "P>"), (None, "no\nid\n"), (-5, "minus\none\ntwo")]
    out += [(910, "é\n" * 3000), (911, "y" * 5000), (912, "z\n" * 2000 + "<S>"), (913, "end<P" + "q" * 11 + "\n" * 900 + ">")]
    return out + out[3:6] + out[-4:-2]


@pytest.mark.parametrize("chunk_bytes, long_bytes", [(64 << 10, 4 << 20), (7, 1 << 20), (5, 40), (64, 0)])
def test_against_brute_force(spark, chunk_bytes, long_bytes):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in data], "doc_id long, text string, n int, form string, id int, chunk int")
    got = fill_in_middle(docs, chunk_bytes=chunk_bytes, long_bytes=long_bytes)
    found = got.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in found), key=order) == sorted((brute(i, t) for i, t in data), key=order)
    texts = sorted((r.doc_id or 0, r.again) for r in found)
    assert texts == sorted((i or 0, t or "") for i, t in data)
    assert fill_in_middle(docs.limit(0), long_bytes=long_bytes).count() == 0


def test_rates(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    for rate, spm in ((0, 50), (40, 0), (70, 100)):
        got = {(r.doc_id, r.form, r.output) for r in fill_in_middle(docs, rate=rate, spm_rate=spm, long_bytes=500).collect()}
        assert got == {(x[0], x[2], x[5]) for x in (brute(i, t, rate, spm) for i, t in rows())}
