"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from . import exchange
from . import kernels as K
from .joins import spread_join
from .memory import tidy
from .units import deal, load, prepared, raw_text, text_bytes, unit_count, unit_of

#: Order of the model: a byte given the four before it. Texts begin after four line feeds.
ORDER = 5
#: Bytes of text whose n-grams are taken at once, whatever documents they belong to.
PIECE_BYTES = 1 << 18
#: One in ``FOLDS`` trusted documents is not counted, so that limits are set by text the model has not seen.
FOLDS = 5
#: What a document is to the model.
UNKNOWN, COUNTED, HELD = range(3)
TOTALS = "doc long, null_id boolean, lang string, mark long, n_bytes long, nats double, trusted int"


def byte_grams(table: pa.Table, order: int):
    """For pieces of the unit's text: the document and the n-gram that ends there, of each byte."""
    data, offsets = raw_text(table.column("text"))
    for a in range(0, len(data), PIECE_BYTES):
        b = min(a + PIECE_BYTES, len(data))
        first, last = np.searchsorted(offsets, [a, b - 1], side="right") - 1
        edges = np.clip(offsets[first : last + 2], a, b)
        doc = np.repeat(np.arange(first, last + 1), np.diff(edges))
        place = np.arange(a, b)
        before = place - offsets[doc]
        gram = data[a:b].astype(np.int64)
        for j in range(1, order):
            gram |= np.where(before >= j, data[np.maximum(place - j, 0)], 10).astype(np.int64) << (8 * j)
        yield doc, gram


def _shifts(bits: int) -> tuple[int, int, int]:
    return bits // 3 + 2, bits // 2 + 1, bits // 4 + 1


def scrambled(gram: np.ndarray, bits: int) -> np.ndarray:
    """The n-grams as keys that fill their range evenly: three steps of shift and exclusive or, each of which can be undone."""
    a, b, c = (K.U64(x) for x in _shifts(bits))
    key, mask = gram.astype(K.U64), K.U64((1 << bits) - 1)
    key = key ^ (key << a & mask)
    key = key ^ key >> b
    return key ^ (key << c & mask)


def scrambled_column(gram: Column, bits: int) -> Column:
    a, b, c = _shifts(bits)
    key = gram.bitwiseXOR(F.shiftleft(gram, a).bitwiseAND(F.lit((1 << bits) - 1)))
    key = key.bitwiseXOR(F.shiftright(key, b))
    return key.bitwiseXOR(F.shiftleft(key, c).bitwiseAND(F.lit((1 << bits) - 1)))


def unscrambled(key: np.ndarray, bits: int) -> np.ndarray:
    mask, out = K.U64((1 << bits) - 1), key
    for shift, left in zip(reversed(_shifts(bits)), (True, False, True)):
        wanted, s = out, K.U64(shift)
        for _ in range(-(-bits // shift)):
            out = wanted ^ (out << s & mask if left else out >> s)
    return out.astype(np.int64)


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gram = np.concatenate(grams) if grams else np.zeros(0, np.int64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(gram)
    gram, count = gram[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    return gram[at], np.add.reduceat(count, at) if len(at) else count


def unit_grams(table: pa.Table, counted: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit's distinct n-grams, ascending, and how often each occurs in its counted documents."""
    grams, counts = [], []
    for doc, gram in byte_grams(table, order):
        own, number = np.unique(gram, return_inverse=True)
        grams.append(own)
        counts.append(np.bincount(number[counted[doc]], minlength=len(own)))
        if len(grams) > 4:
            grams, counts = ([x] for x in _summed(grams, counts))
    return _summed(grams, counts)


def _discounts(seen: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, from counts of counts."""
    n = seen.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    # where counts of counts are missing: 1/2, 1 and 3/2
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), float(k)) if n[k - 1] * n[k] else spare for k, spare in ((1, 0.5), (2, 1.0), (3, 1.5))]


def _contexts(seen: DataFrame) -> DataFrame:
    c = F.col("c")
    return seen.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), *[F.sum(x.cast("long")).alias(f"m{k}") for k, x in ((1, c == 1), (2, c == 2), (3, c >= 3))])


def _interpolated(asked: DataFrame, seen: DataFrame, lower: DataFrame | None, bits: int) -> DataFrame:
    """Rows ``g, p`` for each asked n-gram: its discounted count and its context's share of the lower order's p."""
    rows = asked.join(seen, "g", "left").withColumn("h", F.shiftright("g", 8)).join(_contexts(seen), "h", "left")
    below = F.lit(1 / 256)
    if lower is not None:
        rows = rows.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << bits) - 1))).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s", "left")
        below = F.col("below")
    d1, d2, d3 = _discounts(seen)
    c = F.coalesce(F.col("c"), F.lit(0))
    cut = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
    freed = d1 * F.col("m1") + d2 * F.col("m2") + d3 * F.col("m3")
    return rows.select("g", F.when(F.col("total") > 0, (c - cut + freed * below) / F.col("total")).otherwise(below).alias("p"))


def kneser_ney(types: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows ``g, p`` from rows ``g, c``: n-grams of ``order`` bytes with their counts in trusted text (0 for
    those only asked about). Lower orders count distinct left neighbours. Each order's counts,
    contexts and lower-order values meet by joins on their n-grams, so the tables are sharded like any
    others. Each order's tables are written, which keeps the plans small."""
    seen, asked, p = {order: types.where("c > 0")}, {order: types.select("g")}, None
    for n in range(order - 1, 0, -1):
        mask = F.lit((1 << 8 * n) - 1)
        seen[n] = materialize(seen[n + 1].groupBy(F.col("g").bitwiseAND(mask).alias("g")).agg(F.count("*").alias("c")), "seen")
        asked[n] = materialize(asked[n + 1].select(F.col("g").bitwiseAND(mask).alias("g")).distinct(), "types")
    for n in range(1, order + 1):
        lower, p = p, materialize(_interpolated(asked[n], seen[n], p, 8 * (n - 1)), "model")
        discard(lower, *((asked[n], seen[n]) if n < order else ()))
    return p


def held_back(doc: Column) -> Column:
    """Whether a trusted document is kept out of the counts, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit("held"), doc), F.lit(FOLDS)) == 0


def perplexities(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", unit_bytes: int | None = None, order: int = ORDER, fan: int = exchange.FAN
) -> DataFrame:
    """Rows ``doc, null_id, lang, mark, n_bytes, nats, trusted`` for each document: the negative log
    probability of its text under the model of all trusted text (``quality`` 1) but for the documents
    ``held_back`` (``trusted`` is COUNTED, HELD or UNKNOWN), in a written table. ``mark`` tells texts of
    one id apart.

    Each unit sends its distinct n-grams, with their counts in its counted documents, to the tasks of
    their ranges (``exchange``); there counts are summed and joined to the model, and the answers go
    back. Texts are dealt twice, as the model lies between: keeping them would take as much space.
    """
    units = unit_count(text_bytes(docs, text_col), unit_bytes)
    ranges = exchange.Ranges(units, 8 * order, fan)
    source = prepared(docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), id_col, text_col, (lang_col, "__mark"))
    source = source.withColumn("carry_0", F.coalesce(F.col("carry_0").cast("string"), F.lit("und")))
    dealt = deal(source, units)
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("long").alias("doc")).where("doc is not null").distinct()
    good = good.select(unit_of(F.col("doc"), units).alias("unit"), "doc", held_back(F.col("doc")).alias("held"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("answer"))

    def standing(table: pa.Table, side: pa.Table) -> np.ndarray:
        ids, real = table.column("doc_id").to_numpy(), ~table.column("null_id").to_numpy()
        held = side.column("held").to_numpy().astype(bool)
        doc = side.column("doc").to_numpy()
        return np.where(real & np.isin(ids, doc[held]), HELD, np.where(real & np.isin(ids, doc[~held]), COUNTED, UNKNOWN))

    @tidy
    def ask(key: tuple[pa.Scalar, ...], unit: pa.Table, side: pa.Table) -> pa.Table:
        table = load(unit)
        gram, count = unit_grams(table, standing(table, side) == COUNTED, order)
        keys = scrambled(gram, ranges.bits)
        place = np.argsort(keys)
        return exchange.sent(exchange.send(key[0].as_py(), keys[place], [count[place]], ranges))

    @tidy
    def add(piece: pa.Table) -> pa.Table:
        keys, extra, _ = exchange.entries(piece)
        gram, count = _summed([unscrambled(keys, ranges.bits)], extra)
        return pa.table([pa.array(gram), pa.array(count)], ["g", "c"])

    def answer(keys: np.ndarray, extra: list[np.ndarray], model: pa.Table) -> np.ndarray:
        known = scrambled(model.column("g").to_numpy(), ranges.bits)
        by = np.argsort(known)
        return -np.log(model.column("p").to_numpy()[by[np.searchsorted(known[by], keys)]]).astype(np.float32)

    @tidy
    def total_up(key: tuple[pa.Scalar, ...], unit: pa.Table, side: pa.Table) -> pa.Table:
        names = ["doc", "null_id", "lang", "mark", "n_bytes", "nats", "trusted"]
        if not unit.num_rows:  # labels of documents that are not there
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            return pa.table([pa.array([], t) for t in kinds], names)
        table = load(unit)
        is_told = side.column("shard").is_valid()
        trusted = standing(table, side.filter(pc.invert(is_told)))
        known, _ = unit_grams(table, np.zeros(table.num_rows, bool), order)
        keys = scrambled(known, ranges.bits)
        place = np.argsort(keys)
        nats = np.empty(len(keys))
        nats[place] = exchange.told_values(side.filter(is_told), keys[place], ranges, 0, np.float32)
        sums, sizes = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64)
        for doc, gram in byte_grams(table, order):
            own, number = np.unique(gram, return_inverse=True)
            low = int(doc[0])
            part = np.bincount(doc - low, weights=nats[np.searchsorted(known, own)][number])
            sums[low : low + len(part)] += part
            sizes[low : low + len(part)] += np.bincount(doc - low)
        return pa.table([table.column("doc_id"), table.column("null_id"), table.column("carry_0"), table.column("carry_1"), pa.array(sizes), pa.array(sums), pa.array(trusted, pa.int32())], names)

    asked = materialize(dealt.groupBy("unit").cogroup(good.groupBy("unit")).applyInArrow(ask, exchange.SENT), "asked")
    if ranges.parts == 1:
        types = asked.groupBy("shard").applyInArrow(add, "g long, c long")
    else:
        part = asked.withColumn("grp", F.expr(f"unit div {ranges.parts}")).groupBy("shard", "grp").applyInArrow(add, "g long, c long")
        types = part.groupBy("g").agg(F.sum("c").alias("c"))
    types = materialize(types, "types")
    model = kneser_ney(types, order)
    placed = model.withColumn("k", scrambled_column(F.col("g"), ranges.bits))
    unweighted = asked.withColumn("extra", F.array().cast("array<binary>"))  # an answer needs no counts
    told = exchange.ask(unweighted, ranges, answer, placed.select("g", "p", *ranges.place("k")))
    side = good.unionByName(told.select("unit", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("boolean").alias("held"), "shard", "answer"))
    out = materialize(dealt.groupBy("unit").cogroup(side.groupBy("unit")).applyInArrow(total_up, TOTALS), "perplexities")
    discard(asked, types, model)
    return out


def classify_quality(
    docs: DataFrame, labels: DataFrame, low: float = 0.001, high: float = 0.995, prior: float = 50.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", unit_bytes: int | None = None, order: int = ORDER, fan: int = exchange.FAN
) -> DataFrame:
    """Rows ``doc_id, lang, mark, n_bytes, perplexity, z, accept`` for each document.

    ``z`` is how far the text's log perplexity per byte lies from its language's mean over trusted text
    the model has not seen, times the square root of its bytes, so that short and long texts compare. A
    document is accepted if ``z`` is at most the ``high`` quantile of its language's unseen trusted
    documents and at least the ``low`` quantile of all its trusted ones: too surprising is noise, far
    too predictable is repetition. A language's mean and quantiles are weighted with those of all
    languages as if these were ``prior`` documents more, so a language of few trusted texts is judged
    by both, and one without by the latter.

    Null or empty text: perplexity and ``z`` null, not accepted. Null language: ``und``. Null id:
    returned as null, never trusted. Repeated rows are judged each, and alike. Texts of any length
    are read whole. No unseen trusted text: the seen ones stand in; no trusted text at all:
    everything with text is accepted. Empty table: no rows. Columns other than those read are
    ignored, whatever their names.
    """
    rows = perplexities(docs, labels, id_col, text_col, lang_col, unit_bytes=unit_bytes, order=order, fan=fan)
    seen = rows.where("n_bytes > 0").groupBy("trusted").count().collect()
    judges = next((k for k in (HELD, COUNTED) if any(r.trusted == k for r in seen)), None)
    unseen, trusted = (F.col("n_bytes") > 0) & (F.col("trusted") == judges), (F.col("n_bytes") > 0) & (F.col("trusted") != UNKNOWN)
    over = lambda rows, what: F.sum(F.when(unseen, F.col(what)))
    known = rows.agg((over(rows, "nats") / over(rows, "n_bytes")).alias("mean")).first().mean if judges else 0.0
    weighed = lambda own, n, all_: (F.coalesce(F.col(own) * F.col(n), F.lit(0.0)) + prior * all_) / (F.col(n) + prior)
    means = rows.groupBy("lang").agg((over(rows, "nats") / over(rows, "n_bytes")).alias("own"), F.count(F.when(unseen, 1)).alias("docs"))
    scored = spread_join(rows, materialize(means.select("lang", weighed("own", "docs", known).alias("mean")), "means"), ["lang"])
    scored = materialize(scored.withColumn("z", F.when(F.col("n_bytes") > 0, (F.col("nats") - F.col("n_bytes") * F.col("mean")) / F.sqrt(F.col("n_bytes").cast("double")))), "scored")
    bounds = lambda: [F.percentile_approx(F.when(trusted, F.col("z")), low, 20_000).alias("a"), F.percentile_approx(F.when(unseen, F.col("z")), high, 20_000).alias("b")]
    every = scored.agg(*bounds()).first() if judges else None
    accept = F.col("n_bytes") > 0
    if every is not None and every.b is not None:
        limits = scored.groupBy("lang").agg(*bounds(), F.count(F.when(trusted, 1)).alias("na"), F.count(F.when(unseen, 1)).alias("nb"))
        limits = materialize(limits.select("lang", weighed("a", "na", every.a).alias("least"), weighed("b", "nb", every.b).alias("most")), "limits")
        scored = spread_join(scored, limits, ["lang"])
        accept = accept & F.col("z").between(F.col("least"), F.col("most"))
    return scored.select(
        F.when(~F.col("null_id"), F.col("doc")).alias("doc_id"), "lang", "mark", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(F.col("nats") / F.col("n_bytes"))).alias("perplexity"),
        "z", F.coalesce(accept, F.lit(False)).alias("accept"), (F.col("trusted") == HELD).alias("held_out"),
    )
