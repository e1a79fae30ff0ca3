"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import folder_for

from .decontaminate import find_contamination
from .fill_middle import fill_in_middle, restored
from .hilbert import hilbert_shards
from .late_rows import DailyTable, describe_files, micros, overwrite_days
from .language_id import held_out, identify, learn_profiles
from .media import media_columns
from .ngram_join import near_duplicates
from .packing import harmonic_pack
from .quality import classify_quality
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_repeated_bytes
from .toxicity import learn, score_toxicity
from .url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d) q),
least_doc AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, p + k AS p FROM (SELECT doc_id, p, unnest(range(13)) AS k FROM win JOIN least_doc USING (s) WHERE doc_id > f) q),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows over all documents."""
    found = remove_repeats(table(spark, sf_dir, "documents"), n=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words, 75 %, all documents. Links by transitive closure: tested against brute force."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=75)


@query("op3_hilbert_sharding")
def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents, counts at most one apart."""
    placed = hilbert_shards(table(spark, sf_dir, "documents"), shards=8, dims=("lang", "source", "n_chars"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell", "curve")


#: The rules of the contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(
    "op4_url_filter",
    r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'allow'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'block'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'allow'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
FROM p
""",
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules over the urls of all pages."""
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def packing_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_harmonic_packing")
def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens. Tested by an exact round trip."""
    packed = harmonic_pack(table(spark, sf_dir, "documents"), packing_vocabulary(), capacity=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    "op8_benchmark_decontamination",
    r"""
WITH t AS (SELECT 0 AS item, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT item, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT DISTINCT item, id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT item, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0) q),
q AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM s WHERE item = 1)
SELECT s.id AS doc_id, item_id, n_item, count(*) AS n_shared FROM s JOIN q USING (s) WHERE s.item = 0 GROUP BY s.id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
""",
)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against all documents: five words, 75 % of the item's shingles."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=5, percent=75)


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of 300 n-grams from three folds of four, all documents classified. Tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, learn_profiles(docs.where(~out), depth=300), depth=300)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned on four folds of five, all documents scored. Tested by held-out accuracy."""
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    scorer = learn(docs, table(spark, sf_dir, "labels").where(~out), sample_rows=20_000)
    return score_toxicity(docs, scorer).select("doc_id", out.alias("held_out"), "score", "predicted", "clauses")


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted text: all documents labelled of quality 1. All documents are scored."""
    found = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "n_bytes", "perplexity", "z", F.col("accept").cast("int").alias("predicted"), "held_out")


@query("op9_media_columns")
def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as grey pictures in tar shards, read back. Tested by an exact round trip."""
    found = media_columns(table(spark, sf_dir, "documents"))
    feature = F.format_string("png %dx%dx%d distinct=%d mean=%.3f", "width", "height", "bits", "distinct_bytes", F.col("mean_milli") / 1000)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "digest", "shard", "offset", "length")


@query("op12_fill_in_middle")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, seed 7, every text, half of them suffix first. Tested by brute force and round trip."""
    found = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def sales_with_copies(sales: DataFrame) -> DataFrame:
    """The contract's rows: all sales, and later copies of a third of those of every seventh day."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    day = F.coalesce(F.floor(micros(sales, "sold_at") / F.lit(86_400_000_000)), F.lit(-1))
    later = lambda c, days: F.col(c) + F.make_dt_interval(days.cast("int"))
    moved = {"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)}
    copies = sales.where((h % 3 == 0) & (day % 7 == 0)).select(*[moved[c].cast(sales.schema[c].dataType).alias(c) if c in moved else F.col(c) for c in sales.columns])
    return sales.unionByName(copies)


@query("op13_late_rows")
def op13_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales as daily files, then the late rows brought in. Writes files, so it is tested against brute force."""
    sales = table(spark, sf_dir, "sales")
    at = DailyTable(folder_for(spark, "late-rows"), sales.schema, 1 + sales.count() // 700)
    rows = sales_with_copies(sales)
    early = micros(rows, "arrived_at") < 1_712_707_200_000_000  # 2024-04-10 00:00 UTC
    overwrite_days(at, rows.where(early))
    changed = overwrite_days(at, rows.where(~F.coalesce(early, F.lit(False))))
    stored = at.stored(spark)
    files = describe_files(at, spark, [F.col("sale_id"), micros(stored, "sold_at"), micros(stored, "arrived_at")], F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)))
    told = files.join(changed.withColumn("changed", F.lit(True)), "day", "left").withColumn("rewritten", F.coalesce("changed", F.lit(False)))
    local = F.regexp_replace("path", "^file:/+", "/")  # as any reader of this machine takes it; other stores keep their scheme
    return told.select("day", "file_no", "n_rows", "cents", "rows_crc", local.alias("path"), "columns", "ids_sha256", "rewritten")


@query("op11_suffix_array_dedup")
def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes over all documents. Tested by brute force."""
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"), n=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
