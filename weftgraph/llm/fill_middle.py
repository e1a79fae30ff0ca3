"""Fill-in-the-middle: texts cut at two drawn line borders, written as prefix, suffix, middle or suffix, prefix, middle.

A text is looked at in chunks that overlap their left neighbour by a few bytes, so that what a chunk counts hangs
on adjacent characters of its own only: a line starts where the character before is a line feed. Counts
of lines and code points are summed over the chunks before; each of the two cuts then lies in one chunk, which
alone is scanned for its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialize
from . import kernels as K
from .memory import tidy
from .units import raw_text

#: Bytes of a chunk, and of a text from which its chunks are dealt over the tasks.
CHUNK_BYTES, LONG_BYTES = 64 << 10, 4 << 20
#: Bytes of the left neighbour that a chunk sees: one less than a marker's.
OVERLAP = 2
#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEWLINE = 10


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 of the SHA-256 of ``seed:doc_id`` (null: of ``seed:``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def line_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a line starts: after a line feed and at the given starts of texts, never at a text's end."""
    out = np.zeros(len(data), bool)
    np.equal(data[:-1], NEWLINE, out=out[1:])
    out[first] = True
    return out


def marker_ends(data: np.ndarray) -> np.ndarray:
    """Places of the last byte of a marker, by three adjacent bytes."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    kind = data[1:-1]
    found = (data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((kind == ord("P")) | (kind == ord("S")) | (kind == ord("M")))
    return np.flatnonzero(found) + 2


def leads(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def _cut_batch(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, chunk_bytes: int):
    """Of texts laid end to end: the number of lines, byte and code-point places of both cuts, and whether a marker occurs."""
    sizes = np.diff(offsets)
    per = -(-sizes // chunk_bytes)
    doc = np.repeat(np.arange(len(sizes)), per)
    chunk = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[doc] + chunk * chunk_bytes
    end = np.minimum(start + chunk_bytes, offsets[doc + 1])
    begins, code = line_starts(data, offsets[:-1][sizes > 0]), leads(data)
    lines = np.add.reduceat(begins, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    points = np.add.reduceat(code, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    line_sum, point_sum = np.concatenate(([0], np.cumsum(lines))), np.concatenate(([0], np.cumsum(points)))
    first = np.concatenate(([0], np.cumsum(per)))
    n = line_sum[first[1:]] - line_sum[first[:-1]]
    marked = np.zeros(len(sizes), bool)
    ends = marker_ends(data)
    owner = np.searchsorted(offsets, ends, side="right") - 1
    marked[owner[ends - 2 >= offsets[owner]]] = True
    ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    place, chars = np.empty_like(ranks), np.empty_like(ranks)
    for j in range(2):
        inner = np.flatnonzero(ranks[:, j] < n)
        place[:, j], chars[:, j] = sizes, point_sum[first[1:]] - point_sum[first[:-1]]
        aim = line_sum[first[inner]] + ranks[inner, j]
        own = np.searchsorted(line_sum, aim, side="right") - 1
        for i, k, rank in zip(inner.tolist(), own.tolist(), (aim - line_sum[own]).tolist()):
            at = int(start[k] + np.flatnonzero(begins[start[k] : end[k]])[rank])
            place[i, j] = at - offsets[i]
            chars[i, j] = point_sum[k] - point_sum[first[i]] + np.count_nonzero(code[start[k] : at])
    return n, place, chars, marked


def form_of(empty, marked, h3, h4, rate: int, spm_rate: int):
    """plain, spm or psm, as Spark columns."""
    return F.when(empty | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")


def _in_one_task(docs: DataFrame, chunk_bytes: int, rate: int, spm_rate: int) -> DataFrame:
    @tidy
    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            all_data, all_offsets = raw_text(batch.column("text"))
            all_h = np.stack([batch.column(f"h{k}").to_numpy() for k in range(1, 5)], axis=1)
            for a, b in K.chunks(np.diff(all_offsets)):
                data, offsets, h = all_data[all_offsets[a] : all_offsets[b]], all_offsets[a : b + 1] - all_offsets[a], all_h[a:b]
                n, place, chars, marked = _cut_batch(data, offsets, h, chunk_bytes)
                plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
                spm = h[:, 3] % 100 < spm_rate
                raw, out, forms = data.tobytes(), [], []
                p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
                for i, (x, y) in enumerate(place.tolist()):
                    text = raw[offsets[i] : offsets[i + 1]]
                    if plain[i]:
                        out.append(text)
                    elif spm[i]:
                        out.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                    else:
                        out.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
                    forms.append("plain" if plain[i] else "spm" if spm[i] else "psm")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(forms), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1] - chars[:, 0], mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _over_tasks(docs: DataFrame, chunk_bytes: int, rate: int, spm_rate: int) -> DataFrame:
    """The same for very long texts: their chunks are dealt over the tasks. Texts are known by id and SHA-256."""
    key = ["id", "mark"]
    docs = docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark": F.sha2("text", 256)})

    @tidy
    def pieces(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py().encode()
                for k, at in enumerate(range(0, len(text), chunk_bytes)):
                    seen = text[max(0, at - OVERLAP) : at + chunk_bytes]
                    yield pa.RecordBatch.from_pydict({"id": [batch.column("id")[i].as_py()], "mark": [batch.column("mark")[i].as_py()], "chunk": pa.array([k], pa.int64()), "seen": pa.array([seen], pa.binary())})

    @tidy
    def count(batches):
        for batch in batches:
            rows = []
            for chunk, seen in zip(batch.column("chunk").to_pylist(), batch.column("seen").to_pylist()):
                data, skip = np.frombuffer(seen, np.uint8), OVERLAP if chunk else 0
                rows.append((int(line_starts(data, np.arange(chunk == 0))[skip:].sum()), int(leads(data[skip:]).sum()), bool(len(marker_ends(data)))))
            lines, points, marked = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "mark", "chunk", "seen")] + [pa.array(lines, pa.int64()), pa.array(points, pa.int64()), pa.array(marked, pa.bool_())], ["id", "mark", "chunk", "seen", "lines", "points", "marked"])

    @tidy
    def scan(batches):
        for batch in batches:
            rows = []
            for chunk, seen, rank in zip(*(batch.column(c).to_pylist() for c in ("chunk", "seen", "rank"))):
                data, skip = np.frombuffer(seen, np.uint8), OVERLAP if chunk else 0
                at = int(np.flatnonzero(line_starts(data, np.arange(chunk == 0))[skip:])[rank])
                rows.append((at, int(leads(data[skip : skip + at]).sum())))
            at, points = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "mark", "chunk", "j", "before")] + [pa.array(at, pa.int64()), pa.array(points, pa.int64())], ["id", "mark", "chunk", "j", "before", "at", "points"])

    cut = docs.select(*key, "text").dropDuplicates(key).mapInArrow(pieces, "id string, mark string, chunk long, seen binary")
    counted = materialize(cut.repartition(*key, "chunk").mapInArrow(count, "id string, mark string, chunk long, seen binary, lines long, points long, marked boolean"), "fim-chunks")
    # a row for each chunk of a text: its counts and those of all chunks before it
    earlier = W.partitionBy(*key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = counted.select(*key, "chunk", "lines", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("first_line"), F.coalesce(F.sum("points").over(earlier), F.lit(0)).alias("before"))
    whole = counted.groupBy(*key).agg(F.sum("lines").alias("n"), F.sum("points").alias("chars"), F.max("marked").alias("marked"))
    drawn = docs.select(*key, "h1", "h2", "h3", "h4", F.octet_length("text").cast("long").alias("bytes")).dropDuplicates(key).join(whole, key)
    r1, r2 = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    drawn = materialize(drawn.withColumns({"c0": F.least(r1, r2), "c1": F.greatest(r1, r2)}), "fim-drawn")
    cuts = drawn.select(*key, F.posexplode(F.array("c0", "c1")).alias("j", "cut"))
    routed = cuts.join(sums, key).where("cut >= first_line and cut < first_line + lines").select(*key, "chunk", "j", "before", (F.col("cut") - F.col("first_line")).alias("rank"))
    found = routed.join(counted.select(*key, "chunk", "seen"), [*key, "chunk"]).mapInArrow(scan, "id string, mark string, chunk long, j int, before long, at long, points long")
    pick = lambda j, c: F.max(F.when(F.col("j") == j, c))
    placed = found.groupBy(*key).agg(*[f.alias(f"{n}{j}") for j in range(2) for n, f in (("at", pick(j, F.col("chunk") * chunk_bytes + F.col("at"))), ("p", pick(j, F.col("before") + F.col("points"))))])
    known = drawn.join(placed, key, "left").select(
        *key, "n", form_of(F.col("n") == 0, F.col("marked"), F.col("h3"), F.col("h4"), rate, spm_rate).alias("form"),
        *[F.coalesce(f"at{j}", "bytes").alias(f"at{j}") for j in range(2)], *[F.coalesce(f"p{j}", "chars").alias(f"p{j}") for j in range(2)],
    )
    joined = docs.select("doc_id", *key, F.col("text").cast("binary").alias("b")).join(known, key)
    prefix, middle, suffix = F.expr("substring(b, 1, cast(at0 as int))"), F.expr("substring(b, cast(at0 as int) + 1, cast(at1 - at0 as int))"), F.expr("substring(b, cast(at1 as int) + 1)")
    mark = lambda m: F.lit(m).cast("binary")
    output = F.when(F.col("form") == "plain", F.col("b")).when(F.col("form") == "spm", F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)).otherwise(F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle))
    cut_up = F.col("form") != "plain"
    return joined.select("doc_id", "n", "form", F.when(cut_up, F.col("p0")).alias("prefix_chars"), F.when(cut_up, F.col("p1") - F.col("p0")).alias("middle_chars"), output.cast("string").alias("output"))


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, long_bytes: int = LONG_BYTES
) -> DataFrame:
    """Rows ``doc_id, n, form, prefix_chars, middle_chars, output``, one for each row of ``docs``.

    A text has ``n`` lines (with their line feed; the last may lack it). The prefix ends after the smaller
    of two drawn numbers of lines, the middle after the larger; both are drawn evenly from 0 to n
    by a hash of ``seed`` and the id. ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of those
    suffix first; a text that is empty or holds a marker stays ``plain``, its lengths null.

    Texts up to ``long_bytes`` are cut where they are read, all chunks of a batch at once, and nothing is
    shuffled. Longer ones have their chunks dealt over all tasks, and only counts of chunks
    meet by text; what is gathered of a text is a row for each chunk.

    Null text: as an empty one, plain, ``n`` 0. Null id: drawn from the seed alone. Rows that repeat an id
    and text come out alike. Texts of one line, or with line feeds only, are cut like others. Empty table: no
    rows. Columns other than the two read are ignored, whatever their names.
    """
    own = F.col(id_col).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws(own, seed))
    is_long = F.octet_length("text") > long_bytes
    out = _in_one_task(rows.where(~is_long), chunk_bytes, rate, spm_rate)
    if rows.where(is_long).isEmpty():
        return out
    return out.unionByName(_over_tasks(rows.where(is_long), chunk_bytes, rate, spm_rate))


def restored(output: Column, form: Column) -> Column:
    """The text again. A text with a marker stays plain, so each marker of another output is a border."""
    part = lambda k: F.element_at(F.split(output, "<[PSM]>", -1), k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))
