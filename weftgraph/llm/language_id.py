"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle's out-of-place distance)."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .units import plain_columns

_LETTERS: list[np.ndarray] = []
SPACE = 32


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """Runs of one to three characters of the lower-cased text, words padded by a blank on each side
    and all else than letters taken as blanks: 21 bits for each character. Empty without letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = letters()[code]
    if not ink.any():
        return np.zeros(0, np.int64)
    keep = ink.copy()
    keep[1:] |= ink[:-1]
    wide = np.empty(int(keep.sum()) + 2, np.int64)
    wide[0] = wide[-1] = SPACE
    wide[1:-1] = np.where(ink, code, SPACE)[keep]
    if wide[-2] == SPACE:
        wide = wide[:-1]
    two = wide[:-1] << 21 | wide[1:]
    return np.concatenate((wide[wide != SPACE], two, two[:-1] << 21 | wide[2:]))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.concatenate((at, [len(values)])))


def ranked(keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` most frequent keys, most frequent first, ties by key."""
    if len(keys) > depth:
        least = -np.partition(-counts, depth - 1)[depth - 1]
        near = counts >= least
        keys, counts = keys[near], counts[near]
    return keys[np.lexsort((keys, -counts))][:depth]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def learn_profiles(docs: DataFrame, depth: int = 300, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows ``lang, rank, gram``: the ``depth`` most frequent n-grams of each non-null language over
    all its texts, ties by the n-gram's number. Counts are summed in each partition before the shuffle. Null texts teach nothing,
    repeated rows count each, a row without id teaches like any other (``held_out`` takes the CRC of an empty id, 0)."""

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def settle(lang: str) -> None:
            keys, sizes = (np.concatenate(x) for x in zip(*held[lang]))
            order = np.argsort(keys, kind="stable")
            keys, sizes = keys[order], sizes[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            held[lang] = [(keys[at], np.add.reduceat(sizes, at))]

        for batch in batches:
            by: dict[str, list[str]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > 1 << 20:
                    add(held, lang, by.pop(lang), settle)
                    size[lang] = 0
            for lang, texts in by.items():
                add(held, lang, texts, settle)
        for lang in list(held):
            if held[lang]:
                settle(lang)
                keys, sizes = held[lang][0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(sizes.astype(np.int64))], ["lang", "gram", "n"])

    def add(held, lang, texts, settle):
        found = counted(grams(" ".join(texts)))
        if len(found[0]):
            held.setdefault(lang, []).append(found)
            if len(held[lang]) > 16:
                settle(lang)

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("rank", place).where(F.col("rank") <= depth).select("lang", (F.col("rank") - 1).alias("rank"), "gram")


def identify(docs: DataFrame, profiles: DataFrame, depth: int = 300, max_languages: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, lang_pred, score`` for each document: the language whose profile is nearest.

    The distance sums, over the document's ``depth`` most frequent n-grams, how many ranks each is
    out of place, ``depth`` where the profile lacks it; ties go to the first language in order. The
    score is 1 minus the distance's share of the greatest possible. Whole texts are counted.
    ``profiles`` reach all tasks: ``max_languages * depth`` rows at most, else an error.

    Null text, no letter, or no profiles: ``und`` and 0. Null id: returned as null. Repeated rows are judged each, and
    alike. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = profiles.limit(max_languages * depth + 1).collect()
    if len(rows) > max_languages * depth:
        raise ValueError(f"more than {max_languages} languages")
    names = sorted({r.lang for r in rows})
    known = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(known) + 1, max(len(names), 1)), 2 * depth, np.int64)
    for r in rows:
        ranks[np.searchsorted(known, r.gram), names.index(r.lang)] = r.rank
    shared = docs.sparkSession.sparkContext.broadcast((names, known, ranks))

    def classify(batches):
        names, known, ranks = shared.value
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text").to_pylist():
                top = ranked(*counted(grams(text)), depth) if text and names else ()
                if not len(top):
                    found.append("und")
                    scores.append(0.0)
                    continue
                at = np.searchsorted(known, top)
                at[at == len(known)] = 0
                at[known[at] != top] = len(known)
                apart = np.minimum(np.abs(ranks[at] - np.arange(len(top))[:, None]), depth)
                apart[ranks[at] == 2 * depth] = depth
                total = apart.sum(axis=0)
                best = int(total.argmin())
                found.append(names[best])
                scores.append(1 - float(total[best]) / (depth * len(top)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return plain_columns(docs, id_col, text_col).mapInArrow(classify, "doc_id long, lang_pred string, score double")
