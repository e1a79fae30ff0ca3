"""Substring dedup: remove words covered by a run of n words that an earlier document also has."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, sketch
from . import kernels as K
from .memory import tidy
from .units import deal, load, prepared, raw_text, text_bytes, unit_count, windows


def _grouped(table: pa.Table, told: pa.Table, n: int, depth: int, ranges: exchange.Ranges):
    """The unit's windows estimated repeated: their places, and their distinct digests (64 + 32 bits,
    ascending) with the smallest doc_id of this unit, and each window's digest number."""
    (first, second), counts, _ = windows(table.column("text"), n, families=(1, 2))
    places = np.flatnonzero(sketch.estimated_repeats(first, told, depth, ranges))
    hi, lo = first[places], (second[places] >> K.U64(32)).astype(np.uint32)
    doc = np.repeat(table.column("doc_id").to_numpy(), counts)[places]
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    at = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(doc[order], at) if len(at) else np.zeros(0, np.int64)
    return counts, places, doc, number, hi[order][at], lo[order][at], smallest


def remove_repeats(
    docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), unit_bytes: int | None = None, depth: int = 2, fan: int = exchange.FAN
) -> DataFrame:
    """Rows ``doc_id, <carry>, n_words, n_removed, kept_text, removed`` for each document.

    Words are runs of bytes other than white space. A window is ``n`` consecutive words of one
    document; each word that lies in a window whose word sequence also starts in a document with a
    smaller id goes. ``kept_text`` is what stays, joined by single spaces; ``removed`` lists the
    removed stretches as (first word, words).

    Three passes over the dealt texts. (1) Partition sketches of the windows, merged by ranges of
    cells (``sketch``). (2) Windows estimated repeated go to the task of their digest range as one
    entry for each unit, which finds the smallest id of each exactly; one bit for each entry returns.
    (3) Words are removed. Windows are told apart by 96-bit digests. A window in a third of all rows
    is one entry for each unit, so no task gathers a hot group.

    Null text: no words, empty ``kept_text``. Null id: as large as the greatest id, returned as null.
    Rows that share an id do not remove from each other. Texts shorter than ``n`` words stay whole,
    very long ones are read whole. Repeats inside one document stay. Empty table: no rows. Other
    columns are ignored, whatever their names.
    """
    total = text_bytes(docs, text_col)
    units = unit_count(total, unit_bytes)
    cells, digests = exchange.Ranges(units, sketch.bits_for(total), fan), exchange.Ranges(units, 64, fan)
    source = prepared(docs, id_col, text_col, carry)
    dealt = deal(source, units)

    @tidy
    def first_pass(key: tuple[pa.Scalar, ...], unit: pa.Table) -> pa.Table:
        table = load(unit)
        (hashes,), counts, _ = windows(table.column("text"), n)
        return sketch.send(key[0].as_py(), hashes, np.repeat(table.column("doc_id").to_numpy(), counts), depth, cells)

    @tidy
    def second_pass(key: tuple[pa.Scalar, ...], unit: pa.Table, told: pa.Table) -> pa.Table:
        _, _, _, _, hi, lo, smallest = _grouped(load(unit), told, n, depth, cells)
        return exchange.sent(exchange.send(key[0].as_py(), hi, [lo, smallest], digests))

    def smaller_elsewhere(hi: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
        lo, owner = extra
        order = np.lexsort((lo, hi))
        new = np.ones(len(order), bool)
        new[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
        smaller = np.empty(len(order), bool)
        smaller[order] = least[np.cumsum(new) - 1] < owner[order]
        return smaller

    carried = [f"carry_{i}" for i in range(len(carry))]

    @tidy
    def third_pass(key: tuple[pa.Scalar, ...], unit: pa.Table, both: pa.Table) -> pa.Table:
        table = load(unit)
        exact = both.column("exact").to_numpy(zero_copy_only=False).astype(bool)
        told, answer = both.filter(pa.array(~exact)), both.filter(pa.array(exact))
        counts, places, doc, number, hi, _, smallest = _grouped(table, told, n, depth, cells)
        smaller = exchange.told_values(answer, hi, digests, 0, bool)
        hit = places[(doc > smallest[number]) | smaller[number]] if len(places) else places
        ends = np.cumsum(counts)
        cut = np.searchsorted(hit, np.concatenate(([0], ends)))
        data, offsets = raw_text(table.column("text"))
        data = data.tobytes()
        n_words, n_removed, kept, spans = [], [], [], []
        for i in range(table.num_rows):
            words = data[offsets[i] : offsets[i + 1]].split()
            gone = 0
            stretches: list = []
            if cut[i] < cut[i + 1]:
                at = hit[cut[i] : cut[i + 1]] - (ends[i] - counts[i])
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n, -1)
                gone_mask = np.cumsum(cover[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone_mask, [False])).astype(np.int8)))
                stretches = [{"first": int(a), "words": int(b - a)} for a, b in zip(turn[::2], turn[1::2])]
                gone = int(gone_mask.sum())
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(compress(words, ~gone_mask) if gone else words).decode())
            spans.append(stretches)
        return pa.table(
            [pa.array(table.column("doc_id").to_numpy(), mask=table.column("null_id").to_numpy()), *[table.column(c) for c in carried], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])))],
            ["doc_id", *carried, "n_words", "n_removed", "kept_text", "removed"],
        )

    told = sketch.merge(dealt.groupBy("unit").applyInArrow(first_pass, exchange.SENT), cells)
    exact = dealt.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(second_pass, exchange.SENT)
    answer = exchange.ask(exact, digests, smaller_elsewhere)
    both = told.withColumn("exact", F.lit(False)).unionByName(answer.withColumn("exact", F.lit(True)))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join(["doc_id long", *[f"{c} {kinds[c]}" for c in carried], "n_words long, n_removed long, kept_text string, removed array<struct<first:int,words:int>>"])
    out = dealt.groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(third_pass, schema)
    return out.select("doc_id", *[F.col(a).alias(b) for a, b in zip(carried, carry)], "n_words", "n_removed", "kept_text", "removed")
