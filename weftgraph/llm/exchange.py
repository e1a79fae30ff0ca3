"""Entries of many units meet by ranges of their key, and an answer to each entry returns to its unit.

A unit cuts its ascending keys into ``shards`` ranges, ``FAN`` at most, and sends a row for each. Where
ranges would be too large for one task, each has ``parts``: pieces of ``parts`` units are first merged and
cut into the parts, those meet, and the answers go back the same way. So the rows grow with the
units, and not with units times ranges, and what a task holds stays the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .memory import tidy

SENT = "shard int, unit int, n int, keys binary, extra array<binary>"
TOLD = "unit int, shard int, answer binary"
#: Ranges that a unit cuts its keys into at most.
FAN = 1024
#: Ranges at least, so that small inputs use more than one task.
LEAST = 16


class Ranges:
    """How keys below ``2**bits`` are cut for a number of units: those of two units meet in a task."""

    def __init__(self, units: int, bits: int, fan: int = FAN):
        wanted = max(LEAST, units // 2)
        self.bits, self.shards = bits, min(wanted, fan)
        self.parts = -(-wanted // self.shards)

    def borders(self, keys: np.ndarray, shard: int | None = None) -> np.ndarray:
        """Where ascending keys are cut: into all shards, or one shard's keys into its parts."""
        if shard is None:
            first, count, of = 0, self.shards, self.shards
        else:
            first, count, of = shard % self.shards * self.parts, self.parts, self.shards * self.parts
        limits = np.array([-(-((first + k) << self.bits) // of) for k in range(1, count)], dtype=K.U64)
        return np.concatenate(([0], np.searchsorted(keys, limits, side="left"), [len(keys)])).astype(np.int64)

    def place(self, key: str) -> list[Column]:
        """``shard`` and ``part`` of a column of keys."""
        at = lambda n: F.expr(f"cast(cast({key} as decimal(20, 0)) * {n} div {1 << self.bits} as int)")
        return [at(self.shards).alias("shard"), (at(self.shards * self.parts) % self.parts).alias("part")]


def pack(values: np.ndarray) -> bytes:
    """A column of entries: flags as bits, 64-bit numbers by a table of those that occur, else as they are."""
    if values.dtype == bool:
        return b"b" + np.packbits(values).tobytes()
    if values.dtype == np.int64:
        table, at = np.unique(values, return_inverse=True)
        if len(table) <= 65536:
            small = np.uint8 if len(table) <= 256 else np.uint16
            return (b"s" if small is np.uint8 else b"t") + len(table).to_bytes(4, "little") + table.tobytes() + at.astype(small).tobytes()
    return b"r" + values.dtype.char.encode() + values.tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    kind = blob[:1]
    if kind == b"b":
        return np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), count=n).astype(bool)
    if kind == b"r":
        return np.frombuffer(blob, np.dtype(blob[1:2].decode()), offset=2)
    size = int.from_bytes(blob[1:5], "little")
    return np.frombuffer(blob, np.int64, size, 5)[np.frombuffer(blob, np.uint8 if kind == b"s" else np.uint16, offset=5 + 8 * size)]


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"keys": pa.binary(), "extra": pa.list_(pa.binary()), "answer": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(list(c), kinds.get(n, pa.int32())) for c, n in zip(columns, names)], names)


def send(unit: int, keys: np.ndarray, extra: list[np.ndarray], ranges: Ranges, row: int = 0) -> list[tuple]:
    """The unit's rows of ``SENT`` for ascending keys. ``row`` keeps several tables of keys apart."""
    at = ranges.borders(keys).tolist()
    return [(row * ranges.shards + k, unit, b - a, K.pack_sorted(keys[a:b]), [pack(x[a:b]) for x in extra]) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]


def sent(rows: list[tuple]) -> pa.Table:
    return _rows(rows, ["shard", "unit", "n", "keys", "extra"])


def entries(piece: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Keys and columns of all rows laid end to end, and the rows' sizes."""
    sizes = piece.column("n").to_numpy().astype(np.int64)
    keys = np.concatenate([K.unpack_sorted(x) for x in piece.column("keys").to_pylist()] or [np.zeros(0, K.U64)])
    extra = [[unpack(x, n) for x in row] for row, n in zip(piece.column("extra").to_pylist(), sizes.tolist())]
    return keys, [np.concatenate(x) for x in zip(*extra)], sizes


def _answers(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [pack(values[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]


def ask(pieces: DataFrame, ranges: Ranges, answer: Callable, facts: DataFrame | None = None) -> DataFrame:
    """Rows of ``TOLD``: to each row of ``SENT`` what ``answer(keys, extra)`` says of its entries, given
    all entries of its range; and the ``facts`` (with ``shard`` and ``part``) of that range, if any."""

    def merged(piece: pa.Table):
        piece = piece.sort_by("unit")
        keys, extra, sizes = entries(piece)
        order = np.argsort(keys)
        return piece, order, keys[order], [x[order] for x in extra], sizes

    def once(piece: pa.Table, known: pa.Table | None = None) -> pa.Table:
        keys, extra, sizes = entries(piece)
        values = answer(keys, extra) if known is None else answer(keys, extra, known)
        return pa.table([piece.column("unit"), piece.column("shard"), pa.array(_answers(values, sizes), pa.binary())], ["unit", "shard", "answer"])

    def gather(key: tuple[pa.Scalar, ...], piece: pa.Table) -> pa.Table:
        shard, group = key[0].as_py(), key[1].as_py()
        _, _, keys, extra, _ = merged(piece)
        at = ranges.borders(keys, shard).tolist()
        rows = [(shard, j, group, b - a, K.pack_sorted(keys[a:b]), [pack(x[a:b]) for x in extra]) for j, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]
        return _rows(rows, ["shard", "part", "grp", "n", "keys", "extra"])

    def meet(piece: pa.Table, known: pa.Table | None = None) -> pa.Table:
        keys, extra, sizes = entries(piece)
        values = answer(keys, extra) if known is None else answer(keys, extra, known)
        return piece.select(["shard", "part", "grp", "n"]).append_column("answer", pa.array(_answers(values, sizes), pa.binary()))

    @tidy
    def back(piece: pa.Table, told: pa.Table) -> pa.Table:
        piece, order, _, _, sizes = merged(piece)
        told = told.sort_by("part")
        values = np.concatenate([unpack(x, n) for x, n in zip(told.column("answer").to_pylist(), told.column("n").to_pylist())])
        own = np.empty_like(values)
        own[order] = values
        return pa.table([piece.column("unit"), piece.column("shard"), pa.array(_answers(own, sizes), pa.binary())], ["unit", "shard", "answer"])

    if ranges.parts == 1:
        if facts is None:
            return pieces.groupBy("shard").applyInArrow(tidy(lambda piece: once(piece)), TOLD)
        return pieces.groupBy("shard").cogroup(facts.groupBy("shard")).applyInArrow(tidy(lambda piece, known: once(piece, known) if piece.num_rows else _rows([], ["unit", "shard", "answer"])), TOLD)
    grouped = pieces.withColumn("grp", F.expr(f"cast(unit div {ranges.parts} as int)"))
    cut = grouped.groupBy("shard", "grp").applyInArrow(tidy(gather), "shard int, part int, grp int, n int, keys binary, extra array<binary>")
    schema = "shard int, part int, grp int, n int, answer binary"
    if facts is None:
        met = cut.groupBy("shard", "part").applyInArrow(tidy(lambda piece: meet(piece)), schema)
    else:
        met = cut.groupBy("shard", "part").cogroup(facts.groupBy("shard", "part")).applyInArrow(tidy(lambda piece, known: meet(piece, known) if piece.num_rows else _rows([], ["shard", "part", "grp", "n", "answer"])), schema)
    return grouped.groupBy("shard", "grp").cogroup(met.groupBy("shard", "grp")).applyInArrow(back, TOLD)


def told_values(told: pa.Table, keys: np.ndarray, ranges: Ranges, row: int, kind) -> np.ndarray:
    """The answers to the unit's ascending keys, in their order."""
    blobs = dict(zip(told.column("shard").to_pylist(), told.column("answer").to_pylist()))
    at = ranges.borders(keys).tolist()
    return np.concatenate([np.zeros(0, kind)] + [unpack(blobs[row * ranges.shards + k], b - a) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b])
