"""A Count-min sketch too wide for one machine: sparse partition sketches, merged by ranges of cells.

Each unit counts its items into ``depth`` rows of ``2**bits`` saturating counters (1, or 2 and more)
and keeps only the cells it touched, delta-coded. A range of cells of all units meets in one task
(``exchange``), which adds the counters and tells each unit which of its own cells reached 2. Counters
of different items may fall together, so counts are overestimated and never too low: no repeated
item is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange
from . import kernels as K


def bits_for(total_bytes: int) -> int:
    """Cells of a row: four for each byte of text, some 26 for each word, so a row alone flags about
    one unrepeated item in 26 wrongly."""
    return min(62, max(16, int(total_bytes * 4 - 1).bit_length()))


def row_cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each 64-bit item in a row."""
    return (K.mix64(items ^ K.seeded(41 + row, 1)[0]) if row else items) >> K.U64(64 - bits)


def _counted(items: np.ndarray, owner: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit's cells, ascending, and which of them items of two owners reach. A cell that one
    owner reaches twice counts once: only repeats across owners matter."""
    order, cells, at, _ = _runs(row_cells(items, row, bits))
    if not len(at):
        return cells, np.zeros(0, bool)
    owner = owner[order]
    return cells[at], np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)


def _runs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the cells, the sorted cells, where each distinct one starts, and how often it occurs."""
    order = np.argsort(cells)
    ranked = cells[order]
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return order, ranked, at, np.diff(np.append(at, len(ranked)))


def send(unit: int, items: np.ndarray, owner: np.ndarray, depth: int, ranges: exchange.Ranges) -> pa.Table:
    """The unit's sketch, in pieces for each range of each row."""
    rows = []
    for row in range(depth):
        cells, many = _counted(items, owner, row, ranges.bits)
        rows += exchange.send(unit, cells, [many], ranges, row)
    return exchange.sent(rows)


def merge(pieces: DataFrame, ranges: exchange.Ranges) -> DataFrame:
    """Add the counters of all units, range by range; to each unit a bit for each of its cells."""

    def high(cells: np.ndarray, extra: list[np.ndarray]) -> np.ndarray:
        order, _, at, size = _runs(cells)
        out = np.empty(len(cells), bool)
        out[order] = np.repeat((size > 1) | np.logical_or.reduceat(extra[0][order], at), size)
        return out

    return exchange.ask(pieces, ranges, high)


def estimated_repeats(items: np.ndarray, told: pa.Table, depth: int, ranges: exchange.Ranges) -> np.ndarray:
    """Which of the unit's items (the same as were sent) all rows estimate at 2 or more."""
    found = np.ones(len(items), bool)
    if not len(items):
        return found
    for row in range(depth):
        order, cells, at, size = _runs(row_cells(items, row, ranges.bits))
        found[order] &= np.repeat(exchange.told_values(told, cells[at], ranges, row, bool), size)
    return found
