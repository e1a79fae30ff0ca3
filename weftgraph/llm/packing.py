"""Harmonic packing of token sequences."""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernels as K
from .memory import tidy
from .units import Chunk, plain_columns, raw_text

#: Whether this machine lays out unsigned 32-bit numbers as the result asks.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Words, and stems and runs of signs, that a worker keeps the ids of.
CACHE_WORDS, CACHE_PARTS = 100_000, 150_000
#: Bytes of text that are encoded at once; a longer document is encoded alone.
ENCODED_BYTES = 1 << 18
#: ASCII signs that stand behind words; the tokenizer cuts between a letter or digit and these.
SIGNS = b".,;:!?*$%&#|()[]{}<>=+-/@^~`_\""
_ENCODERS: dict[str, "WordEncoder"] = {}


def _byte_signs() -> dict[int, str]:
    """The usual stand-in character of each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the others for 256 and on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


class WordEncoder:
    """Token ids of texts by a tokenizer that drops white space and cuts letters, digits and signs
    apart: ids of a text are those of its words one after the other, and ids of a word those of its
    stem and of the signs behind it. So each distinct stem is encoded once; words are told apart by
    64-bit hashes, and a text's ids are gathered from those of its words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ids: dict[int, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        #: A normalised lower-case word of letters is one unit of the merges, so it needs no cutting.
        self.merges = self.tokenizer.model if self._letters_are_units() else None

    def _letters_are_units(self) -> bool:
        self.merges = self.tokenizer.model
        tried = ["a", "word", "ununterbrochen", "\u00e9t\u00e9", "\u03b1\u03b2\u03b3", "\u4e2d\u6587"]
        return all(self._unit(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in tried)

    def forget(self) -> None:
        """Drop the kept ids: a worker goes on to other stages' tasks with its memory."""
        self.ids.clear()
        self.parts.clear()

    def _unit(self, word: str) -> list[int]:
        return [t.id for t in self.merges.tokenize(word if word.isascii() else "".join(map(BYTE_SIGNS.__getitem__, word.encode())))]

    def _raw(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word: by the merges alone where it is one unit, else by the whole tokenizer."""
        found: dict[bytes, bytes] = {}
        rest = words
        if self.merges is not None:
            rest, tokenize, signs = [], self.merges.tokenize, BYTE_SIGNS.__getitem__
            for w in words:
                s = w.decode()
                if not s.isalpha():
                    rest.append(w)
                elif s.isascii():
                    found[w] = _ids([t.id for t in tokenize(s)])
                elif s == s.lower() and unicodedata.is_normalized("NFC", s):
                    found[w] = _ids([t.id for t in tokenize("".join(map(signs, w)))])
                else:
                    rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            found[w] = _ids(e.ids)
        return found

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, from those of its parts."""
        cut: list[tuple[bytes, bytes | None]] = []
        parts = self.parts
        if len(parts) > CACHE_PARTS:
            parts.clear()
        new = set()
        for w in words:
            stem, tail = w.rstrip(SIGNS), None
            if stem != w and stem and (stem[-1:].isalnum() if stem[-1] < 128 else stem.decode().lower()[-1].isalpha()):
                tail = w[len(stem) :]
                if tail not in parts:
                    new.add(tail)
            else:
                stem = w
            if stem not in parts:
                new.add(stem)
            cut.append((stem, tail))
        parts.update(self._raw(list(new)))
        return [parts[stem] if tail is None else parts[stem] + parts[tail] for stem, tail in cut]

    def encode(self, texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text of a column, or of a list of bytes."""
        data, offsets = raw_text(pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts)
        out: list[bytes] = []
        for first, last in K.chunks(np.diff(offsets), ENCODED_BYTES):
            out += self._chunk(Chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower=True))
        return out

    def _chunk(self, chunk: Chunk) -> list[bytes]:
        hashes = chunk.hashes()
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        names, example = ranked[new].tolist(), order[new]
        found = list(map(self.ids.get, names))
        open_ = [i for i, x in enumerate(found) if x is None]
        if open_:
            raw = chunk.data.tobytes()
            places = example[open_]
            learned = self._learn([raw[a:b] for a, b in zip(chunk.starts[places].tolist(), chunk.ends[places].tolist())])
            if len(self.ids) > CACHE_WORDS:
                self.ids.clear()
            for i, x in zip(open_, learned):
                found[i] = self.ids[names[i]] = x
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        length = each[number]
        ends = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(each) - each)[number] - ends[:-1], length)]
        edges = ends[chunk.first]
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Bins of one worker, as harmonic packing fills them. A document of length r belongs to class
    ``k = capacity // r`` and a bin of that class closes at its fixed count of k whole documents. What
    room it has left takes, in this order, whole documents of the smallest classes (above
    ``CLASSES``), longest first; then the next stretch of a document longer than a sequence, which has
    to be cut anyway. A bin for which there is neither waits. Only when ``WAITING`` bins wait, or at
    the end, are documents cut that would have fitted whole. Sequences are full but for the last
    ones, which have a power of two as their length."""

    #: Greatest count of documents that a bin is closed at; bins that may wait; capacities of long documents held back.
    CLASSES, WAITING, RESERVE = 24, 256, 64

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, int, list[tuple]]] = []
        self.small: list[tuple[int, int, tuple]] = []
        self.reserve: deque[tuple] = deque()
        self.held = self.loose = self.serial = 0
        self.closed: list[tuple] = []

    def add(self, doc: int, ids: bytes) -> None:
        total = len(ids) // 4
        piece = (doc, 0, ids, total)
        if total <= self.capacity:
            self._place(piece)
        else:
            self._hold(piece)
            while self.held > self.RESERVE * self.capacity:
                self._shed()
        if self.reserve and self.waiting:
            self._serve()

    def _hold(self, piece: tuple) -> None:
        self.reserve.append(piece)
        self.held += len(piece[2]) // 4

    def _shed(self) -> None:
        """A whole sequence of the oldest long document, or its last part as a document of its own."""
        doc, start, ids, total = self.reserve.popleft()
        length = len(ids) // 4
        take = min(length, self.capacity)
        self.held -= take
        if take < length:
            self.reserve.appendleft((doc, start + take, ids[4 * take :], total))
        if take == self.capacity:
            self._close([(doc, start, ids[: 4 * take], total)])
        else:
            self._place((doc, start, ids, total))

    def _place(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        k = self.capacity // length
        self.serial += 1
        if k > self.CLASSES:
            insort(self.small, (length, self.serial, piece))
            self.loose += length
            if self.loose > 8 * self.capacity:
                self._settle([])
            return
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self._settle(self.open.pop(k))

    def _room(self, pieces: list[tuple]) -> int:
        return self.capacity - sum(len(p[2]) // 4 for p in pieces)

    def _settle(self, pieces: list[tuple]) -> None:
        """Fill a bin's room and close it, or let it wait."""
        room = self._room(pieces)
        while room:
            at = bisect_right(self.small, (room, 1 << 62)) - 1
            if at < 0:
                break
            length, _, piece = self.small.pop(at)
            self.loose -= length
            pieces.append(piece)
            room -= length
        while room and self.reserve:
            room -= self._cut(pieces, room)
        if not room:
            self._close(pieces)
            return
        self.serial += 1
        insort(self.waiting, (room, self.serial, pieces))
        if len(self.waiting) > self.WAITING:
            for piece in self.waiting.pop()[2]:
                self._hold(piece)
            self._serve()

    def _cut(self, pieces: list[tuple], room: int) -> int:
        """Move up to ``room`` ids of the first held document into a bin; how many they were."""
        doc, start, ids, total = self.reserve.popleft()
        take = min(room, len(ids) // 4)
        pieces.append((doc, start, ids[: 4 * take], total))
        if 4 * take < len(ids):
            self.reserve.appendleft((doc, start + take, ids[4 * take :], total))
        self.held -= take
        return take

    def _serve(self) -> None:
        """Fill waiting bins, least room first, from the held documents."""
        while self.reserve and self.waiting:
            room, _, pieces = self.waiting[0]
            if self.held < room:
                break
            self.waiting.pop(0)
            while room:
                room -= self._cut(pieces, room)
            self._close(pieces)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def finish(self) -> None:
        """All that is still open: whole documents into the bins they fit best, longest first; then
        the emptiest bins are taken apart to fill up the others."""
        while self.reserve:
            if len(self.reserve[0][2]) // 4 >= self.capacity:
                self._shed()
            else:
                piece = self.reserve.popleft()
                self.open.setdefault(0, []).append(piece)
        rest = [p for pieces in self.open.values() for p in pieces] + [p for _, _, p in self.small]
        bins = [(room, k, pieces) for k, (room, _, pieces) in enumerate(self.waiting)]
        self.open, self.waiting, self.small, self.held, self.loose = {}, [], [], 0, 0
        for piece in sorted(rest, key=lambda p: -len(p[2])):
            length = len(piece[2]) // 4
            at = bisect_left(bins, (length, -1))
            room, k, pieces = bins.pop(at) if at < len(bins) else (self.capacity, self.serial, [])
            self.serial += 1
            pieces.append(piece)
            insort(bins, (room - length, k, pieces))
        while bins and not bins[0][0]:
            self._close(bins.pop(0)[2])
        while bins:
            if not self.reserve:
                for piece in sorted(bins.pop()[2], key=lambda p: -len(p[2])):
                    self._hold(piece)
                continue
            room, k, pieces = bins.pop(0)
            while room and self.reserve:
                room -= self._cut(pieces, room)
            if room:
                insort(bins, (room, k, pieces))
                if len(bins) == 1:
                    for piece in bins.pop()[2]:
                        self._hold(piece)
            else:
                self._close(pieces)
        while self.reserve:
            room, pieces = self.capacity if self.held >= self.capacity else 1 << (self.held.bit_length() - 1), []
            while room:
                room -= self._cut(pieces, room)
            self._close(pieces)


def harmonic_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, one for each piece of a
    document; ``ids`` holds its little-endian unsigned 32-bit ids.

    A document is its token ids and ``end_id``. Documents are classed by the reciprocal of the capacity
    they fit, and class k closes a bin at its fixed count of k documents (see ``Packer``), so no bin
    waits for a search. Workers pack their own partitions without knowing of others; a sequence id is
    the partition's number and a running one. Documents longer than a sequence are cut to fill the
    bins' rooms; others stay whole as long as there is any.

    Null text: empty, so just ``end_id``. Null id: returned as null. Repeated rows are packed as
    often as they occur. Empty table: no rows. Columns other than the two read are ignored, whatever
    their names. Memory: one batch of texts, and the open and waiting bins (some 400 capacities).
    """

    @tidy
    def pack(batches):
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(part.column("text"))):
                    packer.add(doc, ids + end)
                yield flush(packer)
        packer.finish()
        yield flush(packer)
        encoder(tokenizer_path).forget()

    def flush(packer):
        rows, packer.closed = packer.closed, []
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return plain_columns(docs, id_col, text_col).mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
