"""Media columns: content-addressed payloads in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import folder_for, materialize
from .joins import spread_join
from .units import plain_columns

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a picture that hold all its metadata: the signature and the IHDR chunk.
HEADER_BYTES = 33
#: Digests a task remembers, and bytes after which it opens another shard.
REMEMBERED, SHARD_BYTES = 200_000, 1 << 30
#: Stored bytes that one task reads back.
READ_BYTES = 32 << 20


def payload_of(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """The payload as the 8-bit samples of a grey picture, 64 wide."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored picture")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples again."""
    width, height, _ = png_header(media)
    at, packed = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def remove_orphans(folder: str, rows: DataFrame) -> None:
    """Delete shards of ``folder`` that no row names: those of attempts that failed or came second."""
    from pyarrow import fs

    named = {r.shard.rpartition("/")[2] for r in rows.select("shard").distinct().collect()}
    store, path = _open(folder)
    for found in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if found.base_name.endswith(".tar") and found.base_name not in named:
            store.delete_file(found.path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """A tar file being written."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        store, path = _open(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at = store.open_output_stream(path), 0

    def add(self, name: str, media: bytes) -> int:
        """Append a member; the offset of its bytes."""
        info = tarfile.TarInfo(name)
        info.size = len(media)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.out.write(media + b"\0" * (-len(media) % 512))
        offset = self.at + 512
        self.at = offset + len(media) + -len(media) % 512
        return offset

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write each text's payload as a member ``<sha256 of the payload>.png`` of a tar shard under
    ``folder`` (shared by all executors) and return rows ``doc_id, n_bytes, digest, shard, offset,
    length``. Each task writes shards of its own and each content once, as long as it remembers it
    (the last ``REMEMBERED`` contents); texts are not shuffled, so a content that several tasks meet
    has a member for each of them, of which ``locations`` names one. A repeated attempt writes new
    shards; rows name the shards of the attempt they come from, and the others are deleted.
    The returned rows are a written table, so the shards are written once.

    Null text: an empty payload, 64 bytes 0. Null id: null. Repeated rows: a row each. Texts of any
    length. Empty table: no shards. Columns other than the two read are ignored, whatever their names.
    """

    def write(batches):
        shard, known = None, {}
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                payload = payload_of(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in known:
                    if shard is None or shard.at > SHARD_BYTES:
                        if shard is not None:
                            shard.close()
                        shard = _Shard(folder)
                    if len(known) > REMEMBERED:
                        known.clear()
                    media = to_png(payload)
                    known[digest] = (shard.uri, shard.add(f"{digest}.png", media), len(media))
                for store, value in zip(rows, (doc, len(raw), digest, *known[digest])):
                    store.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    rows = materialize(plain_columns(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-rows")
    remove_orphans(folder, rows)
    return rows


def _ranges(located: DataFrame, read, schema: str) -> DataFrame:
    """Apply ``read(file, offset, length)`` to each row ``digest, shard, offset, length``, in order of offset
    inside stretches of ``READ_BYTES`` of a shard, about one stretch a task."""

    def each(batches):
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))):
                if shard != name:
                    if source is not None:
                        source.close()
                    store, path = _open(shard)
                    name, source = shard, store.open_input_file(path)
                rows.append((digest, *read(source, offset, length)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kinds)
        if source is not None:
            source.close()

    names = ["digest", *[x.split()[0] for x in schema.split(", ")]]
    kinds = pa.schema([pa.field(n, pa.string() if t == "string" else pa.int32() if t == "int" else pa.int64()) for n, t in zip(names, ["string", *[x.split()[1] for x in schema.split(", ")]])])
    tasks = 1 + int(located.agg(F.sum("length")).first()[0] or 0) // READ_BYTES
    dealt = located.select("digest", "shard", "offset", "length").repartition(tasks, "shard", F.expr(f"offset div {READ_BYTES}"))
    return dealt.sortWithinPartitions("shard", "offset").mapInArrow(each, f"digest string, {schema}")


def locations(rows: DataFrame) -> DataFrame:
    """One place for each content: the first of those it was stored at."""
    best = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return best.select("digest", "at.shard", "at.offset", "at.length")


def read_headers(located: DataFrame) -> DataFrame:
    """Rows ``digest, width, height, bits`` by reading ``HEADER_BYTES`` of each member."""
    return _ranges(located, lambda f, offset, length: png_header(f.read_at(HEADER_BYTES, offset)), "width int, height int, bits int")


def read_contents(located: DataFrame) -> DataFrame:
    """Rows ``digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    distinct_bytes, mean_byte``: what the stored bytes hold, by reading each member whole."""

    def read(f, offset, length):
        media = f.read_at(length, offset)
        payload = from_png(media)
        samples = np.frombuffer(payload, np.uint8)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), int((np.bincount(samples, minlength=256) > 0).sum()), int(samples.sum(dtype=np.int64)) * 1000 // len(samples))

    return _ranges(located, read, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, distinct_bytes int, mean_milli long")


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_bytes, digest, shard, offset, length`` of ``store_media`` with the columns of
    ``read_headers`` and ``read_contents``. Each content is read once and joined to its documents by
    digest, without moving the rows of a digest that many documents share. Equal texts get equal values: of the places that tie
    as one content's the least (shard, offset) is named for all. Other columns are ignored, whatever their names."""
    rows = store_media(docs, folder or folder_for(docs.sparkSession, "media"), id_col, text_col)
    where = materialize(locations(rows), "media-places")
    facts = materialize(where.join(read_headers(where), "digest").join(read_contents(where), "digest"), "media-facts")
    return spread_join(rows.select("doc_id", "n_bytes", "digest"), facts, ["digest"])
