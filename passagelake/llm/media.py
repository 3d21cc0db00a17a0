"""Media columns: ISO base media containers read without decoding their payloads.

``read_container`` walks the nested boxes and decodes the sample tables, which say where each
sample lies. Codec, duration and the byte ranges of keyframes come from these tables alone.
``write_container`` stores any bytes as 8-bit mono samples in such a container, so that texts can make the round trip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, text_bytes

FRAME = 192
RATE = 8000
FRAMES_PER_CHUNK = 64
KEY_EVERY = 25
#: Boxes that hold boxes (fixed values of the format).
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex"}
#: Boxes in boxes: the format itself has five levels.
DEEPEST = 32
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of the frame."""
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def write_container(payload: bytes) -> bytes:
    """A container whose one track holds the payload, a positive multiple of the frame, as 8-bit samples."""
    frames = len(payload) // FRAME
    chunks, rest = divmod(frames, FRAMES_PER_CHUNK)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 0) + [(chunks + 1, rest, 1)] * (rest > 0)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4").tobytes()
    chunks += rest > 0
    length = len(payload)
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))

    def movie(first: int) -> bytes:
        at = (first + np.arange(chunks, dtype=np.uint64) * np.uint64(FRAME * FRAMES_PER_CHUNK)).astype(">u8")
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", struct.pack(">I", -(-frames // KEY_EVERY)), keys),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(">I", chunks), at.tobytes()),
        )
        info = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1), track)

    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    start = len(head) + len(movie(0)) + 16
    return b"".join((head, movie(start), struct.pack(">I4sQ", 1, b"mdat", 16 + length), payload))


@dataclass
class Track:
    """A track's tables as they lie in the file: chunks with their first sample, and one size for all samples or a table of sizes. Samples are numbered on demand."""

    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, memoryview] = field(default_factory=dict)
    count: int = 0
    fixed: int = 0
    #: Sums of the sizes before each sample and after the last, where they differ.
    before: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    chunks: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: The first sample of each chunk, and the number of samples.
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    synced: np.ndarray | None = None

    def through(self, samples: np.ndarray) -> np.ndarray:
        """Bytes of all samples before each."""
        return samples * self.fixed if self.fixed else self.before[samples]

    def ranges(self, samples: np.ndarray) -> np.ndarray:
        """Offsets and lengths of samples, as rows."""
        chunk = np.searchsorted(self.starts, samples, "right") - 1
        begin = self.through(samples)
        return np.stack((self.chunks[chunk] + begin - self.through(self.starts[chunk]), self.through(samples + 1) - begin), axis=1) if len(samples) else np.empty((0, 2), np.int64)

    @property
    def offsets(self) -> np.ndarray:
        return self.ranges(np.arange(self.count))[:, 0]

    @property
    def sizes(self) -> np.ndarray:
        return self.ranges(np.arange(self.count))[:, 1]

    def chunk_ranges(self) -> np.ndarray:
        """Offsets and lengths of the chunks that hold samples."""
        through = self.through(self.starts)
        found = np.stack((self.chunks, through[1:] - through[:-1]), axis=1)
        return found[self.starts[1:] > self.starts[:-1]]

    def key_ranges(self) -> np.ndarray:
        """Offsets and lengths of sync samples; without a table of them every sample is one, and those of a chunk make one range."""
        return self.chunk_ranges() if self.synced is None else self.ranges(self.synced)

    def n_keyframes(self) -> int:
        return self.count if self.synced is None else len(self.synced)

    def keyframes(self) -> list[tuple[int, int]]:
        return list(map(tuple, self.key_ranges().tolist()))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of each box between start and end; a broken length ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def read_container(data: bytes) -> list[Track]:
    """The tracks of a container with their sample tables decoded; payloads aren't touched. Other bytes give an empty list.

    Tables that don't agree with their own length, with each other or with the file raise ValueError, and so do boxes nested beyond DEEPEST and tracks
    whose samples together take more bytes than the file. What is kept is in proportion to the tables' bytes, not to the samples that they speak of.
    """
    view, tracks = memoryview(data), []
    walks = [boxes(view, 0, len(view))]
    while walks:
        found = next(walks[-1], None)
        if found is None:
            walks.pop()
            continue
        kind, a, b = found
        if kind == b"trak":
            tracks.append(Track())
        if kind in PARENTS:
            if len(walks) >= DEEPEST:
                raise ValueError("boxes are nested too deeply")
            walks.append(boxes(view, a, b))
        elif tracks and kind in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64"):
            tracks[-1].tables[kind] = view[a:b]
    left = len(view)
    for t in tracks:
        _decode(t, len(view))
        left -= int(t.through(t.starts[-1:])[0])
        if left < 0:
            raise ValueError("the tracks hold more than the file")
        t.tables.clear()
    return tracks


def _entries(table: memoryview | bytes, kind: str, fields: int = 1) -> np.ndarray:
    """The entries of a table that begins with their number."""
    if len(table) < 8:
        raise ValueError("a table ends before its count")
    n = struct.unpack_from(">I", table, 4)[0]
    if 8 + n * fields * np.dtype(kind).itemsize > len(table):
        raise ValueError("a table ends before its last entry")
    return np.frombuffer(table, kind, n * fields, 8).astype(np.int64).reshape(-1, fields)


def _decode(t: Track, length: int) -> None:
    """length: of the file. A sample takes a byte of it at least, so there can't be more samples of a fixed size than that."""
    get = t.tables.get
    if (head := get(b"mdhd")) is not None:
        wide = head[:1] == b"\1"
        if len(head) < (32 if wide else 20):
            raise ValueError("the media header is too short")
        t.timescale, t.duration = struct.unpack_from(">IQ", head, 20) if wide else struct.unpack_from(">II", head, 12)
    t.kind = bytes(get(b"hdlr", bytes(12))[8:12]).decode("latin-1")
    t.codec = bytes(get(b"stsd", bytes(16))[12:16]).decode("latin-1").strip()
    sizes = get(b"stsz")
    if sizes is None:
        return
    if len(sizes) < 12:
        raise ValueError("the table of sizes is too short")
    fixed, n = struct.unpack_from(">II", sizes, 4)
    if fixed * n > length or (not fixed and 12 + 4 * n > len(sizes)):
        raise ValueError("more samples than the file can hold")
    at = _entries(t.tables[b"co64"], ">u8")[:, 0] if b"co64" in t.tables else _entries(get(b"stco", bytes(8)), ">u4")[:, 0]
    runs = _entries(get(b"stsc", bytes(8)), ">u4", 3)
    first, per_run = runs[:, 0], runs[:, 1]
    lasting = np.diff(np.append(first, len(at) + 1))  # a run holds up to the next run's first chunk
    if (lasting < 0).any() or len(first) and first[0] != 1 or int((lasting * per_run).sum()) != n or (at < 0).any():
        raise ValueError("chunks and samples don't agree")
    keys = _entries(t.tables[b"stss"], ">u4")[:, 0] - 1 if b"stss" in t.tables else None
    if keys is not None and len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe that is no sample")
    t.count, t.fixed, t.synced = n, fixed, keys
    if not fixed:
        t.before = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, ">u4", n, 12), dtype=np.int64)))
    t.chunks, t.starts = at, np.concatenate(([0], np.cumsum(np.repeat(per_run, lasting))))


def read_samples(data: bytes, track: Track) -> bytes:
    """The bytes of all samples, found through the sample tables."""
    return b"".join(data[at : at + n] for at, n in track.chunk_ranges().tolist())


def feature(t: Track) -> str:
    """Codec, seconds, samples, keyframes, and where the first and last keyframe lie; the CRC covers all ranges."""
    keys = t.key_ranges()
    crc = zlib.crc32(keys.astype("<i8").tobytes())
    at = "-".join(f"{o}+{n}" for o, n in (keys[:1].tolist() + keys[-1:].tolist()))
    return f"codec={t.codec};seconds={t.duration / max(t.timescale, 1):.3f};samples={t.count};keyframes={t.n_keyframes()};at={at};ranges={crc:08x}"


RANGE = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
KEYFRAMES = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
#: Bytes of texts that are in work at once.
BYTES_AT_ONCE = 4 << 20


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace the binary column ``content`` by media_codec, media_kind, media_seconds and media_keyframes of its first track, and media_error.

    Null, empty or foreign bytes give nulls. Damaged tables give nulls and say why in media_error, which is null otherwise. Other columns pass through, but those with the names of the new ones are replaced;
    rows repeat as they are; empty input gives an empty result.
    """
    names = ["media_codec", "media_kind", "media_seconds", "media_keyframes", "media_error"]
    others = [f for f in df.schema.fields if f.name != content and f.name not in names]
    schema = T.StructType([*others, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.StringType(), T.DoubleType(), KEYFRAMES, T.StringType())))])

    def describe(data: bytes | None) -> tuple:
        try:
            t = next(iter(read_container(data)), None) if data else None
        except ValueError as e:
            return (None, None, None, None, str(e))
        return (None,) * 5 if t is None else (t.codec, t.kind, t.duration / max(t.timescale, 1), t.key_ranges(), None)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):  # a file and its ranges at a time
            codec, kind, seconds, keys, error = describe(batch.column(content)[i].as_py())
            if keys is None:
                ranges = pa.nulls(1, pa.list_(RANGE))
            else:
                ranges = pa.ListArray.from_arrays([0, len(keys)], pa.StructArray.from_arrays([np.ascontiguousarray(keys[:, k]) for k in (0, 1)], fields=list(RANGE)))
            new = [pa.array([codec], pa.string()), pa.array([kind], pa.string()), pa.array([seconds], pa.float64()), ranges, pa.array([error], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name)[i : i + 1] for f in others), *new], names=[*(f.name for f in others), *names])

    return map_batches(df.select(*(f"`{f.name}`" for f in others), content), work, schema)


def store_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and content: each whole text (null: empty) as UTF-8 in a container. Null keys pass through, repeated rows repeat, empty input gives an empty result."""
    rows = df.select(F.col(key).alias("key"), text_bytes(F.col(text)).alias("data"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lengths = pc.binary_length(batch.column("data"))
        for a, b in slices(lengths.to_pylist(), BYTES_AT_ONCE):
            made = pa.array([write_container(padded(x.as_py())) for x in batch.column("data")[a:b]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key")[a:b], lengths[a:b].cast(pa.int64()), made], names=["key", "n_bytes", "content"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(rows, work, f"key {kind}, n_bytes bigint, content binary").withColumnRenamed("key", key)


def media_digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text, read the stored bytes back through the sample tables and describe both.

    Null texts count as empty and are stored as one frame of spaces; texts of any length make one container; equal
    texts give equal values; a null key passes through; empty input gives an empty result.
    """
    stored = store_texts(df, text, key)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, seconds double, n_keyframes bigint"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        for data in (x.as_py() for x in batch.column("content")):
            track = read_container(data)[0]
            payload = read_samples(data, track)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track.codec, track.duration / track.timescale, track.n_keyframes())
            for column, x in zip(out, row):
                column.append(x)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "n_keyframes"]
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

    return map_batches(stored, work, schema)
