"""Media columns: ISO media containers (the box structure of MP4 and QuickTime files).

`probe` walks the nested boxes of a container, decodes the sample tables (stsd, stts, stsc, stsz,
stco or co64, stss) and those of fragments (trex, tfhd, trun), and gives codec, size, duration and the
byte ranges of keyframes of each track, and of the first video track (else the first track) apart;
payloads are never decoded. `mux` stores bytes as a track of uncompressed 8-bit grey frames of 8 x 8
samples (codec `raw `), `samples` reads a track's bytes back through its sample tables.

Nulls and odd input: a null text or payload is empty; an empty payload is padded to one frame of
zeros. Bytes that aren't a container, or a container without a track, give a null codec, a null
duration, no keyframes and `error`; nothing is raised, as every count is held against the bytes that
there are before anything is built of it, and boxes may nest as deeply as they like. Rows are
independent: repeated rows, ties and other columns don't matter, and an empty table gives an empty
result. A payload may be as long as Spark's binary values can be; 64-bit box sizes and offsets are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.llm.common import table

#: Bytes of a frame, frames of a chunk, frames from keyframe to keyframe, frames a second.
FRAME, CHUNK, GOP, RATE = 64, 32, 16, 25
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(payload: bytes) -> bytes:
    """payload with zeros up to a positive multiple of a frame."""
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def mux(payload: bytes) -> bytes:
    """A container whose one track holds the padded payload, a frame a sample."""
    payload = padded(payload)
    n = len(payload) // FRAME
    full, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    offsets = np.arange(full + bool(rest), dtype=np.int64) * (CHUNK * FRAME)
    keys = np.arange(1, n + 1, GOP).astype(">u4")
    entry = _box(b"raw ", struct.pack(">6xH16xHHIIIH32sHh", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"", 40, -1))

    def moov(start: int) -> bytes:
        wide = start + len(payload) > 0xFFFFFFFF
        places = (offsets + start).astype(">u8" if wide else ">u4").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            _full(b"stsz", struct.pack(">2I", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), places),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"payload\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">5I8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">2I", 8 << 16, 8 << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    start = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(start) + struct.pack(">I4s", 8 + len(payload), b"mdat") + payload


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of body, end) of the boxes between start and end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = start + size if size else end
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} goes beyond what holds it")
        yield kind, body, stop
        start = stop


class _Tree:
    """Where the boxes of a container lie: those of each track, the defaults of fragments, and fragments."""

    def __init__(self, data: memoryview) -> None:
        self.tracks: list[dict] = []
        self.defaults: dict[int, tuple] = {}
        #: (start of the moof box, its traf boxes as (tfhd, [trun ...]))
        self.fragments: list[tuple[int, list]] = []
        todo: list[tuple[int, int, dict | None]] = [(0, len(data), None)]
        while todo:  # no recursion: nesting has no bound
            start, end, inside = todo.pop()
            at = start
            for kind, body, stop in boxes(data, start, end):
                if kind == b"trak":
                    self.tracks.append({})
                    todo.append((body, stop, self.tracks[-1]))
                elif kind == b"moof":
                    self.fragments.append((at, []))
                    todo.append((body, stop, {"trafs": self.fragments[-1][1]}))
                elif kind == b"traf" and inside is not None and "trafs" in inside:
                    own: dict = {"truns": []}
                    inside["trafs"].append(own)
                    todo.append((body, stop, own))
                elif kind == b"trex":
                    track, *rest = struct.unpack_from(">5I", data, body + 4)
                    self.defaults[track] = tuple(rest[1:])
                elif kind == b"trun" and inside is not None and "truns" in inside:
                    inside["truns"].append((body, stop))
                elif kind in _CONTAINERS:
                    todo.append((body, stop, inside))
                elif inside is not None:
                    inside.setdefault(kind, (body, stop))
                at = stop


class Track:
    """The decoded sample tables of one track: offsets and sizes of samples, and which are keyframes."""

    def __init__(self, data: memoryview, at: dict, tree: _Tree) -> None:
        def numbers(kind: bytes, columns: int, head: int = 4, wide: bool = False) -> np.ndarray:
            body = at[kind][0] + head
            (n,) = struct.unpack_from(">I", data, body)
            width = 8 if wide else 4
            if body + 4 + n * columns * width > at[kind][1]:
                raise ValueError(f"table {kind!r} is cut off")
            return np.frombuffer(data, f">u{width}", n * columns, body + 4).astype(np.int64).reshape(n, columns)

        body = at[b"mdhd"][0]
        self.timescale, _ = struct.unpack_from(">IQ" if data[body] else ">II", data, body + (20 if data[body] else 12))
        self.kind = bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in at else ""
        body = at[b"stsd"][0] + 8
        self.codec = bytes(data[body + 4 : body + 8]).decode("latin-1")
        # a sample entry has a picture's size only in a video track
        self.width, self.height = struct.unpack_from(">HH", data, body + 32) if self.kind == "vide" else (None, None)
        body = at[b"stsz"][0]
        each, n = struct.unpack_from(">II", data, body + 4)
        if n * max(1, each) > len(data):
            raise ValueError("more samples than bytes")
        self.sizes = np.full(n, each, np.int64) if each else numbers(b"stsz", 1, 8)[:, 0]
        times = numbers(b"stts", 2)
        if times[:, 0].sum() != n:
            raise ValueError("sample tables disagree")
        self.ticks = sum(a * b for a, b in times.tolist())
        starts = (numbers(b"co64", 1, wide=True) if b"co64" in at else numbers(b"stco", 1))[:, 0]
        runs = numbers(b"stsc", 3)
        reach = np.append(runs[1:, 0], len(starts) + 1) - runs[:, 0] if len(runs) else np.zeros(0, np.int64)
        if (reach < 0).any() or reach.sum() != len(starts):
            raise ValueError("sample tables disagree")
        per_chunk = np.repeat(runs[:, 1], reach)
        if per_chunk.sum() != n or (per_chunk < 1).any():
            raise ValueError("sample tables disagree")
        first = np.cumsum(per_chunk) - per_chunk  # the first sample of each chunk
        before = np.concatenate(([0], np.cumsum(self.sizes)))
        self.offsets = before[:-1] + np.repeat(starts - before[first], per_chunk)
        self.keys = numbers(b"stss", 1)[:, 0] - 1 if b"stss" in at else np.arange(n)
        if len(self.keys) and (self.keys.min() < 0 or self.keys.max() >= n):
            raise ValueError("a keyframe is no sample")
        if tree.fragments:
            body = at[b"tkhd"][0]
            (self.id,) = struct.unpack_from(">I", data, body + (20 if data[body] else 12))
            self._fragments(data, tree)
        if len(self.sizes) and (self.offsets.min() < 0 or (self.offsets + self.sizes).max() > len(data)):
            raise ValueError("samples lie outside the file")

    def _fragments(self, data: memoryview, tree: _Tree) -> None:
        """Adds the samples of the fragments."""
        sizes, offsets, keys, n = [self.sizes], [self.offsets], [self.keys], len(self.sizes)
        for moof, trafs in tree.fragments:
            base = moof
            for traf in trafs:
                body = traf[b"tfhd"][0]
                flags, track = struct.unpack_from(">II", data, body)
                flags &= 0xFFFFFF
                body += 8
                if flags & 0x1:
                    (base,) = struct.unpack_from(">Q", data, body)
                elif flags & 0x20000:
                    base = moof
                body += 8 * bool(flags & 0x1) + 4 * bool(flags & 0x2)
                own = list(tree.defaults.get(track, (0, 0, 0)))  # duration, size, flags
                for i, bit in enumerate((0x8, 0x10, 0x20)):
                    if flags & bit:
                        (own[i],) = struct.unpack_from(">I", data, body)
                        body += 4
                end = base
                for trun in traf["truns"]:
                    run, end = self._run(data, trun, base, end, own)
                    if track == self.id:
                        sizes.append(run[0])
                        offsets.append(run[1])
                        keys.append(run[2] + n)
                        n += len(run[0])
                        self.ticks += run[3]
                base = end  # where the next traf of the fragment starts if it doesn't say
        self.sizes, self.offsets, self.keys = map(np.concatenate, (sizes, offsets, keys))

    @staticmethod
    def _run(data: memoryview, trun: tuple[int, int], base: int, end: int, default: list[int]) -> tuple[tuple, int]:
        """((sizes, offsets, keys, ticks), end of the data) of one run of samples."""
        body, stop = trun
        flags, n = struct.unpack_from(">II", data, body)
        body, start, head = body + 8, end, None
        if flags & 0x1:
            start = base + struct.unpack_from(">i", data, body)[0]
            body += 4
        if flags & 0x4:
            (head,) = struct.unpack_from(">I", data, body)
            body += 4
        bits = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
        if body + 4 * n * len(bits) > stop or n > len(data):
            raise ValueError("table b'trun' is cut off")
        table = np.frombuffer(data, ">u4", n * len(bits), body).astype(np.int64).reshape(n, len(bits))
        column = lambda bit, other: table[:, bits.index(bit)] if bit in bits else np.full(n, other, np.int64)
        sizes, marks = column(0x200, default[1]), column(0x400, default[2]).copy()
        if head is not None and n and 0x400 not in bits:
            marks[0] = head
        ends = start + np.cumsum(sizes)
        return (sizes, ends - sizes, np.flatnonzero(marks & 0x10000 == 0), int(column(0x100, default[0]).sum())), int(ends[-1]) if n else start

    def ranges(self) -> list[tuple[int, int]]:
        """Byte ranges of all samples, neighbours merged."""
        ends = self.offsets + self.sizes
        cut = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        return list(zip(self.offsets[np.append(0, cut)].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist(), strict=True)) if len(ends) else []

    def described(self) -> dict:
        ends = self.offsets + self.sizes
        keyframes = [{"start": a, "end": b} for a, b in zip(self.offsets[self.keys].tolist(), ends[self.keys].tolist(), strict=True)]
        out = {"kind": self.kind, "codec": self.codec, "width": self.width, "height": self.height}
        return out | {"duration_ms": self.ticks * 1000 // max(1, self.timescale), "n_samples": len(self.sizes), "keyframes": keyframes}


def tracks(media: bytes) -> list[Track]:
    data = memoryview(media)
    tree = _Tree(data)
    return [Track(data, at, tree) for at in tree.tracks if {b"mdhd", b"stsd", b"stsz"} <= at.keys()]


def first_track(found: list[Track]) -> Track:
    """The first video track, else the first track."""
    return next((t for t in found if t.kind == "vide"), found[0])


_RANGE = T.StructType().add("start", T.LongType()).add("end", T.LongType())
_TRACK = T.StructType().add("kind", T.StringType()).add("codec", T.StringType()).add("width", T.IntegerType()).add("height", T.IntegerType())
_TRACK = _TRACK.add("duration_ms", T.LongType()).add("n_samples", T.LongType()).add("keyframes", T.ArrayType(_RANGE))
PROBE = T.StructType([*_TRACK.fields, T.StructField("tracks", T.ArrayType(_TRACK)), T.StructField("error", T.StringType())])
_BROKEN = (ValueError, KeyError, IndexError, OverflowError, struct.error)


def _probed(media: bytes | None) -> dict:
    out = dict.fromkeys(PROBE.names) | {"keyframes": [], "tracks": []}
    try:
        found = tracks(media or b"")
        if not found:
            return out | {"error": "no track"}
        return out | first_track(found).described() | {"tracks": [t.described() for t in found]}
    except _BROKEN as e:
        return out | {"error": str(e)}


@F.pandas_udf(PROBE)
def probe(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_probed(m) for m in media], columns=PROBE.names)


READ = T.StructType().add("payload", T.BinaryType()).add("key_crc32", T.LongType()).add("mean_level", T.DoubleType())


@F.pandas_udf(READ)
def read_samples(media: pd.Series) -> pd.DataFrame:
    """The bytes of the first track's samples in order, the CRC-32 of those of its keyframes, and the mean of
    the keyframes' bytes, which is their brightness in a track of 8-bit grey; null if there are none to read."""

    def read(m: bytes | None) -> tuple:
        try:
            t = first_track(tracks(m))
            ends = t.offsets + t.sizes
            keys = b"".join(m[a:b] for a, b in zip(t.offsets[t.keys].tolist(), ends[t.keys].tolist(), strict=True))
            return b"".join(m[a:b] for a, b in t.ranges()), zlib.crc32(keys), float(np.frombuffer(keys, np.uint8).mean()) if keys else None
        except (*_BROKEN, TypeError):
            return None, None, None

    return pd.DataFrame([read(m) for m in media], columns=READ.names)


@F.pandas_udf(T.BinaryType())
def muxed(payload: pd.Series) -> pd.Series:
    return pd.Series([mux(bytes(p or b"")) for p in payload], dtype=object)


@F.pandas_udf(T.BinaryType())
def samples(media: pd.Series) -> pd.Series:
    """The bytes of the first video track's samples (else the first track's), in order; null if there are
    none to be read."""

    def read(m: bytes | None) -> bytes | None:
        try:
            return b"".join(m[a:b] for a, b in first_track(tracks(m)).ranges())
        except (*_BROKEN, TypeError):
            return None

    return pd.Series([read(m) for m in media], dtype=object)


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a container that holds the UTF-8 bytes of text."""
    return df.withColumn(media, muxed(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = with_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    read = docs.select("doc_id", "n_bytes", read_samples("media").alias("read"), probe("media").alias("info"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = read.select("*", F.col("read.payload").alias("payload"))
    ranges = F.array_join(F.transform("info.keyframes", lambda k: F.concat(k["start"].cast("string"), F.lit("-"), k["end"].cast("string"))), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("%s|%dx%d|%dms|%d samples|%d keyframes|%s|%08x|%.4f", F.trim("info.codec"), "info.width", "info.height", "info.duration_ms", "info.n_samples", F.size("info.keyframes"), F.md5(ranges), "read.key_crc32", "read.mean_level").alias("feature"),
    )
