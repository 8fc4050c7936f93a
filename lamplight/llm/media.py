"""Media columns: ISO base media containers, written and walked without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, spread

UNIT, PER_CHUNK, KEY_EVERY = 64, 32, 16  #: bytes of a sample, samples of a chunk, samples from one keyframe to the next
#: Boxes that hold boxes, with the bytes before the first of these.
NESTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}


class Broken(ValueError):
    """What is wrong with a container."""


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the content of each box in a range; 64-bit sizes and a last box without one included."""
    while at < end:
        if end - at < 8:
            raise Broken(f"{end - at} bytes where a box begins")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise Broken("a 64-bit size breaks off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Broken(f"box {kind!r} of {size} bytes in {end - at}")
        yield kind, at + head, at + size
        at += size


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, begin, end) of every box, outer ones first."""
    for kind, a, b in boxes(data, at, len(data) if end is None else end):
        yield (*path, kind), a, b
        if kind in NESTS:
            if len(path) > 16:
                raise Broken("boxes nest too deep")
            yield from walk(data, a + NESTS[kind], b, (*path, kind))


def _table(data: memoryview, a: int, b: int, columns: int, width: str = ">u4") -> np.ndarray:
    """Rows of a full box that counts its entries."""
    n = struct.unpack_from(">I", data, a + 4)[0]
    if a + 8 + n * columns * int(width[-1]) > b:
        raise Broken("a table is longer than its box")
    return np.frombuffer(data, width, n * columns, a + 8).reshape(n, columns).astype(np.int64)


def _track(data: memoryview, kind: bytes, a: int, b: int, t: dict) -> None:
    """Takes what a box within a trak says."""
    if kind == b"tkhd":
        t["id"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
    elif kind == b"mdhd":
        t["scale"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
    elif kind == b"hdlr":
        t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
    elif kind == b"stsd" and b - a >= 16:
        t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
    elif kind == b"stts":
        t["times"] = _table(data, a, b, 2)
    elif kind == b"stss":
        t["sync"] = _table(data, a, b, 1)[:, 0]
    elif kind == b"stsc":
        t["runs"] = _table(data, a, b, 3)
    elif kind in (b"stco", b"co64"):
        t["chunks"] = _table(data, a, b, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, a + 4)
        t["sizes"] = np.full(n, size, np.int64) if size else _table(data, a + 4, b, 1)[:, 0]
    elif kind == b"stz2":
        field, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        raw = np.frombuffer(data, ">u2" if field == 16 else "u1", n if field != 4 else (n + 1) // 2, a + 12).astype(np.int64)
        t["sizes"] = np.stack((raw >> 4, raw & 15), 1).reshape(-1)[:n] if field == 4 else raw


def _placed(t: dict) -> None:
    """offsets, duration and keys (sample numbers) of a track from its sample tables."""
    n, chunks, runs = len(t["sizes"]), t["chunks"], t["runs"]
    if n and (not len(runs) or not len(chunks)):
        raise Broken("samples without chunks")
    last = np.append(runs[1:, 0] - 1, len(chunks)) if len(runs) else np.zeros(0, np.int64)
    per = np.repeat(runs[:, 1], np.maximum(0, last - runs[:, 0] + 1)) if len(runs) else np.zeros(0, np.int64)
    if per.sum() < n or len(per) != len(chunks):
        raise Broken("chunks don't hold the samples")
    chunk = np.repeat(np.arange(len(per)), per)[:n]
    before = np.cumsum(t["sizes"]) - t["sizes"]
    first = np.searchsorted(chunk, chunk)
    t["offsets"] = chunks[chunk] + before - before[first] if n else np.zeros(0, np.int64)
    if t["times"][:, 0].sum() not in (0, n):
        raise Broken("stts doesn't cover the samples")
    t["duration"] = int((t["times"][:, 0] * t["times"][:, 1]).sum())
    t["keys"] = np.arange(n) if t["sync"] is None else t["sync"] - 1
    if len(t["keys"]) and (t["keys"].min() < 0 or t["keys"].max() >= n):
        raise Broken("a keyframe that is no sample")


#: Optional 32-bit fields of a fragment's header by flag, and of its runs' samples.
_TFHD = [(0x2, "description"), (0x8, "duration"), (0x10, "size"), (0x20, "flags")]
_TRUN = [(0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")]
_NOT_SYNC = 0x10000  #: flag of a sample that is no keyframe


class _Fragments:
    """Samples of movie fragments: defaults by track (trex), by fragment (tfhd) and by run (trun)."""

    def __init__(self, out: list[dict]):
        self.by_id, self.defaults, self.moof, self.base, self.end = {t["id"]: t for t in out}, {}, 0, 0, None
        self.now: dict | None = None

    def take(self, data: memoryview, kind: bytes, a: int, b: int) -> None:
        flags = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF if b - a >= 4 else 0
        if kind == b"trex":
            track, _, duration, size, sample = struct.unpack_from(">5I", data, a + 4)
            self.defaults[track] = {"duration": duration, "size": size, "flags": sample}
        elif kind == b"tfhd":
            track, at = struct.unpack_from(">I", data, a + 4)[0], a + 8
            if track not in self.by_id:
                raise Broken(f"a fragment of track {track}, which isn't there")
            self.now, own = self.by_id[track], dict(self.defaults.get(track, {"duration": 0, "size": 0, "flags": 0}))
            self.base = self.moof if flags & 0x20000 or self.end is None else self.end
            if flags & 1:
                self.base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            for bit, name in _TFHD:
                if flags & bit:
                    own[name], at = struct.unpack_from(">I", data, at)[0], at + 4
            self.own, self.next = own, self.base
        elif kind == b"trun":
            if self.now is None:
                raise Broken("a run of samples without a header")
            n, at = struct.unpack_from(">I", data, a + 4)[0], a + 8
            if flags & 1:
                self.next, at = self.base + struct.unpack_from(">i", data, at)[0], at + 4
            first, at = (struct.unpack_from(">I", data, at)[0], at + 4) if flags & 4 else (None, at)
            named = [name for bit, name in _TRUN if flags & bit]
            if at + 4 * n * len(named) > b:
                raise Broken("a run is longer than its box")
            given = np.frombuffer(data, ">u4", n * len(named), at).reshape(n, len(named)).astype(np.int64) if named else None
            own = {c: given[:, named.index(c)] if c in named else np.full(n, self.own[c], np.int64) for c in ("duration", "size", "flags")}
            if first is not None and n and "flags" not in named:
                own["flags"][0] = first
            t, before = self.now, np.cumsum(own["size"]) - own["size"]
            t["keys"] = np.concatenate((t["keys"], len(t["sizes"]) + np.flatnonzero(own["flags"] & _NOT_SYNC == 0)))
            t["offsets"], t["sizes"] = np.concatenate((t["offsets"], self.next + before)), np.concatenate((t["sizes"], own["size"]))
            t["duration"] += int(own["duration"].sum())
            self.next += int(own["size"].sum())
            self.end = self.next


def tracks(data: bytes) -> list[dict]:
    """Per track: id, codec, timescale, duration (units and seconds), samples, sizes, offsets, and keyframe byte ranges.

    Samples are placed by stsz or stz2 (sizes), stsc and stco or co64 (chunks); without stss every sample is a keyframe.
    Samples of movie fragments (moof) follow in the order of their runs. Payload bytes are never read here.
    """
    view, out, fragments = memoryview(data), [], None
    try:
        for path, a, b in walk(view):
            kind = path[-1]
            if kind == b"trak":
                out.append({"id": 0, "codec": None, "scale": 0, "sync": None, "sizes": np.zeros(0, np.int64), "runs": np.zeros((0, 3), np.int64), "chunks": np.zeros(0, np.int64), "times": np.zeros((0, 2), np.int64)})
            elif b"trak" in path:
                _track(view, kind, a, b, out[-1])
            elif kind in (b"moof", b"trex", b"traf", b"tfhd", b"trun"):
                if kind == b"trex":
                    fragments = fragments or _Fragments([])
                elif kind == b"moof" and (fragments is None or not fragments.by_id):
                    for t in out:
                        _placed(t)
                    known = fragments.defaults if fragments else {}
                    fragments = _Fragments(out)
                    fragments.defaults = known
                if fragments is None:
                    raise Broken("a fragment outside of moof")
                if kind == b"moof":
                    fragments.moof, fragments.end = a - (8 if view[a - 4 : a] == kind else 16), None  # where the box begins
                elif kind == b"traf":
                    fragments.now = None
                fragments.take(view, kind, a, b)
    except struct.error as e:
        raise Broken(f"a box breaks off: {e}") from e
    for t in out:
        if "offsets" not in t:
            _placed(t)
        if len(t["sizes"]) and (t["offsets"] + t["sizes"]).max() > len(data):
            raise Broken("a sample lies outside of the file")
        keys = t["keys"]
        t["keys"] = np.stack((t["offsets"][keys], t["sizes"][keys]), 1) if len(t["sizes"]) else np.zeros((0, 2), np.int64)
    return out


def payload(data: bytes, track: dict) -> bytes:
    """The samples' bytes in order; neighbours in the file are cut out together."""
    at, end = track["offsets"], track["offsets"] + track["sizes"]
    breaks = np.flatnonzero(at[1:] != end[:-1]) + 1
    starts, stops = at[np.concatenate(([0], breaks))] if len(at) else at, end[np.concatenate((breaks - 1, [len(at) - 1]))] if len(at) else end
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(raw: bytes, unit: int = UNIT, per_chunk: int = PER_CHUNK, key_every: int = KEY_EVERY) -> bytes:
    """raw, of a multiple of unit bytes, as samples of unit bytes and 8 bits a byte in a one-track container.

    Chunks follow each other in mdat; every key_every-th sample is a keyframe; a sample lasts one tick of 1000 a second.
    """
    n = len(raw) // unit
    chunks = -(-n // per_chunk)
    runs = [(1, per_chunk, 1)] if n % per_chunk == 0 or chunks == 1 else [(1, per_chunk, 1), (chunks, n - (chunks - 1) * per_chunk, 1)]
    runs = [(1, n, 1)] if chunks == 1 else runs
    keys = np.arange(1, n + 1, key_every)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(start: int) -> bytes:
        wide = start + len(raw) >= 1 << 32
        places = start + np.arange(chunks, dtype=np.int64) * per_chunk * unit
        entry = _box(b"raw8", bytes(6), struct.pack(">H", 1))
        stbl = _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">3I", 1, n, 1)), _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()), _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)), _full(b"stsz", struct.pack(">2I", unit, n)), _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()))
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">4IHH", 0, 0, 1000, n & 0xFFFFFFFF, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"meta", bytes(12), b"bytes\0"), _box(b"minf", _full(b"nmhd"), dinf, stbl))
        trak = _box(b"trak", _full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, n & 0xFFFFFFFF), bytes(16), matrix, bytes(8), flags=7), mdia)
        return _box(b"moov", _full(b"mvhd", struct.pack(">4I", 0, 0, 1000, n & 0xFFFFFFFF), struct.pack(">IH", 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), trak)

    front = len(head) + len(moov(0)) + (8 if len(raw) + 8 < 1 << 32 else 16)
    front = len(head) + len(moov(front)) + (8 if len(raw) + 8 < 1 << 32 else 16)
    return head + moov(front) + _box(b"mdat", raw)


def describe(media: bytes) -> dict:
    """The first track's codec, duration in seconds, samples and keyframe ranges, and all samples' bytes."""
    if not (found := tracks(media)):
        raise Broken("no track")
    t = found[0]
    return {"codec": t["codec"], "seconds": t["duration"] / t["scale"] if t["scale"] else 0.0, "samples": len(t["sizes"]), "keys": t["keys"], "payload": payload(media, t)}


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))])
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, samples long, keyframes array<struct<offset: long, size: long>>"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) per row of docs (doc_id, text): the text (null: empty) as UTF-8, padded with bytes 0 to a
    positive multiple of UNIT, in a container. Each row stands for itself: ties, repeated rows and null doc_ids need no rule;
    an empty table gives none. Other columns are not read. No shuffle of texts but for small tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                raw = [x or b"" for x in texts.slice(at, 256).to_pylist()]
                media = [store(x + bytes(-len(x) % UNIT if x else UNIT)) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], schema=STORED)

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """SCHEMA rows of containers (doc_id, n_bytes, media): what their boxes say, and digests of the bytes and of the payload
    that the sample tables place. A container that is broken fails the query with its doc_id. Null media are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, made = batch.slice(at, 256), []
                for doc_id, n, media in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    try:
                        d = describe(media)
                    except Broken as e:
                        raise Broken(f"doc_id {doc_id}: {e}") from e
                    p = d["payload"]
                    made.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), d["codec"], d["seconds"], d["samples"], d["keys"]))
                cols = list(zip(*made, strict=True)) if made else [()] * len(FEATURES)
                keys = np.concatenate(cols[-1]) if made else np.zeros((0, 2), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[-1])]), pa.int32()), pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["offset", "size"]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols[:-1], FEATURES, strict=False)), lists], schema=FEATURES)

    return stored.select(*STORED.names).where("media is not null").mapInArrow(run, SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    """features() of the containers of docs, written to a table in the shared folder and read back from there."""
    return features(Scratch(docs.sparkSession, "media").save(media_column(docs), "media", compression="zstd"))
