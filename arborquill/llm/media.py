"""ISO media containers: boxes written and walked, payloads never decoded.

:func:`store` packs bytes losslessly as 8-bit grey frames (24 x 24 = 576 bytes each) of a small
``ftyp / moov / mdat`` file. :func:`walk` descends through the nested boxes of any such file and
:func:`describe` turns the sample tables into codec, duration and keyframe byte ranges; neither
looks inside ``mdat``.

Tables are kept by track: the first video track counts, or else the first track. Fragments (``moof``) add
their runs of samples. Counts are checked against the boxes that hold them before anything is allocated.

Edge cases: a null or empty text is one frame of padding; a null container gives null columns; a
truncated, forged or foreign one, or one whose tables aren't read here, gives ``error`` and no ranges. Rows are independent: ties, repeated rows
and empty tables need nothing special.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, sliced

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
TIMESCALE, TICKS = 600, 25
#: Frames per chunk, and one sync sample in so many.
PER_CHUNK, GOP = 16, 8
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """The payload: ``data`` and bytes 255 up to a positive multiple of the frame size."""
    return data + bytes([PAD]) * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def store(payload: bytes) -> bytes:
    """A container whose samples are the payload's frames; the same bytes for the same payload."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("payload is no positive multiple of a frame")
    chunks, last = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * (chunks > 0) + [(chunks + 1, last)] * (last > 0)
    chunks += last > 0
    keys = range(1, n + 1, GOP)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", bytes(6), struct.pack(">H16xHHIIIH32sHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, bytes(32), 8, -1))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        where = [first + i * PER_CHUNK * FRAME for i in range(chunks)]
        wide = where[-1] >= 1 << 32
        offsets = full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *where))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">3I", 1, n, TICKS)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", a, k, 1) for a, k in runs)),
            full_box(b"stsz", struct.pack(">2I", FRAME, n)),
            offsets,
        )
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        span = n * TICKS
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">2xHIQHH", 0, 0, TIMESCALE << 32 | span, 0x55C4, 0)), full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, span, 0, 0, 0, 0), matrix, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">5IH10x", 0, 0, TIMESCALE, span, 1 << 16, 1 << 8), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    data = struct.pack(">I4s", 8 + len(payload), b"mdat") if len(payload) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    index = moov(0)
    index = moov(len(head) + len(index) + len(data))
    if b"co64" in index:
        index = moov(len(head) + len(index) + len(data))
    return b"".join((head, index, data, payload))


def walk(data: memoryview, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, in file order, parents before their children."""
    at, end = begin, len(data) if end is None else end
    while at < end:
        if at + 8 > end:
            raise ValueError(f"box header cut off at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box header cut off at {at}")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind.decode('latin-1')} at {at} leaves its parent")
        here = (*path, kind)
        yield here, body, stop
        if kind in PARENTS:
            yield from walk(data, body, stop, here)
        at = stop


class Track:
    """A ``trak``'s tables, its id and what its fragments add."""

    def __init__(self):
        self.tables: dict[bytes, tuple[int, int]] = {}
        self.fragments: list[tuple[int, int, bool, int]] = []  # start, end, whether a keyframe, ticks


def tracks_of(data: memoryview) -> list[Track]:
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    of_id: dict[int, Track] = {}
    moof = at = 0
    head: tuple[Track | None, int, int, int, int] = (None, 0, 0, 0, 0)
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        elif b"trak" in path and kind not in PARENTS:
            tracks[-1].tables.setdefault(kind, (a, b))
            if kind == b"tkhd":
                of_id[struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]] = tracks[-1]
        elif kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moof = at = a - (8 if bytes(data[a - 4 : a]) == b"moof" else 16)
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, a)
            flags, p = flags & 0xFFFFFF, a + 8
            base = at
            if flags & 1:
                base, p = struct.unpack_from(">Q", data, p)[0], p + 8
            elif flags & 0x20000:
                base = moof
            p += 4 * bool(flags & 2)
            values = list(defaults.get(track, (0, 0, 0)))
            for i, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    values[i], p = struct.unpack_from(">I", data, p)[0], p + 4
            if track not in of_id:
                raise ValueError(f"fragment of an unknown track {track}")
            head, at = (of_id[track], base, *values), base
        elif kind == b"trun":
            at = run_of_samples(data, a, b, head, at)
    return tracks


def run_of_samples(data: memoryview, a: int, b: int, head: tuple, at: int) -> int:
    """The samples of a ``trun`` go to their track; where the next run begins, if it doesn't say."""
    track, base, ticks, size, marks = head
    if track is None:
        raise ValueError("a run of samples without a head")
    flags, n = struct.unpack_from(">II", data, a)
    flags, p = flags & 0xFFFFFF, a + 8
    if flags & 1:
        at, p = base + struct.unpack_from(">i", data, p)[0], p + 4
    first = None
    if flags & 4:
        first, p = struct.unpack_from(">I", data, p)[0], p + 4
    width = 4 * (flags >> 8 & 15).bit_count()
    if p + n * width > b or not width and n * size > len(data):
        raise ValueError("run of samples is cut off")
    for i in range(n):
        own = [ticks, size, first if first is not None and not i else marks]
        for k, bit in enumerate((0x100, 0x200, 0x400)):
            if flags & bit:
                own[k], p = struct.unpack_from(">I", data, p)[0], p + 4
        p += 4 * bool(flags & 0x800)
        if at < 0 or at + own[1] > len(data):
            raise ValueError("fragments don't agree with the file")
        track.fragments.append((at, at + own[1], not own[2] & 0x10000, own[0]))
        at += own[1]
    return at


def describe(media: bytes) -> dict:
    """codec, timescale, duration (ticks), n_samples, samples and keyframes ([start, end) bytes) of the first
    video track, or of the first track if there's none; samples of fragments follow those of the tables."""
    data = memoryview(media)
    tracks = tracks_of(data)
    if not tracks:
        raise ValueError("no track")
    handler = lambda t: bytes(data[t.tables[b"hdlr"][0] + 8 : t.tables[b"hdlr"][0] + 12]) if b"hdlr" in t.tables else b""
    track = next((t for t in tracks if handler(t) == b"vide"), tracks[0])
    tables = track.tables

    def read(kind: bytes, fmt: str, skip: int = 4) -> list:
        """Rows of a counted table."""
        a, b = tables[kind]
        count, width = struct.unpack_from(">I", data, a + skip)[0], struct.calcsize(fmt)
        if a + skip + 4 + count * width > b:
            raise ValueError(f"table {kind.decode()} is cut off")
        return list(struct.iter_unpack(fmt, data[a + skip + 4 : a + skip + 4 + count * width]))

    if b"stz2" in tables:
        raise ValueError("unsupported table stz2")
    need = {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - tables.keys()
    if need or not {b"stco", b"co64"} & tables.keys():
        raise ValueError("no sample tables: " + ",".join(sorted(k.decode() for k in need)))
    a, _ = tables[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16]).decode("latin-1")
    a, b = tables[b"stsz"]
    fixed, n = struct.unpack_from(">2I", data, a + 4)
    if fixed and n * fixed > len(data):
        raise ValueError("more samples than the file holds")
    sizes = [fixed] * n if fixed else [x for (x,) in read(b"stsz", ">I", 8)]
    offsets = [x for (x,) in (read(b"co64", ">Q") if b"co64" in tables else read(b"stco", ">I"))]
    runs = read(b"stsc", ">3I")
    samples: list[tuple[int, int]] = []
    for i, (first, per, _) in enumerate(runs):
        until = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
        if first < 1 or until > len(offsets):
            raise ValueError("sample tables don't agree with the file")
        for chunk in range(first - 1, until):
            at = offsets[chunk]
            for size in sizes[len(samples) : len(samples) + per]:
                samples.append((at, at + size))
                at += size
    if len(samples) != n or samples and max(s[1] for s in samples) > len(data):
        raise ValueError("sample tables don't agree with the file")
    ticks = sum(k * d for k, d in read(b"stts", ">2I")) + sum(f[3] for f in track.fragments)
    keys = [k - 1 for (k,) in read(b"stss", ">I")] if b"stss" in tables else range(n)
    keyframes = [samples[k] for k in keys if 0 <= k < n] + [f[:2] for f in track.fragments if f[2]]
    samples += [f[:2] for f in track.fragments]
    return {"codec": codec, "timescale": timescale, "duration": duration or ticks, "samples": samples, "keyframes": keyframes}


def contents(media: bytes, samples: list[tuple[int, int]]) -> bytes:
    """The stored bytes, sample by sample."""
    return b"".join(media[a:b] for a, b in samples)


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (of the UTF-8 text) and media (the container)."""

    def run(batches):
        for batch in sliced(batches, 4 << 20):
            texts = batch.column(1).to_pylist()
            media = [store(padded(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = keyed(df, id_col, text_col, binary=True)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, codec, timescale, duration, n_samples, keyframes (array of start, end) and error."""
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        try:
            d = describe(media)
        except (ValueError, struct.error, IndexError) as e:
            return (None,) * 5 + (str(e),)
        return d["codec"], d["timescale"], d["duration"], len(d["samples"]), [{"start": a, "end": b} for a, b in d["keyframes"]], None

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), ranges, pa.string()]
        for batch in sliced(batches, 4 << 20):
            columns = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "codec", "timescale", "duration", "n_samples", "keyframes", "error"])

    rows = df.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start:bigint,end:bigint>>, error string").withColumnRenamed("id", id_col)


def media_digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Of stored containers: what was read back, in digests, and the features as one string."""

    def one(n: int, media: bytes) -> tuple:
        d = describe(media)
        payload = contents(media, d["samples"])
        feature = f"{d['codec']}|{d['timescale']}|{d['duration']}|{len(d['samples'])}|" + ",".join(f"{a}-{b}" for a, b in d["keyframes"])
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in sliced(batches, 4 << 20):
            rows = [one(n, m) for n, m in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", *names])

    rows = df.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media", "n_bytes")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("id", id_col)
