"""Containers: exact round trips, foreign files, and the walk over nested boxes."""

import hashlib
import struct
import zlib

import pytest

from arborquill.llm import media

TEXTS = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "z" * 50_000, "a", "w" * (576 * 16 * 3)]


def test_round_trip(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    stored = media.store_media(frame).persist()
    files = {r["doc_id"]: r["media"] for r in stored.collect()}
    columns = {r["doc_id"]: r for r in media.media_columns(stored).collect()}
    for r in media.media_digests(stored).collect():
        data = (TEXTS[r["doc_id"]] or "").encode()
        size = max(576, -(-len(data) // 576) * 576)
        payload = data + b"\xff" * (size - len(data))
        file = bytes(files[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        c = columns[r["doc_id"]]
        assert (c["codec"], c["n_samples"], c["duration"], c["error"]) == ("raw ", size // 576, size // 576 * media.TICKS, None)
        for i, (a, b) in enumerate(c["keyframes"]):
            assert file[a:b] == payload[i * 576 * media.GOP :][:576]
    assert files[2] == files[7]
    stored.unpersist()


def test_foreign_files(spark):
    good = media.store(media.padded(b"hello"))
    rows = [(0, None), (1, b""), (2, b"\x00\x00"), (3, good[:-1]), (4, b"RIFF" + bytes(40)), (5, good), (6, media.box(b"moov", b"\x00\x00\x00\xffabcd")), (7, bytearray(media.box(b"free", bytes(9))) + good[:0])]
    frame = spark.createDataFrame([(i, m and bytes(m)) for i, m in rows], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_columns(frame).collect()}
    assert got[0]["error"] is None and got[0]["codec"] is None and got[5]["error"] is None
    assert all(got[i]["error"] for i in (1, 2, 3, 4, 6, 7))


def test_walk_wide_and_open_boxes():
    inner = media.box(b"free", b"abc")
    wide = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    last = struct.pack(">I4s", 0, b"mdat") + b"xyz"
    data = memoryview(wide + last)
    assert [(p, bytes(data[a:b])) for p, a, b in media.walk(data)] == [((b"moov",), inner), ((b"moov", b"free"), b"abc"), ((b"mdat",), b"xyz")]
    with pytest.raises(ValueError, match="leaves its parent"):
        list(media.walk(memoryview(struct.pack(">I4s", 99, b"free"))))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert media.media_digests(media.store_media(frame)).count() == 0


def track(number, handler, codec, first, sizes, syncs=None, stsz=None, stsc=None):
    full = media.full_box
    tables = [
        full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(28))),
        full(b"stts", struct.pack(">3I", 1, len(sizes), 10) if sizes else struct.pack(">I", 0)),
        full(b"stsc", stsc or (struct.pack(">4I", 1, 1, len(sizes), 1) if sizes else struct.pack(">I", 0))),
        stsz or full(b"stsz", struct.pack(f">2I{len(sizes)}I", 0, len(sizes), *sizes)),
        full(b"stco", struct.pack(">2I", 1, first) if sizes else struct.pack(">I", 0)),
    ]
    if syncs is not None:
        tables.append(full(b"stss", struct.pack(f">I{len(syncs)}I", len(syncs), *syncs)))
    mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">5I", 0, 0, 1000, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, handler)), media.box(b"minf", media.box(b"stbl", *tables)))
    return media.box(b"trak", full(b"tkhd", struct.pack(">3I", 0, 0, number), bytes(60)), mdia)


def test_tables_are_kept_by_track():
    data = media.box(b"mdat", bytes(100))
    audio, video = track(1, b"soun", b"mp4a", 8, [10, 10, 10]), track(2, b"vide", b"avc1", 38, [20, 5, 5, 20], [1, 4])
    for tracks in ([audio, video], [video, audio]):
        d = media.describe(data + media.box(b"moov", *tracks))
        assert (d["codec"], d["samples"], d["keyframes"], d["duration"]) == ("avc1", [(38, 58), (58, 63), (63, 68), (68, 88)], [(38, 58), (68, 88)], 40)
    d = media.describe(data + media.box(b"moov", audio))
    assert (d["codec"], d["keyframes"]) == ("mp4a", [(8, 18), (18, 28), (28, 38)])


def test_fragments():
    trex = media.full_box(b"trex", struct.pack(">5I", 2, 1, 7, 6, 0x10000))
    moov = media.box(b"moov", track(1, b"soun", b"mp4a", 0, []), track(2, b"vide", b"avc1", 0, []), media.box(b"mvex", trex))

    def moof(offset, tracks):
        return media.box(b"moof", *tracks(offset))

    def runs(offset):
        one = media.full_box(b"tfhd", struct.pack(">I", 2), flags=0x20000)
        # the first sample has flags of its own, sizes are listed
        run = media.full_box(b"trun", struct.pack(">IiI3I", 3, offset, 0, 4, 5, 6), flags=0x1 | 0x4 | 0x200)
        more = media.full_box(b"trun", struct.pack(">I", 2), flags=0)  # the track's defaults, behind the first run
        other = media.full_box(b"tfhd", struct.pack(">III", 1, 3, 9), flags=0x20000 | 0x8 | 0x10)
        sound = media.full_box(b"trun", struct.pack(">Ii", 1, offset + 27), flags=0x1)
        return media.box(b"traf", one, run, more), media.box(b"traf", other, sound)

    size = len(moof(0, runs))
    file = moov + moof(size + 8, runs) + media.box(b"mdat", bytes(range(36)))
    d = media.describe(file)
    begin = len(moov) + size + 8
    want = [(0, 4), (4, 9), (9, 15), (15, 21), (21, 27)]
    assert d["samples"] == [(begin + a, begin + b) for a, b in want] and d["keyframes"] == [(begin, begin + 4)] and d["duration"] == 35
    assert media.contents(file, d["samples"]) == bytes(range(27))
    with pytest.raises(ValueError, match="fragments don't agree"):
        media.describe(file[: -36 - 8] + media.box(b"mdat", bytes(8)))


def test_forged_counts_are_refused():
    data, full = media.box(b"mdat", bytes(100)), media.full_box
    forged = [
        track(1, b"vide", b"avc1", 8, [5], stsz=full(b"stsz", struct.pack(">2I", 1, 2**32 - 1))),
        track(1, b"vide", b"avc1", 8, [5], stsz=full(b"stsz", struct.pack(">2I", 0, 2**31))),
        track(1, b"vide", b"avc1", 8, [5], stsc=struct.pack(">4I", 2**30, 1, 1, 1)),
        track(1, b"vide", b"avc1", 8, [5], stsc=struct.pack(">7I", 2, 1, 1, 1, 2**31, 1, 1)),
        track(1, b"vide", b"avc1", 8, [5], stsz=full(b"stz2", struct.pack(">2I", 8, 1))),
    ]
    for trak in forged:
        with pytest.raises(ValueError):
            media.describe(data + media.box(b"moov", trak))
    with pytest.raises(ValueError, match="no track"):
        media.describe(data)
