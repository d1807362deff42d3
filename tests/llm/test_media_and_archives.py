import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from typeweave.llm import matroska as M
from typeweave.llm import warc


@pytest.mark.parametrize("size", [64, 128, 4096, 4160, 4096 * 8, 4096 * 8 + 64, 4096 * 56, 4096 * 56 * 3 + 640])
def test_mux_and_parse_round_trip(size):
    payload = random.Random(size).randbytes(size)
    media = M.mux(payload)
    found = M.parse(media)
    assert found.error is None and M.payload_of(media, found) == payload
    assert found.tracks[1]["codec"] == "A_PCM/INT/LIT" and found.tracks[1]["bit_depth"] == 8 and found.tracks[1]["rate"] == 8000.0
    assert [p.timestamp_ns for p in found.packets] == [i * 512_000_000 for i in range(len(found.packets))]
    assert [c[0] * 1_000_000 for c in found.cues] == [next(p.timestamp_ns for p in found.packets if p.cluster == k) for k in range(found.clusters)]
    assert all(media[at : at + 4] == bytes.fromhex("1F43B675") for _, _, at in found.cues)


@pytest.mark.parametrize("lacing", [M.XIPH, M.EBML_LACING, M.FIXED])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for sizes in ([7], [3, 3], [300, 300, 300], [0, 255, 510, 1], [1, 9000, 2, 70000, 5], list(range(1, 40))):
        if lacing == M.FIXED and len(set(sizes)) > 1:
            continue
        frames = [rng.randbytes(n) for n in sizes]
        body = M.block(frames, 0, lacing=lacing)
        assert [body[a : a + n] for a, n in M.laced(body, 4, len(body), lacing)] == frames


def test_unknown_sizes_groups_and_damage():
    unknown = b"\x01" + b"\xff" * 7
    block = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.block([b"abc"], -5, track=2, flags=0)), M.number(M.BLOCK_DURATION, 3), M.element(M.REFERENCE, b"\xfb"))
    cluster = M._id(M.CLUSTER) + unknown + M.number(M.CLUSTER_TIMESTAMP, 100) + block
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + M._id(M.SEGMENT) + unknown + M.element(M.INFO, M.number(M.TIMESTAMP_SCALE, 1000)) + cluster + cluster + M.element(M.CUES)
    found = M.parse(data)
    assert found.error is None and found.clusters == 2
    assert [(p.track, p.timestamp_ns, p.keyframe, data[p.offset : p.offset + p.length]) for p in found.packets] == [(2, 95_000, False, b"abc")] * 2
    whole = M.mux(bytes(4096 * 20))
    for cut in range(0, len(whole), 997):
        part = M.parse(whole[:cut])
        assert part.error is not None and all(p.offset + p.length <= cut for p in part.packets)
    assert M.parse(None).error and M.parse(b"").error and M.parse(b"RIFF1234").error


def test_packet_table(spark):
    media = M.mux(bytes(range(256)) * 64)
    df = spark.createDataFrame([(1, media, 5), (2, media[:300], 5), (3, None, 5), (None, media, 5)], "doc_id long, data binary, track long")
    rows = M.packet_table(df).collect()
    good = [r for r in rows if r["doc_id"] == 1]
    assert b"".join(media[r["byte_offset"] : r["byte_offset"] + r["byte_length"]] for r in good) == bytes(range(256)) * 64
    assert [r["error"] is not None for r in rows if r["doc_id"] in (2, 3)] == [True, True]
    assert sum(r["doc_id"] is None for r in rows) == len(good)
    assert M.packet_table(df.limit(0)).count() == 0


def test_damage_never_raises(spark):
    rng, files = random.Random(2), []
    laced = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + M.element(
        M.SEGMENT,
        M.element(M.INFO, M.number(M.TIMESTAMP_SCALE, 1000)),
        M.element(M.CLUSTER, M.number(M.CLUSTER_TIMESTAMP, 5), *[M.element(M.SIMPLE_BLOCK, M.block([b"ab", b"abc", b"a" * 300], 1, lacing=k)) for k in (M.XIPH, M.EBML_LACING)]),
        M.element(M.CUES, M.element(M.CUE_POINT, M.number(M.CUE_TIME, 5), M.element(M.CUE_POSITIONS, M.number(M.CUE_TRACK, 1), M.number(M.CUE_CLUSTER, 3)))),
    )
    for whole in (laced, M.mux(bytes(256))):
        files += [whole[:n] for n in range(0, min(len(whole), 420), 3)]
        for _ in range(600):
            data = bytearray(whole)
            for _ in range(rng.randrange(1, 4)):
                data[rng.randrange(len(data))] = rng.choice([0, 1, 127, 128, 255, rng.randrange(256)])
            files.append(bytes(data))
    long_time = M.element(M.EBML) + M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.CLUSTER_TIMESTAMP, b"\xff" * 8), M.element(M.SIMPLE_BLOCK, M.block([b"x"], 0))))
    long_cue = M.element(M.EBML) + M.element(M.SEGMENT, M.element(M.CUES, M.element(M.CUE_POINT, M.element(M.CUE_TIME, b"\xff" * 8), M.element(M.CUE_POSITIONS, M.number(M.CUE_TRACK, 1)))))
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*files, long_time, long_cue])], "doc_id long, data binary")
    rows = M.packet_table(df).collect()
    errors = {r["doc_id"] for r in rows if r["error"] is not None}
    assert {len(files), len(files) + 1} <= errors and M.cue_table(df).count() > 0


def test_cue_table(spark):
    media = M.mux(bytes(4096 * 56 * 2 + 64))
    df = spark.createDataFrame([(1, media, 9), (2, None, 9), (None, media, 9)], "doc_id long, data binary, track long")
    rows = M.cue_table(df).collect()
    own = sorted((r["timestamp_ns"], r["cluster_offset"]) for r in rows if r["doc_id"] == 1)
    assert len(own) == 3 and [media[at : at + 4].hex() for _, at in own] == ["1f43b675"] * 3 and own[0][0] == 0 and len(rows) == 6
    assert M.cue_table(df.limit(0)).count() == 0


def test_stored_texts(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long " * 100_000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature long")
    rows = M.stored_texts(df).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(M.mux(payload)), hashlib.sha256(M.mux(payload)).hexdigest())
    assert tuple(rows[2])[1:] == tuple(rows[7])[1:]


def brute_pages(pages):
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, url, html in pages:
        raw = (html or "").encode()
        lead = first.get(html or "")
        revisit = lead is not None and page != lead
        out.append((page, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


PAGES = [(i, f"http://h/{i}", f"<p>{'same' if i % 3 == 0 else i}</p>" + "x" * (i * 50 % 4000)) for i in range(150)]
PAGES += [(500 + i, "http://copy", "<b>copy</b>\r\n\r\nmore") for i in range(40)] + [(900, None, None), (901, "u\r\nv", ""), (902, "é", None), (7, "http://again", "other"), (None, "n", "lost"), (None, "n", "<b>copy</b>\r\n\r\nmore")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, offset long").repartition(4)
    index = warc.write_archives(df, warc.archive_folder(df))
    got = warc.read_records(index).collect()
    want = brute_pages([(p, u if u is None else u.replace("\r", "%0D").replace("\n", "%0A"), h) for p, u, h in PAGES])
    assert sorted([(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == want
    texts = {(p, len((h or "").encode())): (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r["payload"]) == texts[r["page_id"], r["payload_bytes"]] for r in got if r["record_type"] == "response")


def test_reading_by_index(spark):
    df = spark.createDataFrame(PAGES[:120], "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(df, warc.archive_folder(df))
    some = index.where(F.col("url").endswith("7"))
    assert {r["page_id"] for r in warc.read_records(some).collect()} == {p for p, u, _ in PAGES[:120] if u.endswith("7")}
    assert warc.read_records(index.limit(0)).count() == 0
    large = warc.write_archives(df, warc.archive_folder(df), revisit_from=1 << 20)
    assert large.where("record_type = 'revisit'").count() == 0
    moved = some.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception):
        warc.read_records(moved).collect()
    assert warc.write_archives(df.limit(0), warc.archive_folder(df)).count() == 0


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP + 1, 5), ("b", 0, 5), ("b", 5, warc.SPAN)]
    assert warc.ranges(rows) == [("a", 0, 20, 0, 2), ("a", 20 + warc.GAP + 1, 5, 2, 3), ("b", 0, 5, 3, 4), ("b", 5, warc.SPAN, 4, 5)]


def test_records_are_standard_gzip_members(spark, tmp_path):
    import gzip

    df = spark.createDataFrame(PAGES[:20], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(df, str(tmp_path / "out"))
    (path,) = {r["archive"] for r in index.collect()}
    with gzip.open(path) as f:
        data = f.read()
    assert data.count(b"WARC/1.1\r\n") == 20
