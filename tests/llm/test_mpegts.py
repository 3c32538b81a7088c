import random

from pyspark.sql import functions as F

from isoline.llm import mpegts as T


def test_round_trip_of_all_sizes():
    rng = random.Random(4)
    for n in [64, 128, 192, 16384, 16448, 32768, 200_000 // 64 * 64, *(64 * rng.randint(1, 3000) for _ in range(20))]:
        data = rng.randbytes(n)
        media = T.mux(data)
        got = T.demux(media)
        assert len(media) % 188 == 0 and media[::188] == b"G" * (len(media) // 188)
        assert (got.payload, got.continuity_errors, got.table_errors, got.stream_type) == (data, 0, 0, 6)
        frames = -(-n // T.FRAME)
        assert got.pts == [T.FIRST_PTS + k * T.FRAME_TICKS for k in range(frames)]
        assert got.random_access == [(k, got.pts[k]) for k in range(0, frames, T.GROUP)]


def test_every_payload_length_near_a_packet():
    for n in range(1, 600):
        data = bytes(i & 255 for i in range(n))
        assert T.demux(T.mux(data)).payload == data


def test_faults_are_counted():
    media = T.mux(bytes(range(256)) * 200)
    lost = media[: 188 * 20] + media[188 * 21 :]
    assert T.demux(lost).continuity_errors == 1
    broken = bytearray(media)
    broken[188 + 12] ^= 1
    assert T.demux(bytes(broken)).table_errors == 1
    assert T.demux(b"").table_errors == 2
    assert T.demux(b"junk" * 100).payload == b""


def test_crc():
    assert T.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_documents(spark, docs_of, stored):
    rows = [(1, None), (2, ""), (3, "é" * 32), (3, "é" * 32), (4, "z" * 1_000_000)]
    got = {r.doc_id: r for r in T.op6_mpeg_ts(spark, stored(documents=docs_of(rows))).collect()}
    assert {k: (r.n_bytes, r.payload_bytes) for k, r in got.items()} == {1: (0, 64), 2: (0, 64), 3: (64, 64), 4: (1_000_000, 1_000_000)}
    assert got[1][2:] == got[2][2:]


def read_by_hand(media):
    """The bytes of elementary packets on the stream's one data PID, packet after packet, as its format says."""
    pes, payload = [], b""
    for i in range(0, len(media), 188):
        p = media[i : i + 188]
        if (p[1] & 31) << 8 | p[2] != 0x101:
            continue
        body = p[4 + (1 + p[4] if p[3] & 32 else 0) :]
        if p[1] & 64:
            pes.append(b"")
        pes[-1] += body
    for x in pes:
        payload += x[9 + x[8] : 6 + int.from_bytes(x[4:6], "big")]
    return payload


def test_digests_by_hand(spark, docs_of, stored, sf):
    from hashlib import sha256
    from zlib import crc32

    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(docs_of([(9001, None), (9002, ""), (9003, "x" * 300_001), (9003, "x" * 300_001)]).select("doc_id", "text", "lang", "source", "n_chars")).withColumn("m", F.lit(1))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = T.op6_mpeg_ts(spark, stored(documents=docs)).collect()
    assert len(got) == docs.count()
    for r in got:
        data = texts[r.doc_id]
        want = data + bytes(-len(data) % 64) if data else bytes(64)
        media = T.mux(want)
        assert read_by_hand(media) == want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), sha256(want).hexdigest(), crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
        frames = -(-len(want) // T.FRAME)
        points = ",".join(f"{k}@{T.FIRST_PTS + k * T.FRAME_TICKS}" for k in range(0, frames, T.GROUP))
        assert r.feature == f"type=6;packets={len(media) // 188};frames={frames};random_access={points};seconds={frames * T.FRAME_TICKS / T.CLOCK:.2f};continuity_errors=0;table_errors=0"
    assert T.op6_mpeg_ts(spark, stored(documents=docs.limit(0))).count() == 0


def test_streams_of_others():
    data = bytes(range(256)) * 1500
    media = T.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = b"".join(packets[:7] + packets[6:])
    got = T.demux(twice)
    assert (got.payload, got.duplicates, got.continuity_errors) == (data, 1, 0)
    for junk in (b"GJUNK", b"x" * 500, b"G" * 100):
        assert T.demux(junk + media).payload == data
        mid = b"".join(packets[:9]) + junk + b"".join(packets[9:])
        got = T.demux(mid)
        assert (got.payload, got.continuity_errors) == (data, 0) and got.skipped_bytes >= len(junk) - 188
    # A reader that comes late finds the tables before the next random-access point.
    late = T.demux(b"".join(packets[200:]))
    assert late.table_errors == 0 and late.random_access and data.endswith(late.payload[-16384:])
    # Sections that run over two packets, after a pointer and a stuffed start.
    section = media[5:188][: 3 + ((media[6] & 15) << 8 | media[7])]
    head = bytes([0x47, 0x40, 0, 0x30, 170, 0]) + b"\xff" * 169 + bytes([0])
    cut = 188 - len(head)
    long = head + section[:cut] + (bytes([0x47, 0, 0, 0x11]) + section[cut:]).ljust(188, b"\xff")
    assert T.demux(long + media[188:]).payload == data
