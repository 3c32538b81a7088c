"""Media columns: MPEG transport streams.

``mux`` stores a payload as a private elementary stream: a program association
table, a program map table, and packetized elementary stream (PES) packets of at
most ``FRAME`` payload bytes, cut into transport packets of 188 bytes with
continuity counters. Each PES packet has a presentation timestamp; every
``GROUP``-th follows the tables anew, so that a reader can join there, and begins
with a random-access indicator and a clock reference.

``demux`` reads any such stream back: it finds the packets again after bytes that
are none, parses the program tables (sections may run over packets, and the first
with a right CRC counts), leaves out packets that are sent twice, checks
continuity counters, reassembles the elementary packets, and lists their
timestamps with the random-access points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x0100, 0x0101
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK = 90_000

FRAME, GROUP, FRAME_TICKS, FIRST_PTS, ALIGN, LOCK = 16384, 8, 3600, CLOCK, 64, 4

_crc_table: list[np.ndarray] = []


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 with the generator 0x04C11DB7, not reflected, begun with ones."""
    if not _crc_table:
        t = np.arange(256, dtype=np.uint64) << np.uint64(24)
        for _ in range(8):
            t = ((t << np.uint64(1)) ^ np.where(t & np.uint64(1 << 31), np.uint64(0x04C11DB7), np.uint64(0))) & np.uint64(0xFFFFFFFF)
        _crc_table.append(t)
    crc, t = 0xFFFFFFFF, _crc_table[0]
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ int(t[(crc >> 24) ^ b])
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table_id, 0xB0 | n >> 8, n & 255, extension >> 8, extension & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + section).ljust(PACKET, bytes([STUFFING]))


def _tables(counter: int) -> bytes:
    pat = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(0x02, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
    return _table_packet(PAT_PID, pat, counter) + _table_packet(PMT_PID, pmt, counter)


_HEADS = [_tables(k) for k in range(16)]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 255 | 1, pts >> 7 & 255, pts << 1 & 255 | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [] if payload else [_HEADS[0]], 0
    for k, i in enumerate(range(0, len(payload), FRAME)):
        frame, pts = payload[i : i + FRAME], FIRST_PTS + k * FRAME_TICKS
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (len(frame) + 8).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + _stamp(pts & (1 << 33) - 1) + frame
        # The first packet of a random-access point has the indicator and a clock reference.
        clock = b""
        if k % GROUP == 0:
            out.append(_HEADS[k // GROUP & 15])
            base = pts - FRAME_TICKS & (1 << 33) - 1
            clock = bytes([0x50]) + (base << 15 | 0x7E00).to_bytes(6, "big")
        first = 184 - (1 + len(clock) if clock else 0)
        n = 1 + max(0, -(-(len(pes) - first) // 184))
        block = np.full((n, PACKET), STUFFING, dtype=np.uint8)
        block[:, 0], block[:, 1], block[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        block[0, 1] |= 0x40
        block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        data = np.frombuffer(pes, dtype=np.uint8)
        sizes = [min(first, len(pes))] if n == 1 else [first, *[184] * (n - 2), len(pes) - first - 184 * (n - 2)]
        if n > 2:
            block[1 : n - 1, 4:] = data[first : first + 184 * (n - 2)].reshape(-1, 184)
        for row in {0, n - 1}:
            size, fields = sizes[row], clock if row == 0 else b""
            gap = 184 - size
            if gap:  # an adaptation field of just that size
                block[row, 3] |= 0x20
                block[row, 4] = gap - 1
                if gap > 1:
                    block[row, 5] = 0
                    block[row, 5 : 5 + len(fields)] = np.frombuffer(fields, dtype=np.uint8)
            at = 0 if row == 0 else len(pes) - size
            block[row, PACKET - size :] = data[at : at + size]
        out.append(block.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds: the payload of its first elementary stream, timestamps, indices and timestamps of random-access points, and faults: bytes outside packets, packets that are sent twice, breaks in the counters, and broken or missing tables."""

    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    random_access: list[tuple[int, int]] = field(default_factory=list)
    packets: int = 0
    skipped_bytes: int = 0
    duplicates: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    stream_type: int = -1


def _parsed(section: bytes, table_id: int) -> bytes | None:
    """The body of a section with a right CRC."""
    if len(section) < 12 or section[0] != table_id:
        return None
    n = 3 + ((section[1] & 15) << 8 | section[2])
    return section[8 : n - 4] if n <= len(section) and crc32_mpeg(section[:n]) == 0 else None


def _packets(media: bytes) -> np.ndarray:
    """The packets of a stream: runs that begin with sync bytes. Where one breaks off, the next begins where LOCK sync bytes follow each other (or all until the end); a last packet that would overlap it was none."""
    data, at, runs = np.frombuffer(media, dtype=np.uint8), 0, []

    def locked(p: int) -> bool:
        return p + PACKET <= len(data) and bool((data[p : p + LOCK * PACKET : PACKET] == SYNC).all())

    while at + PACKET <= len(data):
        n = (len(data) - at) // PACKET
        sync = data[at : at + n * PACKET : PACKET] == SYNC
        n = n if sync.all() else int(sync.argmin())
        end = at + n * PACKET
        whole = end + PACKET > len(data)
        again = -1 if whole else media.find(SYNC, max(at, end - PACKET) + 1)
        while again >= 0 and not locked(again):
            again = media.find(SYNC, again + 1)
        if 0 <= again < end:
            n -= 1
        if n > 0:
            runs.append(data[at : at + n * PACKET].reshape(-1, PACKET))
        if again < 0:
            break
        at = again
    return np.concatenate(runs) if runs else np.zeros((0, PACKET), dtype=np.uint8)


def demux(media: bytes) -> Stream:
    """Reads a transport stream; broken packets and lost ones count as faults and leave gaps."""
    out = Stream()
    rows = _packets(media)
    rows, out.packets, out.skipped_bytes = rows[rows[:, 1] & 0x80 == 0], len(rows), len(media) - rows.size  # the sender's marks of errors
    pids = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    adaptation = np.where(control & 2, rows[:, 4].astype(np.int64) + 1, 0)
    begin = np.minimum(4 + adaptation, PACKET)

    def found(pid: int, table_id: int) -> bytes | None:
        """The body of the first right section of a table; wrong ones, or that there is none, are counted."""
        at = np.flatnonzero((pids == pid) & (control & 1 > 0))
        starts, wrong = np.flatnonzero(rows[at, 1] & 0x40), 0
        for i, j in zip(starts, [*starts[1:], len(at)], strict=False):
            data = b"".join(rows[k, begin[k] :].tobytes() for k in at[i:j])
            if j < len(at) and (more := rows[at[j], begin[at[j]] :].tobytes()):  # the end of a section before the next
                data += more[1 : 1 + more[0]]
            body = _parsed(data[1 + data[0] :], table_id) if data else None
            if body is not None:
                out.table_errors += wrong
                return body
            wrong += 1
        out.table_errors += max(wrong, 1)
        return None

    programs = found(PAT_PID, 0x00)
    pmt_pid = next(((programs[i + 2] & 31) << 8 | programs[i + 3] for i in range(0, len(programs) - 3, 4) if programs[i] << 8 | programs[i + 1]), None) if programs else None
    if pmt_pid is None:
        out.table_errors += 1
    program = found(pmt_pid, 0x02) if pmt_pid is not None else None
    if not program or len(program) < 9:
        return out
    at = 4 + ((program[2] & 15) << 8 | program[3])
    out.stream_type, pid = program[at], (program[at + 1] & 31) << 8 | program[at + 2]

    mine = np.flatnonzero((pids == pid) & (control & 1 > 0))
    if not len(mine):
        return out
    counters = rows[mine, 3].astype(np.int64) & 15
    # A packet may be sent twice, one right after the other.
    again = np.concatenate([[False], (np.diff(counters) == 0) & (rows[mine[1:], 4:] == rows[mine[:-1], 4:]).all(axis=1)])
    again[1:] &= ~again[:-1]
    mine, counters, out.duplicates = mine[~again], counters[~again], int(again.sum())
    steps = np.diff(counters) % 16
    out.continuity_errors = int((steps != 1).sum())
    starts = np.flatnonzero(rows[mine, 1] & 0x40)
    parts = []
    for a, b in zip(starts, [*starts[1:], len(mine)], strict=True):
        run = mine[a:b]
        plain = adaptation[run] == 0
        if plain[1:-1].all() and len(run) > 2:
            pes = b"".join((rows[run[0], begin[run[0]] :].tobytes(), rows[run[1:-1], 4:].tobytes(), rows[run[-1], begin[run[-1]] :].tobytes()))
        else:
            pes = b"".join(rows[i, begin[i] :].tobytes() for i in run)
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            continue
        size = int.from_bytes(pes[4:6], "big")
        frame = pes[9 + pes[8] : 6 + size if size else None]
        if pes[7] & 0x80:
            s = pes[9:14]
            pts = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1
            if adaptation[run[0]] > 1 and rows[run[0], 5] & 0x40:
                out.random_access.append((len(out.pts), pts))
            out.pts.append(pts)
        parts.append(frame)
    out.payload = b"".join(parts)
    return out


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % ALIGN or (0 if data else ALIGN))


def store(text: Column) -> Column:
    """The transport stream of each whole text in UTF-8, padded by zero bytes to a positive multiple of 64 (a null text is empty). Equal texts have equal streams, repeated rows too; other columns and empty tables need no rule."""

    @F.pandas_udf("binary")
    def muxed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mux(padded(x)) for x in texts], dtype=object)

    return muxed(text)


READ = "payload binary, packets int, pts array<bigint>, random_access array<struct<frame:int,pts:bigint>>, continuity_errors int, table_errors int"


def read(media: Column, payload: bool = True) -> Column:
    """What demux() finds in each stream; null for null."""

    @F.pandas_udf(READ)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for x in s:
                m = demux(x) if x is not None else Stream()
                out.append((m.payload, m.packets, m.pts, [{"frame": a, "pts": b} for a, b in m.random_access], m.continuity_errors, m.table_errors))
            yield pd.DataFrame(out, columns=["payload", "packets", "pts", "random_access", "continuity_errors", "table_errors"])

    return parsed(media)


def describe(media: Column) -> Column:
    """Digests of each stream (none is null) and of the payload read back from it, made where the stream is."""
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @F.pandas_udf(kind)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for s in batches:
            out = []
            for x in s:
                m = demux(x)
                seconds = (m.pts[-1] - m.pts[0] + FRAME_TICKS) / CLOCK if m.pts else 0
                said = f"type={m.stream_type};packets={m.packets};frames={len(m.pts)};random_access={','.join(f'{i}@{t}' for i, t in m.random_access)};seconds={seconds:.2f};continuity_errors={m.continuity_errors};table_errors={m.table_errors}"
                out.append((len(m.payload), sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-ALIGN:]), len(x), sha256(x).hexdigest(), said))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    return digests(media)


def op6_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a transport stream and read back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), describe(store(F.col("text"))).alias("m"))
    return rows.select("doc_id", "n_bytes", "m.*")
