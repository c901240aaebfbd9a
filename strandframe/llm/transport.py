"""Media columns: MPEG transport streams (ISO/IEC 13818-1) that carry a payload of bytes, and a reader for them.

mux() cuts a payload into PES packets of CHUNK bytes, 3600 ticks of 90 kHz apart, on one private-data PID. Each PES packet
starts with a clock reference; each GROUP-th is a random-access point before which the program tables stand. demux() reads
any stream of 188-byte packets in the clear: it reassembles the program tables (over any number of packets; their checksums are
verified), finds the elementary streams, checks the continuity counters, leaves out repeated packets, reassembles PES packets and
lists timestamps with random-access points, which the query returns too (timestamps).
A damaged stream is an error (ValueError) that names the fault, unless faults are asked for as counts.

Defined cases: a null text is empty; an empty text is 64 zero bytes; a null id is kept; repeated rows each get a row; other
columns are ignored; an empty table gives an empty result. No size limit but that of a cell (2 GB).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import read, staged, text_of

PACKET = 188
PMT_PID, DATA_PID = 0x1000, 0x100
CHUNK = 16384
GROUP = 8
TICKS = 3600
UNIT = 64


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        c &= 0xFFFFFFFF
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _tables() -> np.ndarray:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    packets = [b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s + b"\xff" * (183 - len(s)) for pid, s in ((0, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(packets), np.uint8).reshape(2, PACKET)


def _pes(chunk: bytes, ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    stamp = bytes([0x21 | ticks >> 29 & 0xE]) + ((ticks >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((ticks & 0x7FFF) << 1 | 1).to_bytes(2, "big")
    return b"\x00\x00\x01\xbd" + (len(chunk) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + chunk


def mux(payload: bytes) -> bytes:
    tables, parts, counter = _tables(), [], 0
    for k, start in enumerate(range(0, len(payload), CHUNK)):
        if k % GROUP == 0:
            at = tables.copy()
            at[:, 3] |= k // GROUP % 16
            parts.append(at.tobytes())
        pes = _pes(payload[start : start + CHUNK], k * TICKS)
        head = min(176, len(pes))
        rest = len(pes) - head
        many = 1 + -(-rest // 184)
        p = np.full((many, PACKET), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        p[:, 3] = 0x10 | (counter + np.arange(many)) % 16
        counter += many
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        clock = k * TICKS & (1 << 33) - 1
        p[0, 4], p[0, 5] = 183 - head, 0x50 if k % GROUP == 0 else 0x10
        p[0, 6:12] = np.frombuffer((clock << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        p[0, PACKET - head :] = np.frombuffer(pes, np.uint8, head)
        full = rest // 184
        if full:
            p[1 : 1 + full, 4:] = np.frombuffer(pes, np.uint8, full * 184, head).reshape(full, 184)
        if tail := rest % 184:
            p[-1, 3] |= 0x20
            p[-1, 4] = 183 - tail
            if tail < 183:
                p[-1, 5] = 0
            p[-1, PACKET - tail :] = np.frombuffer(pes, np.uint8, tail, head + full * 184)
        parts.append(p.tobytes())
    return b"".join(parts)


def _sections(rows: np.ndarray, at: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Sections in the packets of one PID, in order; a section may go on through several packets, and a packet may hold several."""
    held, inside = b"", False
    for row, off, start in zip(rows, at.tolist(), starts.tolist(), strict=True):
        raw = row[off:].tobytes()
        parts = [raw] if not start else [raw[1 : 1 + raw[0]], raw[1 + raw[0] :]]
        for k, part in enumerate(parts):
            if start and k == 1:
                held, inside = b"", True
            held += part if inside else b""
            while inside and len(held) >= 3 and held[0] != 0xFF:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
                if len(held) < size:
                    break
                if crc32_mpeg(held[:size]) != 0:
                    raise ValueError("a program table's checksum is wrong")
                yield held[:size]
                held = held[size:]


def demux(stream: bytes, strict: bool = True) -> dict:
    """payload, index (ticks, packet, random access) of each PES packet, and counts.

    lost counts gaps in continuity counters that no discontinuity flag announces, packets that repeat a counter with other
    data, packets marked as damaged, and PES packets cut short. Scrambled packets are always an error.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    broken = p[:, 1] & 0x80 > 0
    many, lost, repeated = len(p), int(broken.sum()), 0
    place = np.flatnonzero(~broken)
    p = p[place]
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    if (p[pid != 0x1FFF, 3] & 0xC0).any():
        raise ValueError("a packet is scrambled")
    starts, has_field, has_data = p[:, 1] & 0x40 > 0, p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    at = np.minimum(4 + np.where(has_field, 1 + p[:, 4].astype(np.int64), 0), PACKET)
    flags = np.where(has_field & (p[:, 4] > 0), p[:, 5], 0)
    entry, announced = flags & 0x40 > 0, flags & 0x80 > 0
    sections = lambda on: _sections(p[on], at[on], starts[on])
    pmts, streams = set(), set()
    for s in sections((pid == 0) & has_data):
        pmts |= {int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 4, 4) if s[i : i + 2] != b"\x00\x00"}
    for table in sorted(pmts):
        for s in sections((pid == table) & has_data):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i < len(s) - 4:
                streams.add(int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF)
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    if not streams:
        raise ValueError("no program table names a stream")
    payload, index = [], []
    for stream_pid in sorted(streams):
        rows = np.flatnonzero((pid == stream_pid) & has_data)
        step = np.diff(p[rows, 3] & 15) % 16
        fresh = announced[rows][1:]
        same = np.zeros(len(rows), bool)
        # a packet may be sent twice; all but its clock reference must be the same then
        for k in np.flatnonzero((step == 0) & ~fresh) + 1:
            x, y = rows[k - 1], rows[k]
            same[k] = at[x] == at[y] and p[x, at[x] :].tobytes() == p[y, at[y] :].tobytes()
        repeated += int(same.sum())
        lost += int(((step != 1) & ~fresh & ~same[1:]).sum())
        rows = rows[~same]
        data = p[rows]
        inside = np.arange(PACKET) >= at[rows][:, None]
        flat, ends = data[inside].tobytes(), np.cumsum(PACKET - at[rows])
        first = np.flatnonzero(starts[rows])
        if not len(first):  # a stream that the tables name need not have packets
            continue
        begin = [int(ends[i] - (PACKET - at[rows[i]])) for i in first]
        for i, a, b in zip(first, begin, [*begin[1:], len(flat)], strict=True):
            if flat[a : a + 3] != b"\x00\x00\x01":
                raise ValueError("a PES packet doesn't start where it should")
            long, marks, head = int.from_bytes(flat[a + 4 : a + 6], "big"), flat[a + 7], flat[a + 8]
            t = flat[a + 9 : a + 14]
            ticks = (t[0] >> 1 & 7) << 30 | int.from_bytes(t[1:3], "big") >> 1 << 15 | int.from_bytes(t[3:5], "big") >> 1 if marks & 0x80 else None
            end = a + 6 + long if long else b
            if end > b:
                lost += 1
            payload.append(flat[a + 9 + head : end])
            index.append((ticks, int(place[rows[i]]), bool(entry[rows[i]])))
    if strict and lost:
        raise ValueError(f"{lost} gaps in continuity counters or PES packets")
    return {"payload": b"".join(payload), "index": index, "packets": many, "streams": len(streams), "lost": lost, "repeated": repeated}


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text")
        for i in range(0, b.num_rows, 256):
            some = [texts[j].as_py() for j in range(i, min(i + 256, b.num_rows))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 256), pa.array([len(t) for t in some], pa.int64()), pa.array([mux(padded(t)) for t in some], pa.binary())], ["doc_id", "n_bytes", "media"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("ticks", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())])
    for b in batches:
        rows = []
        for cell in b.column("media"):
            media = cell.as_py()
            got = demux(media)
            data, stamps = got["payload"], [x[0] for x in got["index"]]
            feature = f"packets={got['packets']};streams={got['streams']};pes={len(stamps)};entries={sum(x[2] for x in got['index'])};first={stamps[0]};last={stamps[-1]};lost={got['lost']};repeated={got['repeated']}"
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, [dict(zip(entry.names, x, strict=True)) for x in got["index"]]))
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "timestamps": pa.list_(entry)}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values()))], ["doc_id", "n_bytes", *kinds])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a transport stream."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def index(media: DataFrame) -> DataFrame:
    """What the streams hold: digests, features and timestamps (ticks of 90 kHz, packet number, whether reading can start there)."""
    return media.mapInArrow(_index, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<struct<ticks: long, packet: long, random_access: boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(staged(store(read(spark, sf_dir, "documents")), "media"))


#: SQL has no packets; tests hold the round trip against the texts.
ORACLE_SQL = None
