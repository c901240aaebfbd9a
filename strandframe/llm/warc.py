"""WARC records in ZIP packages, read by byte ranges.

write() stores WARC/1.1 records, a gzip member each, in ZIP files in a folder that all executors share: stored (not
deflated) members archive/data-*.warc.gz of about MEMBER bytes and, for each, indexes/index-*.cdxj, a sorted line a record with its place. All
sizes and offsets stand in ZIP64 fields. read_records() parses the end of the file, its ZIP64 locator and record if there are
any, and the central directory, reads the indexes, deals runs of records to tasks, and reads each run as one byte range:
nothing is extracted. A payload's later copies are revisit records that name the first.

Packages of others are read too: archives are the stored members *.warc and *.warc.gz of any folder, indexes the members of
indexes/ (CDX or CDXJ lines, stored or deflated, gzipped or not, one for all archives or one each); an archive that no index
names is looked through for its records, a stretch at a time. A deflated archive is an error, since it has no ranges to read.

Archives are written under new names and count only once their task has reported them, so that tasks may be repeated.

Defined cases: a null payload is empty; a null url is empty, control characters in it are percent-encoded; a null page id
is a page id, and never the one that others revisit if there are others; repeated rows are records of their own, of the
same type and id; payloads under 100 bytes are never revisits; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import new_path, read, shuffle_partitions, staged

LEAST_REVISIT = 100
#: Bytes of records in an archive member, and of records that a task reads at once.
MEMBER = 16 << 20
RUN = 4 << 20
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class PackageWriter:
    """A ZIP file of stored members, with ZIP64 fields throughout."""

    def __init__(self, out) -> None:
        self.out, self.at, self.central = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Returns where the member's data starts."""
        raw, crc, at = name.encode(), zlib.crc32(data), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(_LOCAL + struct.pack("<5HIIIHH", 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)
        start = self.at
        self._put(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        self.central.append(_CENTRAL + struct.pack("<6HIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        return start

    def close(self) -> None:
        at, n = self.at, len(self.central)
        self._put(b"".join(self.central))
        size, end = self.at - at, self.at
        self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at))
        self._put(_LOCATOR + struct.pack("<IQI", 0, end, 1))
        self._put(_END + struct.pack("<4HIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def directory(file, size: int) -> list[dict]:
    """name, method, size and offset (of the local header) of each member. file: read_at(length, offset)."""
    tail_at = max(0, size - 65535 - 22)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    where = tail_at + at - 20
    locator = file.read_at(20, where) if where >= 0 else b""
    if locator[:4] == _LOCATOR:
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record = file.read_at(56, end64)
        if record[:4] != _END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, members = file.read_at(length, start), 0, []
    for _ in range(n):
        if raw[at : at + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        method, crc, packed, whole, a, b, c, offset = struct.unpack_from("<H4xIIIHHH8xI", raw, at + 10)
        name, extra = raw[at + 46 : at + 46 + a].decode(), raw[at + 46 + a : at + 46 + a + b]
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            if kind == 1:  # holds only those values, in this order, that are all ones above
                values = iter(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                whole = next(values) if whole == 0xFFFFFFFF else whole
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + long :]
        members.append({"name": name, "method": method, "size": packed, "offset": offset, "crc": crc})
        at += 46 + a + b + c
    return members


def data_start(file, member: dict, methods: tuple[int, ...] = (0,)) -> int:
    head = file.read_at(30, member["offset"])
    if head[:4] != _LOCAL or member["method"] not in methods:
        raise ValueError(f"{member['name']} isn't a stored member")
    return member["offset"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(member: bytes) -> dict:
    """A record's fields; payload is None for revisits, page_id and refers_to where ids aren't of our kind. Kinds without a payload have none."""
    raw = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    kind, http = fields["warc-type"], "application/http" in fields.get("content-type", "")
    lines, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = next((int(x.split(b":")[1]) for x in lines.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    of = lambda x: int(x[len("<urn:page:") : -1]) if x and x.startswith("<urn:page:") and x != "<urn:page:None>" else None
    whole = kind in ("response", "resource", "conversion")
    if kind == "response" and len(payload) != stated:
        raise ValueError("a payload isn't as long as its record says")
    return {"page_id": of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": stated, "payload": payload if whole else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to": of(fields.get("warc-refers-to"))}


def _key(url: str | None) -> str:
    """What index lines are sorted by: the host from its end, then the rest."""
    scheme, mark, rest = _clean(url).partition("://")
    if not mark:
        return _clean(url)
    host, slash, path = rest.partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path}"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = package = None
        archive: list[bytes] = []
        lines: list[str] = []
        size = members = total = 0

        def flush() -> None:
            nonlocal size, members
            package.add(f"archive/data-{members:05d}.warc.gz", b"".join(archive))
            package.add(f"indexes/index-{members:05d}.cdxj", "".join(sorted(lines)).encode())
            archive.clear()
            lines.clear()
            size, members = 0, members + 1

        for b in batches:
            for r in b.to_pylist():
                if package is None:
                    fs, root = _open(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    package = PackageWriter(out)
                raw = record(r["page_id"], r["url"], r["html"] or b"", r["length"], r["digest"], r["refers_to"], r["revisit"])
                place = {"url": _clean(r["url"]), "digest": "sha256:" + r["digest"], "filename": f"data-{members:05d}.warc.gz", "offset": str(size), "length": str(len(raw))}
                lines.append(f"{_key(r['url'])} 19700101000000 {json.dumps(place)}\n")
                archive.append(raw)
                size, total = size + len(raw), total + 1
                if size >= MEMBER:
                    flush()
        if package:
            if archive:
                flush()
            package.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([total], pa.int64())], ["archive", "records"])

    return run


def _index_lines(file, members: list[dict]) -> Iterator[tuple[str, int, int]]:
    """File name, offset and length of each line of the package's indexes."""
    for m in members:
        if not re.search(r"(^|/)indexes/[^/]+\.cdxj?(\.gz)?$", m["name"]):
            continue
        raw = file.read_at(m["size"], data_start(file, m, (0, 8)))
        raw = zlib.decompress(raw, -15) if m["method"] == 8 else raw
        lines = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
        for line in lines.decode().splitlines():
            if "{" in line:
                x = json.loads(line[line.index("{") :])
                if "filename" in x:
                    yield x["filename"].rsplit("/", 1)[-1], int(x["offset"]), int(x["length"])
            elif len(cells := line.split()) >= 11 and cells[0] != "CDX":
                yield cells[10].rsplit("/", 1)[-1], int(cells[9]), int(cells[8])


def _places(file, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of an archive without an index, which is read from its start, a step at a time."""
    at = begin = 0
    if file.read_at(min(2, size), start) == b"\x1f\x8b":
        inflate = zlib.decompressobj(31)
        while at < size:
            part = file.read_at(min(step, size - at), start + at)
            at += len(part)
            while part:
                inflate.decompress(part)
                part = inflate.unused_data
                if not inflate.eof:
                    break
                yield begin, at - len(part) - begin
                begin, inflate = at - len(part), zlib.decompressobj(31)
        return
    while at < size:
        head = file.read_at(min(1 << 16, size - at), start + at)
        end = head.index(b"\r\n\r\n") + 4
        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head[:end])[1])
        yield at, min(end + length + 4, size - at)
        at += end + length + 4


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of records that lie next to each other, about RUN bytes each."""
    for b in batches:
        for package in b.column("archive").to_pylist():
            fs, path = _open(package)
            with fs.open_input_file(path) as file:
                members = directory(file, file.size())
                listed: dict[str, list[tuple[int, int]]] = {}
                for name, offset, length in _index_lines(file, members):
                    listed.setdefault(name, []).append((offset, length))
                for m in sorted((m for m in members if re.search(r"\.warc(\.gz)?$", m["name"])), key=lambda m: m["name"]):
                    start = data_start(file, m)
                    places = sorted(set(listed.get(m["name"].rsplit("/", 1)[-1], ()))) or _places(file, start, m["size"])
                    runs: list[tuple[int, list[int]]] = []
                    end = -1
                    for offset, length in places:
                        if not runs or offset != end or offset + length - runs[-1][0] > RUN:
                            runs.append((offset, []))
                        runs[-1][1].append(length)
                        end = offset + length
                    yield pa.RecordBatch.from_arrays([pa.array([package] * len(runs)), pa.array([start + r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], ["archive", "start", "lengths"])


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = _open(r["archive"])
                with fs.open_input_file(path) as file:
                    raw = file.read_at(sum(r["lengths"]), r["start"])
                rows, at = [], 0
                for length in r["lengths"]:
                    x = parse(raw[at : at + length])
                    at += length
                    if x["payload"] is not None and re.fullmatch("[0-9a-f]{64}", x["payload_digest"]) and hashlib.sha256(x["payload"]).hexdigest() != x["payload_digest"]:
                        raise ValueError("a payload isn't what its digest says")
                    rows.append(x)
                kinds = _FIELDS | ({"payload": pa.binary()} if with_payload else {})
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in kinds.items()], list(kinds))

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives into folder and returns a row (archive, records) for each."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("length"))
    marks = staged(rows.select("page_id", "digest", "length").distinct(), "digests")
    # a table of its own, so that Spark can split the join for a digest of many pages; pages themselves are joined by page id
    first = staged(marks.where(F.col("length") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    again = marks.join(first, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", F.col("first").alias("refers_to"))
    joined = rows.alias("r").join(again.alias("a"), F.expr("r.page_id <=> a.page_id and r.digest = a.digest"), "left")
    revisit = F.col("refers_to").isNotNull()
    out = joined.select("r.page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "r.digest", "length", "refers_to", revisit.alias("revisit"))
    return staged(out.mapInArrow(_writer(folder), "archive string, records long"), "archives")


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of archives (archive: URI): page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked for (null for revisits)."""
    spark = archives.sparkSession
    runs = archives.select("archive").repartition(shuffle_partitions(spark), "archive").mapInArrow(_runs, "archive string, start long, lengths array<long>")
    kinds = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return runs.repartition(shuffle_partitions(spark), "archive", "start").mapInArrow(_records(with_payload), kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= {LEAST_REVISIT} then min(page_id) over (partition by payload_digest) end as first from p)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to from f"""
