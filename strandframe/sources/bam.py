"""BAM files: a data source that reads them, a writer and an index. Plain zlib and struct; files on any file system pyarrow can open.

spark.dataSource.register(BamSource); spark.read.format("bam").option("region", "chr1:0-1000").load(path). Several paths may be
given, separated by commas. A file is cut into byte ranges of split_bytes; a task looks for the first block that begins in its range and
for the first record that begins there, so no pass over the file comes before. With an index beside the file (.bai) a region reads
only the chunks that the index names. rec_idx is a record's virtual offset (and the file's number), so it needs no counting: it
tells records apart and is in file order.

Integer tags keep their width as a letter (NM:C:5); SAM text has one kind of integers.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe import schema

_LETTERS, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


class _Digits(dict):
    """Letters as hexadecimal digits; any other letter is N."""

    def __missing__(self, key: int) -> str:
        return "f"


_TO_HEX = _Digits({ord(c): "0123456789abcdef"[i] for i, c in enumerate(_LETTERS)})
_FROM_HEX = str.maketrans("0123456789abcdef", _LETTERS)
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT = 8 << 20
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_FIELDS = pa.schema([(n, _TYPES[k]) for n, k in (x.split(" ") for x in schema.ALIGNMENTS.split(", "))])


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def blocks(file, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and data of each BGZF block from an offset on."""
    while head := file.read_at(18, at):
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = file.read_at(extra, at + 12)
        i = 0
        while fields[i : i + 2] != b"BC":
            i += 4 + struct.unpack_from("<H", fields, i + 2)[0]
        size = struct.unpack_from("<H", fields, i + 4)[0] + 1
        raw = file.read_at(size, at)
        yield at, zlib.decompress(raw[12 + extra : -8], -15)
        at += size


class _Stream:
    """Bytes of consecutive blocks, with the block in which the next byte is."""

    def __init__(self, file, at: int, skip: int) -> None:
        self.source, self.data, self.at = blocks(file, at), b"", 0
        self.marks: list[tuple[int, int]] = []  # place in data, block
        self._more()
        self.at = skip

    def _more(self) -> bool:
        rest = self.data[self.at :]
        self.marks = [(p - self.at, o) for p, o in self.marks if p - self.at + 65536 > 0 or (p, o) == self.marks[-1]]
        got = next(self.source, None)
        if got is None:
            self.data, self.at = rest, 0
            return False
        self.marks.append((len(rest), got[0]))
        self.data, self.at = rest + got[1], 0
        return True

    def where(self) -> tuple[int, int]:
        while self.at >= len(self.data) and self._more():
            pass
        for place, block in reversed(self.marks):  # in the order of their places
            if place <= self.at:
                return block, self.at - place
        return -1, self.at

    def take(self, n: int) -> bytes | None:
        while len(self.data) - self.at < n:
            if not self._more():
                return None
        self.at += n
        return self.data[self.at - n : self.at]


def header(path: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """Text, contigs with their lengths, and where the first record is (block, offset in it)."""
    s = _Stream(_open(path), 0, 0)
    number = lambda: struct.unpack("<i", s.take(4))[0]
    if s.take(4) != b"BAM\1":
        raise ValueError(f"{path} isn't a BAM file")
    text = s.take(number()).rstrip(b"\0").decode()
    contigs = []
    for _ in range(number()):
        name = s.take(number())[:-1].decode()
        contigs.append((name, number()))
    return text, contigs, s.where()


@lru_cache(1 << 12)
def _cigar(raw: bytes) -> str:
    return "".join(f"{x >> 4}{_OPS[x & 15]}" for (x,) in struct.iter_unpack("<I", raw)) or "*"


@lru_cache(1 << 12)
def _tag_texts(raw: bytes) -> tuple[str | None, str]:
    """The mate's CIGAR, if a tag has it, and all tags as text."""
    tags = list(_tags(raw))
    return next((t[5:] for t in tags if t.startswith("MC:Z:")), None), "\t".join(tags)


def _tags(raw: bytes) -> Iterator[str]:
    sizes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    i = 0
    while i < len(raw):
        tag, kind = raw[i : i + 2].decode(), chr(raw[i + 2])
        i += 3
        if kind in "ZH":
            end = raw.index(0, i)
            yield f"{tag}:{kind}:{raw[i:end].decode()}"
            i = end + 1
        elif kind == "A":
            yield f"{tag}:A:{chr(raw[i])}"
            i += 1
        elif kind == "B":
            of, n = chr(raw[i]), struct.unpack_from("<i", raw, i + 1)[0]
            values = struct.unpack_from(f"<{n}{sizes[of]}", raw, i + 5)
            yield f"{tag}:B:{','.join([of, *(str(np.float32(v)) if of == 'f' else str(v) for v in values)])}"
            i += 5 + struct.calcsize(f"<{n}{sizes[of]}")
        else:
            (v,) = struct.unpack_from("<" + sizes[kind], raw, i)
            yield f"{tag}:f:{np.float32(v)!s}" if kind == "f" else f"{tag}:{kind}:{v}"
            i += struct.calcsize(sizes[kind])


def decode(raw: bytes, contigs: list[tuple[str, int]], index: int) -> tuple:
    """A record's row."""
    tid, pos, name, mapq, _, n_ops, flag, length, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    i = 32 + name
    cigar = _cigar(raw[i : i + 4 * n_ops])
    i += 4 * n_ops
    seq = raw[i : i + (length + 1) // 2].hex().translate(_FROM_HEX)[:length]
    i += (length + 1) // 2
    mc, tags = _tag_texts(raw[i + length :])
    return index, raw[32 : 31 + name].decode(), flag, tid, contigs[tid][0] if tid >= 0 else "*", pos, mapq, cigar, mtid, mpos, seq, list(raw[i : i + length]), mc, tags, contigs[mtid][0] if mtid >= 0 else "*", tlen


def _next_block(file, at: int, end: int) -> int | None:
    """Offset of the first block that begins from at to before end: its header leads to another block's, or to the file's end."""
    size = file.size()
    while at < end:
        window = file.read_at(min(end + 18 - at, 1 << 17), at)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0 and i + 18 <= len(window):
            if window[i + 12 : i + 14] == b"BC":
                after = at + i + struct.unpack_from("<H", window, i + 16)[0] + 1
                if after == size or (after < size and file.read_at(4, after) == b"\x1f\x8b\x08\x04"):
                    return at + i if at + i < end else None
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(len(window) - 17, 1)
    return None


def _looks_right(data: bytes, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """Where the record behind this one begins, if what is here can be a record."""
    size, tid, pos, name, _, _, n_ops, _, length, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    right = size >= 32 and -1 <= tid < len(contigs) and -1 <= mtid < len(contigs) and pos >= -1 and mpos >= -1 and name > 0 and length >= 0
    if not right or 32 + name + 4 * n_ops + (length + 1) // 2 + length > size:
        return None
    if (tid >= 0 and pos > contigs[tid][1]) or (mtid >= 0 and mpos > contigs[mtid][1]):
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(not 33 <= c <= 126 for c in text[:-1])):
        return None
    ops = data[at + 36 + name : at + 36 + name + 4 * n_ops : 4]
    return None if any(x & 15 > 8 for x in ops) else at + 4 + size


def _first_record(file, block: int, contigs: list[tuple[str, int]]) -> int | None:
    """Offset in the block's data of the first record that begins in it, found by following records for a while."""
    data, many = b"", None
    for _, part in blocks(file, block):
        data += part
        many = len(part) if many is None else many
        if len(data) >= many + (1 << 18):
            break
    for start in range(many or 0):
        at, seen = start, 0
        while at is not None and seen < 24 and at + 36 <= len(data):
            at, seen = _looks_right(data, at, contigs), seen + 1
        if at is not None and seen:
            return start
    return None


def read_index(path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]] | None:
    """Of each contig, the chunks by bin and the linear index; None if there is no index beside the file."""
    try:
        with _open(path + ".bai") as file:
            raw = file.read_at(file.size(), 0)
    except FileNotFoundError:
        return None
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{path}.bai isn't an index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        bins = {}
        (many,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(many):
            number, n = struct.unpack_from("<Ii", raw, at)
            bins[number] = list(struct.iter_unpack("<QQ", raw[at + 8 : at + 8 + 16 * n]))
            at += 8 + 16 * n
        (n,) = struct.unpack_from("<i", raw, at)
        out.append((bins, list(struct.unpack_from(f"<{n}Q", raw, at + 4))))
        at += 4 + 8 * n
    return out


def chunks(index: list, tid: int, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches of the file (virtual offsets) in which records that touch the region can be, in order and apart."""
    bins, linear = index[tid]
    least = linear[min(start >> 14, len(linear) - 1)] if linear else 0
    found = []
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        for number in range(first + (start >> shift), first + (max(end - 1, start) >> shift) + 1):
            found += bins.get(number, [])
    out: list[tuple[int, int]] = []
    for low, high in sorted((max(a, least), b) for a, b in (*found, *bins.get(0, [])) if b > least):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _ranges(start: int, end: int, split: int) -> Iterator[tuple[int, int, int | None]]:
    """The stretch between two virtual offsets by ranges of split bytes: byte, virtual offset of the end, and that of the beginning where it is known."""
    at = start >> 16
    while at << 16 < end:
        yield at, min(at + split << 16, end), start if at == start >> 16 else None
        at += split


def _records(path: str, at: int, end: int, begin: int | None) -> Iterator[tuple[int, bytes, int]]:
    """Virtual offset, body and virtual offset of what follows, of each record that begins in a range."""
    _, contigs, first = header(path)
    file = _open(path)
    if begin is None and at <= first[0]:
        begin = first[0] << 16 | first[1]
    place = None if begin is None else (begin >> 16, begin & 0xFFFF)
    while place is None:
        block = _next_block(file, at, -(-end >> 16))
        if block is None:
            return
        skip = _first_record(file, block, contigs)
        place, at = None if skip is None else (block, skip), block + 1
    stream = _Stream(file, *place)
    block, offset = stream.where()
    while block >= 0 and (here := block << 16 | offset) < end:
        size = stream.take(4)
        if size is None:
            return
        raw = stream.take(struct.unpack("<i", size)[0])
        block, offset = stream.where()
        yield here, raw, block << 16 | offset if block >= 0 else 1 << 62


class _Part(InputPartition):
    """A range as _ranges() gives it; with chunk it is from the index."""

    def __init__(self, path: str, number: int, at: int, end: int, begin: int | None, chunk: bool = False) -> None:
        self.path, self.number, self.at, self.end, self.begin, self.chunk = path, number, at, end, begin, chunk


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("split_bytes", SPLIT))
        m = re.fullmatch(r"(.+):(\d+)-(\d+)", options.get("region", ""))
        self.region = (m[1], int(m[2]), int(m[3])) if m else None

    def partitions(self) -> list[_Part]:
        parts = []
        for number, path in enumerate(self.paths):
            index = read_index(path) if self.region else None
            if index is not None:
                names = [n for n, _ in header(path)[1]]
                found = chunks(index, names.index(self.region[0]), *self.region[1:]) if self.region[0] in names else []
                # a chunk may be most of the file: it is cut as a file is
                parts += [_Part(path, number, *x, True) for a, b in found for x in _ranges(a, b, self.split)]
            else:
                with _open(path) as file:
                    size = file.size()
                parts += [_Part(path, number, a, min(a + self.split, size) << 16, None) for a in range(0, size, self.split)]
        return parts

    def rows(self, part: _Part) -> Iterator[tuple]:
        _, contigs, _ = header(part.path)
        for at, raw, _ in _records(part.path, part.at, part.end, part.begin):
            tid, pos = struct.unpack_from("<ii", raw)
            if self.region is None or (tid >= 0 and contigs[tid][0] == self.region[0] and self.region[1] <= pos < self.region[2]):
                yield decode(raw, contigs, part.number << 56 | at)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows = self.rows(part)
        while some := list(islice(rows, 2048)):
            columns = [_bytes_as_lists(c) if f.name == "qual" else pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_FIELDS)


def _bytes_as_lists(rows: Iterable[list[int]]) -> pa.Array:
    parts = [bytes(x) for x in rows]
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)))


def _lists_as_bytes(lists: pa.Array) -> list[bytes]:
    """Each list of numbers up to 255 as bytes; other numbers are an error."""
    whole, at = lists.flatten().cast(pa.uint8()).to_numpy(zero_copy_only=False).tobytes(), 0
    out = []
    for n in lists.value_lengths().to_pylist():
        out.append(whole[at : at + n])
        at += n
    return out


def _encoded(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The records of a batch; no number of a list becomes an object."""
    columns = [_lists_as_bytes(c) if f.name == "qual" else c.to_pylist() for f, c in zip(batch.schema, batch.columns, strict=True)]
    return (encode(dict(zip(batch.schema.names, x, strict=True))) for x in zip(*columns, strict=True))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return schema.ALIGNMENTS

    def reader(self, schema) -> BamReader:  # noqa: ARG002
        return BamReader(dict(self.options))


def read_alignments(spark: SparkSession, path: str, region: str | None = None) -> DataFrame:
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam")
    return (reader.option("region", region) if region else reader).load(path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(header(path)[1])], schema.CONTIGS)


_WIDTHS = {"c": "b", "C": "B", "s": "h", "S": "H", "I": "I"}


@lru_cache(1 << 12)
def _tag_bytes(text: str) -> bytes:
    tag, kind, value = text.split(":", 2)
    if kind == "B":
        of, *values = value.split(",")
        code = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[of]
        data = [float(v) if of == "f" else int(v) for v in values]
        return tag.encode() + b"B" + of.encode() + struct.pack(f"<i{len(data)}{code}", len(data), *data)
    body = {"Z": lambda: value.encode() + b"\0", "H": lambda: value.encode() + b"\0", "A": lambda: value.encode(), "f": lambda: struct.pack("<f", float(value)), "i": lambda: struct.pack("<i" if int(value) < 1 << 31 else "<I", int(value)), **{k: (lambda k=k: struct.pack("<" + _WIDTHS[k], int(value))) for k in _WIDTHS}}[kind]()
    return tag.encode() + (b"I" if kind == "i" and int(value) >= 1 << 31 else kind.encode()) + body


def _bin(start: int, end: int) -> int:
    """The bin of the UCSC scheme that holds an interval."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


@lru_cache(1 << 12)
def _packed_ops(cigar: str) -> tuple[bytes, int, int]:
    """A CIGAR's operations as stored, how many they are and how many bases of the reference they span."""
    ops = [int(n) << 4 | _OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(ops)}I", *ops), len(ops), sum(x >> 4 for x in ops if _OPS[x & 15] in "MDN=X")


def encode(row) -> bytes:
    ops, n_ops, span = _packed_ops(row["cigar"])
    seq, pos = row["seq"], row["pos"]
    codes = bytes.fromhex(seq.translate(_TO_HEX) + "0" * (len(seq) % 2))
    name = row["qname"].encode() + b"\0"
    tags = b"".join(_tag_bytes(t) for t in row["tags"].split("\t") if t) if row["tags"] else b""
    head = struct.pack("<iiBBHHHiiii", row["tid"], pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + max(span, 1)), n_ops, row["flag"], len(seq), row["mtid"], row["mpos"], row["tlen"] or 0)
    body = head + name + ops + codes + bytes(row["qual"]) + tags
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def _packed(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Blocks that hold these bytes."""
    buffer = bytearray()
    for x in parts:
        buffer += x
        while len(buffer) >= 65280:
            yield _block(bytes(buffer[:65280]))
            del buffer[:65280]
    if buffer:
        yield _block(bytes(buffer))


def _header(text: str, contigs: list[tuple[str, int]]) -> bytes:
    head = b"BAM\1" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
    return head + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", x) for n, x in contigs)


def _create(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    return system.open_output_stream(place, compression=None)


def write(rows: Iterable, text: str, contigs: list[tuple[str, int]], path: str) -> None:
    """Writes a header and rows (in the order given) to a file, from one process."""
    with _create(path) as out:
        for part in (_packed([_header(text, contigs)]), _packed(map(encode, rows)), [_END]):
            for x in part:
                out.write(x)


def _write_part(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        number, path = TaskContext.get().partitionId(), f"{folder}/{uuid4().hex}"
        with _create(path) as out:
            for x in _packed(x for b in batches for x in _encoded(b)):
                out.write(x)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path])], ["number", "path"])

    return run


def write_alignments(records: DataFrame, text: str, contigs: list[tuple[str, int]], path: str) -> None:
    """Placed records in order, then the others. Tasks write the blocks of their parts to the shared folder; the driver copies them
    one behind the other, which is a valid file, and looks at no record."""
    from strandframe.operators.rescale import in_order
    from strandframe.staging import shared_path

    folder = shared_path(records.sparkSession, "bam")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    done = in_order(records).mapInArrow(_write_part(folder), "number long, path string").collect()  # a row a task
    with _create(path) as out:
        for x in _packed([_header(text, contigs)]):
            out.write(x)
        for part in sorted(done, key=lambda r: r["number"]):
            with _open(part["path"]) as file:
                for at in range(0, file.size(), 8 << 20):
                    out.write(file.read_at(8 << 20, at))
        out.write(_END)


def _indexed(path: str, at: int, end: int, begin: int | None) -> list[tuple[int, dict[int, list[list[int]]], dict[int, int]]]:
    """Of the contigs of the records that begin in a range: number, chunks by bin and the first record of each window."""
    out: dict[int, tuple[dict, dict]] = {}
    for here, raw, after in _records(path, at, end, begin):
        tid, pos, name, _, _, n_ops = struct.unpack_from("<iiBBHH", raw)
        if tid < 0:
            continue
        _, _, span = _packed_ops(_cigar(raw[32 + name : 32 + name + 4 * n_ops]))
        low = max(pos, 0)
        high = low + max(span, 1)
        bins, windows = out.setdefault(tid, ({}, {}))
        held = bins.setdefault(_bin(low, high), [])
        if held and held[-1][1] == here:
            held[-1][1] = after
        else:
            held.append([here, after])
        for w in range(low >> 14, ((high - 1) >> 14) + 1):
            windows.setdefault(w, here)
    return [(tid, bins, windows) for tid, (bins, windows) in out.items()]


def write_index(path: str, spark: SparkSession | None = None, split: int = SPLIT) -> None:
    """Writes the index (.bai) of a file sorted by place. With a session, tasks read the file by byte ranges and the driver joins
    what they found, which is no more than the index; without, this process reads it all."""
    _, contigs, _ = header(path)
    with _open(path) as file:
        size = file.size()
    parts = [(path, a, min(a + split, size) << 16, None) for a in range(0, size, split)]
    done = spark.sparkContext.parallelize(parts, len(parts)).map(lambda x: _indexed(*x)).collect() if spark else (_indexed(*x) for x in parts)
    bins: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
    linear: list[list[int]] = [[] for _ in contigs]
    for found in done:  # in the file's order
        for tid, own, places in found:
            for number, held in own.items():
                all_held = bins[tid].setdefault(number, [])
                if all_held and all_held[-1][1] == held[0][0]:
                    all_held[-1][1] = held.pop(0)[1]
                all_held += held
            windows = linear[tid]
            windows += [0] * (max(places) + 1 - len(windows))
            for w, here in places.items():
                windows[w] = windows[w] or here
    with _create(path + ".bai") as out:
        out.write(b"BAI\1" + struct.pack("<i", len(contigs)))
        for of, windows in zip(bins, linear, strict=True):
            out.write(struct.pack("<i", len(of)))
            for number, held in sorted(of.items()):
                out.write(struct.pack("<Ii", number, len(held)) + b"".join(struct.pack("<QQ", *c) for c in held))
            for i in range(1, len(windows)):
                windows[i] = windows[i] or windows[i - 1]
            out.write(struct.pack(f"<i{len(windows)}Q", len(windows), *windows))
