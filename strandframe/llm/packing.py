"""Best-fit packing of documents into sequences of CAPACITY tokens.

Which documents share a sequence depends on their lengths alone, and there are only CAPACITY different lengths. So the plan
is made on the histogram of lengths, whatever the number of documents: lengths above a third of the capacity are matched
greedily, at most two to a sequence, each with the longest that still fits; shorter ones, longest first, go where the
least room remains. Whole runs of sequences with equal room take a length at a time, so that the plan has a bounded
number of steps: a step uses up a length, or all of a run that then has another room, and a run meets each length once
(at most 90 different lengths fit into 4096), which gives fewer than two million steps for any input.
Documents are then numbered within their length (by counts of hashed bins, so that a frequent length isn't one task),
and look up their place in the plan.

A text's ids are those of its words between ASCII white space, in turn: the tokenizer's own pre-tokenizer never joins
across white space. So a word is encoded once and kept in a bounded table, one for each Python worker, whatever the number of
tasks that it runs. Words in which a special token may stand are encoded as they are written, since those have a case.

Defined cases: a null or empty text is the end id alone; a null id is an id; repeated rows are packed as often as they occur;
other columns are ignored; only documents longer than the capacity are cut; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import read, shuffle_partitions, staged, text_of

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END = 1
#: Words that a worker keeps with their ids: twice this number at most; those that weren't met for long are encoded again.
KEPT_WORDS = 400_000
_MARK = b"\x01"
_SPECIAL = b"<|"
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
#: ASCII punctuation; a letter and such a character are never in one token of the pre-tokenizer
_STOP = np.isin(np.arange(256), [x for x in range(33, 127) if not chr(x).isalnum()])
#: second bytes of the letters from U+00C0 to U+00FF, behind LEAD
_LEAD, _LATIN = 0xC3, np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])


def _spaced(text: bytes) -> tuple[bytes, np.ndarray]:
    """With a space between each letter (a-z or of Latin-1) and ASCII punctuation behind it; and where in text those spaces go."""
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_STOP[a])
    at = at[at > 0]
    before = a[at - 1]
    latin = _LATIN[before] & (a[at - 2] == _LEAD) & (at > 1)
    at = at[_LETTER[before] | latin]
    return np.insert(a, at, 32).tobytes(), at


def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as they are looked up (in lower case and cut before punctuation), and where each text's begin and end among them."""
    ends = np.cumsum([0, *map(len, texts)])
    blob, spaces = _spaced(b"".join(texts).lower())
    ends += np.searchsorted(spaces, ends)
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(blob)))
    return lists.values.cast(pa.large_binary()), lists.offsets.to_numpy()


class WordEncoder:
    """bytes of ids (little-endian uint32) of a text in UTF-8."""

    def __init__(self, path: str, most: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.of, self.most = Tokenizer.from_file(path), most
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        (self.mark,) = self._ids(_MARK.decode())

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.of.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: set[bytes]) -> None:
        """Encodes many words in one call, with a mark between them; words in which a mark or a special token may stand go alone."""
        alone = {w for w in words if _MARK in w or _SPECIAL in w}
        for w in alone:
            self.known[w] = self._ids(w.decode()).tobytes()
        rest = list(words - alone)
        for i in range(0, len(rest), 1 << 16):
            part = rest[i : i + (1 << 16)]
            ids = self._ids(b" \x01 ".join(part).decode())
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                raise ValueError("the tokenizer's ids don't keep the marks between words apart")
            raw, cuts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
            lasts = [*(4 * ends).tolist(), len(raw)]
            self.known.update(zip(part, (raw[a:b] for a, b in zip(cuts, lasts, strict=True)), strict=True))

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) + len(words) > self.most:
            self.known, self.before = {}, self.known
        new = set(words) - self.known.keys()
        again = new & self.before.keys()
        self.known.update((w, self.before[w]) for w in again)
        self.learn(new - again)
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        plain = [_SPECIAL not in t for t in texts]
        words, at = _split([t if p else b"" for t, p in zip(texts, plain, strict=True)])
        coded = words.dictionary_encode()
        ids = self._of(coded.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        table, codes = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        long = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(long)])
        raw = table[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], long) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[at]).tolist()
        for t, p, x, y in zip(texts, plain, cuts, cuts[1:], strict=False):
            out.append(raw[x:y] if p else self._with_special(t))
        return out

    def _with_special(self, text: bytes) -> bytes:
        split = [x for w in text.split() for x in ([w] if _SPECIAL in w else _spaced(w.lower())[0].split())]
        words = list(set(split))
        of = dict(zip(words, self._of(words), strict=True))
        return b"".join([of[w] for w in split])


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which outlives its tasks."""
    kept = sys.modules.setdefault("strandframe_worker", types.ModuleType("strandframe_worker")).__dict__
    key = f"words of {path}"
    if key not in kept:
        kept[key] = WordEncoder(path)
    return kept[key]


def _groups(texts: list[bytes], most: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about most bytes, each with the number of its first."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path(TOKENIZER)
        encoder, end = worker_encoder(place), np.uint32(END).tobytes()
        for b in batches:
            rows: list[tuple] = []
            docs = b.column("doc_id").to_pylist()
            for first, texts in _groups(b.column("text").to_pylist()):
                for doc, ids in zip(docs[first:], encoder.encode(texts), strict=False):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            names, kinds = ("doc_id", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32; tokenizer: a file of the tokenizers library that every executor can read (None: the installed public one)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Steps (length, first number, count, first sequence, sequences, offset): the count pieces of that length from that number
    on go to these sequences in turn, one to each at this offset, then a second layer above, and so on."""
    left, used, steps, sequences = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def place(size: int, count: int, first: int, many: int, offset: int) -> None:
        steps.append((size, used[size], count, first, many, offset))
        used[size] += count
        left[size] -= count

    def keep(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in room:
                room[gap] = []
                insort(rooms, gap)
            room[gap].append((first, many))

    def take(gap: int) -> tuple[int, int]:
        got = room[gap].pop()
        if not room[gap]:
            del room[gap]
            rooms.pop(bisect_left(rooms, gap))
        return got

    large = sorted(s for s in histogram if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            at = bisect_left(large, capacity - size + 1) - 1
            while at >= 0 and (left[large[at]] == 0 or (large[at] == size and left[size] < 2)):
                if left[large[at]] == 0:
                    large.pop(at)
                at -= 1
            mate = large[at] if at >= 0 else None
            many = left[size] // 2 if mate == size else min(left[size], left[mate]) if mate else left[size]
            place(size, many, sequences, many, 0)
            if mate:
                place(mate, many, sequences, many, size)
            keep(capacity - size - (mate or 0), sequences, many)
            sequences += many
    for size in sorted((s for s in histogram if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                many = -(-left[size] // (capacity // size))
                keep(capacity, sequences, many)
                sequences += many
                continue
            gap = rooms[at]
            first, many = take(gap)
            if many > left[size]:
                keep(gap, first + left[size], many - left[size])
                many = left[size]
            layers = min(gap // size, left[size] // many)
            place(size, layers * many, first, many, capacity - gap)
            keep(gap - layers * size, first, many)
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def _placed(steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = steps.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            size, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            step = table[np.searchsorted(keys, (size << 44) + number, side="right") - 1]
            layer, lane = np.divmod(number - step[:, 1], step[:, 4])
            out = [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(step[:, 3] + lane), pa.array(step[:, 5] + layer * size)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (rows of pieces()) with sequence_id and offset."""
    spark = cut.sparkSession
    bins = 8 * shuffle_partitions(spark)
    rows = cut.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(bins)))
    counts = staged(rows.groupBy("length", "bin").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = plan(histogram, capacity)
    steps = spark.sparkContext.broadcast(table[np.lexsort((table[:, 1], table[:, 0]))])
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bin")) - F.col("n")).drop("n")
    number = F.col("before") + F.row_number().over(W.partitionBy("length", "bin").orderBy("doc_id", "piece")) - 1
    numbered = rows.join(before, ["length", "bin"]).withColumn("number", number).drop("bin", "before")
    return numbered.mapInArrow(_placed(steps), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


#: SQL has no tokenizer.
ORACLE_SQL = None
