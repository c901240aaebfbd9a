"""Katz backoff language model of any order over words, learned from and evaluated on tables.

P(w | h) = d(c) c / T(h) for n-grams that were seen c times, T(h) times with any word after h; else a(h) P(w | h without its
first word), down to P(w) = d(c) c / N, where what is discounted goes to one unknown word. d is Good-Turing's discount of the order for
counts up to K (Katz' form, renormalised so that larger counts keep theirs; where counts of counts give none between 0 and 1,
1 - 1/(2c)). a(h) makes the words sum to one exactly: (1 - sum of d(c) c / T(h)) / (1 - sum of P(w | shorter h)) over the words seen after h;
it is one for histories that weren't seen. T(h) is one more if none of its n-grams is discounted. The end of a text is a word; as many
ends as needed stand before its first.

Texts are cut into blocks of about BLOCK tokens, written once to the shared folder as numbers of the block's own vocabulary.
A block sends its distinct n-grams of each order, as sorted 64-bit hashes with training counts, to the partitions of the model
(ranges of hashes, as many as the tokens need; one row a block and partition); each partition adds up, keeps its part of the model
table, and answers every block with the totals in the order asked, and which block accounts for an n-gram in the sums over a history.
Then, order by order, histories go the same way for T(h) and a(h), whose sums need the probabilities of the order below. At last
every block evaluates its own tokens by the recursion. Asking goes partition by partition, and evaluation block by block, in WAVES
turns, which bounds the disk that shuffles take. A hot word is one entry a block, so no partition gets more than its share; nothing of
the model is on the driver but its counts of counts.

Defined cases: a null or empty text is the end alone; a null id is held out; repeated rows each count and each get a row;
with no training text every word is unknown (probability one) and the base's counts are zero; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import discard, read, shuffle_partitions, staged, text_of
from strandframe.llm.substrings import _mixed

ORDER = 2
K = 5
BLOCK = 2_500_000
#: Tokens for which the model has a partition: what one task adds up at a time.
RANGE = 2_000_000
#: Blocks and partitions take part a fraction at a time, so that no more than this fraction of what they exchange is on disk.
WAVES = 4
#: The end's hash in place of a word's.
END = 0x51ED270B153A4D2F
_ODD = 0xD6E8FEB86659FD93


def pack(a: np.ndarray) -> bytes:
    """Its bytes, all first ones before all second ones, compressed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def unpack(b: bytes, kind: str) -> np.ndarray:
    size, item = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.empty(0, kind)
    raw = np.frombuffer(pa.Codec("zstd").decompress(b[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(item, -1).T).view(kind).reshape(-1)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


# ---- blocks


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        held: list[bool] = []
        size = 0
        of = xxhash.xxh64_intdigest

        def block() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [uuid.uuid4().int >> 65, list(ids), pack(np.array(held, np.uint8)), pack(np.array([len(h) for h in hashes], np.uint32)), pack(tokens.astype(np.uint32)), pack(vocabulary), len(tokens)]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["block", "ids", "held", "lengths", "tokens", "vocabulary", "n"])

        for b in batches:
            for doc, out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text"), strict=True):
                words = text.as_py().lower().split()
                ids.append(doc)
                held.append(held_out(doc) if out is None else out)
                hashes.append(np.array([*map(of, words), END], np.uint64))
                size += len(words) + 1
                if size >= limit:
                    yield block()
                    ids, hashes, held, size = [], [], [], 0
        if ids:
            yield block()

    return run


class Block:
    """A row of the table of blocks, with its n-grams."""

    def __init__(self, row: dict) -> None:
        self.id, self.ids = row["block"], row["ids"]
        self.held = unpack(row["held"], "u1").astype(bool)
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.words = unpack(row["tokens"], "<u4")
        self.vocabulary = unpack(row["vocabulary"], "<u8")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(~self.held, self.lengths)

    def grams(self, order: int) -> np.ndarray:
        """Each token's hash with the words before it."""
        words = self.vocabulary[self.words]
        return words if order == 1 else _mixed(self.before(order) * np.uint64(_ODD) + words)

    def before(self, order: int) -> np.ndarray:
        """Each token's history in n-grams of an order: the shorter n-gram that ends with the token before it."""
        shorter, ends = self.grams(order - 1), END
        for _ in range(order - 2):
            ends = int(_mixed(np.array([ends * _ODD + END & (1 << 64) - 1], np.uint64))[0])
        out = np.empty_like(shorter)
        out[1:] = shorter[:-1]
        out[self.starts] = ends
        return out

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct n-grams, where each first stands (order 2 and up), and each token's n-gram."""
        if order == 1:
            return self.vocabulary, self.vocabulary[:0], self.words
        return np.unique(self.grams(order), return_index=True, return_inverse=True)

    def histories(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct histories, and each token's history."""
        if order == 2:  # every word stands before another, the end before a text's first
            of = np.empty_like(self.words)
            of[1:] = self.words[:-1]
            of[self.starts] = np.searchsorted(self.vocabulary, np.uint64(END))
            return self.vocabulary, of
        return np.unique(self.before(order), return_inverse=True)


def _edges(parts: int) -> list[int]:
    """Least hash of each partition but the first, and a last one that no hash reaches."""
    return [-(-(i << 64) // parts) for i in range(1, parts + 1)]


def _cuts(keys: np.ndarray, parts: int) -> list[int]:
    return [0, *np.searchsorted(keys, np.array(_edges(parts)[:-1], np.uint64)).tolist(), len(keys)]


_ASKED = "order int, part int, block long, keys binary, counts binary"


def _ask(parts: int, first: int, last: int, most: int):
    """What blocks ask of the partitions from first to before last."""
    low = 0 if first == 0 else _edges(parts)[first - 1]
    high = min(_edges(parts)[last - 1], (1 << 64) - 1) if last < parts else (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                for order in range(1, most + 1):
                    hashes = b.grams(order)
                    own = (hashes >= np.uint64(low)) & ((hashes <= np.uint64(high)) if last == parts else (hashes < np.uint64(high)))
                    keys, of = np.unique(hashes[own], return_inverse=True)
                    counts = np.bincount(of[b.trained[own]], minlength=len(keys)).astype(np.uint32)
                    cuts = _cuts(keys, parts)
                    some = [(order, p, b.id, pack(keys[x:y]), pack(counts[x:y])) for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["order", "part", "block", "keys", "counts"])

    return run


#: kind: count (totals of n-grams; owner: bits) or history (totals: T(h); weights: a(h)). A row without a block is a part of the model.
_ANSWERED = "order int, kind string, part int, block long, keys binary, totals binary, owner binary, weights binary, stats array<long>"
_KINDS = (pa.int32(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()))


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split(" ")[0] for x in _ANSWERED.split(", ")])


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of all rows, each row's entries among them, and where the rows begin."""
    each = [unpack(r["keys"], "<u8") for r in rows]
    keys, of = np.unique(np.concatenate(each), return_inverse=True)
    return keys, of, np.cumsum([0, *map(len, each)]).tolist()


def _answer(table: pa.Table) -> pa.Table:
    """Totals for each block that asked (a row each), and the partition's part of the model (block null)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys, of, at = _merged(rows)
    counts = np.concatenate([unpack(r["counts"], "<u4") for r in rows])
    totals = np.bincount(of, counts, len(keys)).astype(np.uint64)
    own = np.zeros(len(of), np.uint8)
    seen = np.flatnonzero(counts)
    own[seen[np.unique(of[seen], return_index=True)[1]]] = 1
    some = totals > 0
    stats = [int(totals.sum()), int(some.sum()), *np.bincount(np.minimum(totals, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].tolist()]
    order, part = rows[0]["order"], rows[0]["part"]
    out = [(order, "count", part, r["block"], None, pack(totals[of[x:y]].astype(np.uint64)), pack(np.packbits(own[x:y])), None, None) for r, x, y in zip(rows, at, at[1:], strict=False)]
    out.append((order, "count", part, None, pack(keys[some]), pack(totals[some]), None, None, stats))
    return _answers(out)


# ---- probabilities


def discounts(n: list[int]) -> np.ndarray:
    """d(0), ..., d(K + 1) from the numbers n of keys that occur 1, ..., K + 1 times; counts above K take the last, one."""
    d = np.ones(K + 2)
    rest = (K + 1) * n[K] / n[0] if n[0] else 0.0
    for c in range(1, K + 1):
        value = ((c + 1) * n[c] / (c * n[c - 1]) - rest) / (1 - rest) if n[c - 1] and rest != 1 else 0.0
        d[c] = value if 0 < value < 1 else 1 - 0.5 / c
    return d


class Probabilities:
    """What the counts of counts settle. stats: of each order, N, V and the numbers of n-grams that occur 1, ..., K + 1 times."""

    def __init__(self, stats: list[list[int]]) -> None:
        words = stats[0]
        self.tokens, self.types = words[0], words[1]
        self.discounts = [discounts(x[2:]) for x in stats]
        lost = sum(c * n * (1 - self.discounts[0][c]) for c, n in enumerate(words[2 : 2 + K], 1))
        self.total = self.tokens + (lost == 0)  # nothing discounted: one count for the unknown word
        self.unknown = (lost if lost else 1.0) / self.total

    def word(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(1, counts) / max(self.total, 1), self.unknown)

    def kept(self, order: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.discounts[order - 1][np.minimum(counts, K + 1).astype(np.int64)] * counts

    def tokens_of(self, b: Block, rows: list[dict], order: int) -> tuple[np.ndarray, np.ndarray]:
        """P of each token of a block by the n-grams up to an order, and its count as a word. rows: what the block was answered."""
        words = np.concatenate(_told(rows, "count", 1, "totals", "<u8"))[b.distinct(1)[2]]
        p = self.word(words)
        for n in range(2, order + 1):
            c = np.concatenate(_told(rows, "count", n, "totals", "<u8"))[b.distinct(n)[2]]
            of = b.histories(n)[1]
            total, weight = (np.concatenate(_told(rows, "history", n, x, k))[of] for x, k in (("totals", "<u8"), ("weights", "<f8")))
            p = np.where(c > 0, self.kept(n, c) / np.maximum(total, 1), weight * p)
        return p, words


def _told(rows: list[dict], kind: str, order: int, column: str, dtype: str) -> list[np.ndarray]:
    """A column of the answers to a block, in the order asked."""
    return [unpack(r[column], dtype) for r in sorted((r for r in rows if r["order"] == order and r["kind"] == kind), key=lambda r: r["part"])]


_SUMMED = "part int, block long, keys binary, counts binary, kept binary, mass binary, some binary"


def _histories(known: Probabilities, parts: int, order: int):
    """Of the n-grams that a block accounts for: sums over each history."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, rows = Block(left.to_pylist()[0]), right.to_pylist()
        totals = _told(rows, "count", order, "totals", "<u8")
        own = np.concatenate([np.unpackbits(bits)[: len(t)] for bits, t in zip(_told(rows, "count", order, "owner", "u1"), totals, strict=True)]).astype(bool)
        first, counts = b.distinct(order)[1][own], np.concatenate(totals)[own]
        keys, of = b.histories(order)
        at, n = of[first], len(keys)
        below = known.tokens_of(b, rows, order - 1)[0][first]
        sums = [np.bincount(at, counts, n).astype(np.uint64), np.bincount(at, known.kept(order, counts), n), np.bincount(at, below, n), np.bincount(at, counts <= K, n).astype(np.uint32)]
        cuts = _cuts(keys, parts)
        out = [(p, b.id, pack(keys[x:y]), *(pack(c[x:y]) for c in sums)) for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], [x.split(" ")[0] for x in _SUMMED.split(", ")])

    return run


def weights(counts: np.ndarray, kept: np.ndarray, mass: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """T(h) and a(h). Histories that nothing follows have a(h) = 1."""
    total = np.maximum(counts + (some == 0), 1).astype(np.uint64)
    return total, np.where(counts > 0, (1 - kept / total) / (1 - mass), 1.0)


def _weigh(order: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys, of, at = _merged(rows)
        counts, kept, mass, some = (np.bincount(of, np.concatenate([unpack(r[c], k) for r in rows]), len(keys)) for c, k in (("counts", "<u8"), ("kept", "<f8"), ("mass", "<f8"), ("some", "<u4")))
        total, weight = weights(counts, kept, mass, some)
        part, seen = rows[0]["part"], counts > 0
        out = [(order, "history", part, r["block"], None, pack(total[of[x:y]]), None, pack(weight[of[x:y]]), None) for r, x, y in zip(rows, at, at[1:], strict=False)]
        out.append((order, "history", part, None, pack(keys[seen]), pack(total[seen]), None, pack(weight[seen]), None))
        return _answers(out)

    return run


def _score(known: Probabilities, order: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, rows = Block(left.to_pylist()[0]), right.to_pylist()
        p, words = known.tokens_of(b, rows, order)
        base = np.log10((words + 0.1) / (known.tokens + 0.1 * (known.types + 1)))
        add = lambda x: np.add.reduceat(x, b.starts)
        n = len(b.ids)
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.held), "n_tokens": pa.array(b.lengths), "n_known": pa.array(add((words > 0).astype(np.int64))), "train_tokens": pa.array([known.tokens] * n, pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p)))})

    return run


def _dealt(rows: DataFrame, groups: int, *keys: str) -> DataFrame:
    """rows by keys, over as many partitions as there are groups if that is more than Spark is set to: what a task reads doesn't grow with the corpus."""
    return rows.repartition(groups, *keys) if groups > shuffle_partitions(rows.sparkSession) else rows


def model_and_scores(docs: DataFrame, order: int = ORDER, block: int = BLOCK, tokens_a_part: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """The model's tables and the scores of docs (doc_id, text; held_out: boolean, or null for the rule by crc32 of the id).

    Model: order, kind (count: totals of n-grams; history: T and a of the histories of n-grams of the order), part, keys, totals and
    weights, packed; see pack(). It can be written partitioned by order and kind.
    """
    out = F.col("held_out").cast("boolean") if "held_out" in docs.columns else F.lit(None).cast("boolean")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text_of().cast("binary").alias("text"))
    made = rows.mapInArrow(_blocks(block), "block long, ids array<long>, held binary, lengths binary, tokens binary, vocabulary binary, n long")
    wave = lambda c: F.pmod(F.col(c), F.lit(WAVES)).cast("int")
    blocks = staged(made.withColumn("wave", wave("block")), "blocks", ("wave",))
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    parts, turn = max(WAVES, -(-size["n"] // tokens_a_part)), -(-size["blocks"] // WAVES)
    blocks = blocks.drop("n")
    own = [_dealt(blocks.where(F.col("wave") == w).drop("wave"), turn, "block") for w in range(WAVES)]
    union = lambda frames: reduce(DataFrame.union, frames)

    answered = []
    for w in range(WAVES):
        asked = blocks.drop("wave").mapInArrow(_ask(parts, parts * w // WAVES, parts * (w + 1) // WAVES, order), _ASKED)
        answered.append(staged(_dealt(asked, -(-order * parts // WAVES), "order", "part").groupBy("order", "part").applyInArrow(_answer, _ANSWERED), "answers"))
    answers = union(answered)
    stats = answers.where("block is null").select("order", F.posexplode("stats")).groupBy("order", "pos").agg(F.sum("col").alias("n")).collect()  # 8 rows an order
    known = Probabilities([[next((r["n"] for r in stats if r["order"] == n and r["pos"] == i), 0) for i in range(K + 3)] for n in range(1, order + 1)])

    told = lambda w: _dealt(answers.where("block is not null").where(wave("block") == w), turn, "block").groupBy("block")
    for n in range(2, order + 1):
        sums = [staged(own[w].groupBy("block").cogroup(told(w)).applyInArrow(_histories(known, parts, n), _SUMMED), "sums") for w in range(WAVES)]
        answers = answers.union(staged(_dealt(union(sums), parts, "part").groupBy("part").applyInArrow(_weigh(n), _ANSWERED), "weights"))
        discard(*sums)

    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = [staged(own[w].groupBy("block").cogroup(told(w)).applyInArrow(_score(known, order), scored), "scores") for w in range(WAVES)]
    discard(blocks)
    return answers.where("block is null").select("order", "kind", "part", "keys", "totals", "weights"), union(scores)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_and_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))[1]


#: DuckDB has no crc32; tests hold the query against a brute-force model.
ORACLE_SQL = None
