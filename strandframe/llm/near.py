"""SimHash near-dedup at a similarity of shingle sets: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The anchors are simhash.py's: words of products of Golay codes over fingerprint bits. Texts this similar differ in 15 % of the bits,
more than one product can bear by distance alone. So a fingerprint here has TABLES products of WORDS codes each, on bits of their own, and
each goes to the REACH anchors that are nearest by the margins of its bits (how far the shingles' votes are from a tie), out of those
that simhash.cover reaches. By simulation, a pair at exactly 0.8 shares an anchor in a table with a chance of 0.18 to 0.19 (sets of 4 and 5
shingles: 0.15), so in none of them with 2e-7 to 5e-7 (7e-6); a more similar one with less. Tables are taken in ROUNDS, so that the disk
bears a round's anchors only, and anchors with one text leave. Fingerprints of BITS bits are compared at the anchors that are left.

An anchor's texts first meet its least node (its hub), so a large group of near copies costs a row a text, not a pair. Only at
anchors that the links found so far leave in several components do texts meet across the components, and there the join itself
compares fingerprints and then shingles: it gives links, not pairs. At last each link is verified on the texts' own shingles.

Defined cases: as in simhash; a text of at most five words is one shingle; texts without words are copies of each other;
different texts with one id, or with a null one, are documents of their own; of repeated rows one counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import discard, staged, text_of
from strandframe.llm.components import connected

SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
TABLES, WORDS, REACH, ROUNDS = 72, 3, 8, 6
#: Bits over the covering radius within which a code's words are looked for, and how many of them are kept.
FURTHER, NEAREST = 2, 4
#: Bits of a fingerprint; of texts with fewer than FEW distinct shingles it isn't looked at.
BITS, FEW = 512, 16
#: Texts of more distinct shingles than this are compared at an anchor by fingerprints alone.
CARRIED = 4096


def shingles(text: bytes, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The hash of the text's words, and the distinct hashes of its shingles."""
    words = text.lower().split()
    whole, of = b" ".join(words), xxhash.xxh64_intdigest
    node = of(whole, SEED)
    if len(words) <= shingle:
        return node, np.array([node] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    return node, np.unique(np.array([of(whole[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def _nodes(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [xxhash.xxh64_intdigest(b" ".join(x.as_py().lower().split()), SEED) for x in b.column("text")]
            names = ["text"] if with_text else ["doc_id", "h"]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), *map(b.column, names)], ["node", *names])

    return run


def votes(found: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """How many of the shingles' hashes have each bit; 64 bits for each factor in mix."""
    total = np.zeros(64 * len(mix), np.int64)
    for i in range(0, len(found), 255):
        h = found[i : i + 255, None] * mix
        h = (h ^ h >> np.uint64(32)) * mix
        total += np.unpackbits((h ^ h >> np.uint64(29)).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return total


def nearest(margins: np.ndarray, first: int, code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (texts x tables x REACH) of margins (texts x tables x WORDS x LENGTH), the first table's number being first; and which of them there are."""
    bits, patterns, flips = code
    m = margins.reshape(-1, len(bits))
    place = np.arange(len(bits))
    hard = ((m > 0) << place).sum(axis=1)
    syndrome = np.bitwise_xor.reduce(np.where(m > 0, bits, 0), axis=1)
    cost = np.matmul(flips[syndrome], np.abs(m)[:, :, None])[:, :, 0]
    cost[patterns[syndrome] < 0] = np.inf
    at = np.argsort(cost, axis=1, kind="stable")[:, :NEAREST]
    # a code word's upper 12 bits tell it from the others
    words = (hard[:, None] ^ np.take_along_axis(patterns[syndrome], at, 1)) >> 11
    words, cost = words.reshape(-1, WORDS, NEAREST), np.take_along_axis(cost, at, 1).reshape(-1, WORDS, NEAREST)
    keys, costs = words[:, 0], cost[:, 0]
    for k in range(1, WORDS):
        keys = (keys[:, :, None] << 12 | words[:, k, None, :]).reshape(len(words), -1)
        costs = (costs[:, :, None] + cost[:, k, None, :]).reshape(len(words), -1)
    at = np.argsort(costs, axis=1, kind="stable")[:, :REACH]
    shape = (len(margins), margins.shape[1], REACH)
    tables = first + np.arange(shape[1])[None, :, None]
    return tables << 12 * WORDS | np.take_along_axis(keys, at, 1).reshape(shape), np.isfinite(np.take_along_axis(costs, at, 1)).reshape(shape)


def covering() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits, error patterns by syndrome, and the bits of these."""
    from strandframe.llm.simhash import cover  # which imports this module

    bits, patterns, _ = cover(FURTHER)
    return bits, patterns, (patterns[:, :, None] >> np.arange(len(bits)) & 1).astype(np.float32)


def _anchors(shingle: int, turn: int):
    """node, n (its number of distinct shingles) and anchors in the tables of a round."""
    code = covering()
    many, length = TABLES // ROUNDS, len(code[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = many * WORDS * length
        mix = np.random.default_rng([SEED, turn]).integers(0, 1 << 64, -(-width // 64), np.uint64) | np.uint64(1)
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                sets = [shingles(x.as_py(), shingle)[1] for x in part.column("text")]
                margins = np.array([2 * votes(s, mix)[:width] - len(s) for s in sets], np.float32).reshape(-1, many, WORDS, length)
                found, there = nearest(margins, many * turn, code)
                there &= np.array([len(s) > 0 for s in sets])[:, None, None]
                ends = np.cumsum([0, *there.sum(axis=(1, 2))], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found[there]))], ["node", "n", "bands"])

    return run


def fingerprint(found: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The bits set in over half of the shingles' hashes, as longs; one for each factor in mix."""
    return np.packbits(2 * votes(found, mix) > len(found)).view(np.int64)


def _marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.random.default_rng(SEED).integers(0, 1 << 64, BITS // 64, np.uint64) | np.uint64(1)
        for b in batches:
            fps, sets = [], []
            for x in b.column("text"):
                found = shingles(x.as_py(), shingle)[1]
                fps.append(fingerprint(found, mix).tolist())
                sets.append(np.unique((found >> np.uint64(32)).astype(np.uint32).view(np.int32)).tolist() if len(found) <= CARRIED else None)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(fps, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))], ["node", "fp", "s"])

    return run


def _similar(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for b in batches:
            fits = []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("x"), b.column("y"), strict=True):
                if a != last:
                    last, mine = a, shingles(x.as_py(), shingle)[1]
                other = shingles(y.as_py(), shingle)[1]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                fits.append(both >= similarity * (len(mine) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; a's text is met last, so each pair carries b's alone through the shuffle."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    met = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    return staged(met.select("a", "b", "x", "y").mapInArrow(_similar(shingle, similarity), "a long, b long"), "links")


def apart(similarity: float) -> int:
    """Differing bits that no pair of this similarity is expected to exceed: the mean and five standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))


def _sized(similarity: float):
    return F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - F.lit(1e-9)


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h (a hash of the text as it stands) and root, which is equal for the rows of a component."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().cast("binary").alias("text"))
    rows = staged(hashed.mapInArrow(_nodes(False), "node long, doc_id long, h long"), "nodes")
    texts = staged(hashed.mapInArrow(_nodes(True), "node long, text binary").groupBy("node").agg(F.first("text").alias("text")), "texts")
    turns = []
    for turn in range(ROUNDS):
        sent = staged(texts.mapInArrow(_anchors(shingle, turn), "node long, n long, bands array<long>"), "anchors")
        placed = sent.select("node", "n", F.explode("bands").alias("band"))
        hubs = staged(placed.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).where("hub.node < last").selectExpr("band", "hub.node as a", "hub.n as m"), "hubs")
        turns.append(staged(placed.join(hubs, "band"), "crowd"))
        discard(sent, hubs)
    crowd = reduce(DataFrame.union, turns)

    pairs = staged(crowd.where((F.col("a") != F.col("node")) & _sized(similarity)).select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = _links(pairs, texts, shingle, similarity)
    roots = connected(links)
    rooted = crowd.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "rooted")
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = staged(rooted.join(mixed, "band"), "left")
    among = staged(left.select("node").distinct(), "among")
    marks = staged(texts.join(among, "node").mapInArrow(_marks(shingle), "node long, fp array<long>, s array<int>"), "marks")
    fps = [F.col("fp")[i].alias(f"f{i}") for i in range(BITS // 64)]
    left = left.join(marks.select("node", *fps, "s").hint("merge"), "node")
    other = left.select("band", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("s").alias("t"), *(F.col(f"f{i}").alias(f"g{i}") for i in range(BITS // 64)))
    bits = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"g{i}"))) for i in range(1, BITS // 64)), F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))))
    # shingles are carried as 32 bits, so the bound is a little wider here
    share = F.size(F.array_intersect("s", "t")) >= F.lit((similarity - 0.01) / (1 + similarity - 0.01)) * (F.col("n") + F.col("m"))
    near = (F.col("node") < F.col("b")) & (F.col("root") != F.col("other")) & _sized(similarity) & ((F.least("n", "m") < FEW) | (bits <= apart(similarity))) & (F.col("s").isNull() | F.col("t").isNull() | share)
    keyed = left.withColumnRenamed("band", "at")
    across = keyed.join(other.hint("merge"), (F.col("at") == F.col("band")) & near).select(F.col("node").alias("a"), "b").distinct()
    more = _links(staged(across.join(pairs, ["a", "b"], "left_anti"), "across"), texts, shingle, similarity)
    roots = connected(links.union(more))
    out = staged(rows.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("doc_id", "h", F.coalesce("root", "node").alias("root")), "classes")
    discard(rows, *turns, texts, pairs, links, rooted, among, marks, more)
    return out


def first_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component with all its columns: that of the smallest id (null last), then of the least hash of its text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("first")
    kept = classes(docs, shingle, similarity).groupBy("root").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_h"))
    h = F.xxhash64(text_of())
    met = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (h == F.col("kept_h")), "left_semi")
    once = met.withColumn("strandframe_row", F.row_number().over(W.partitionBy("doc_id", h).orderBy("doc_id")))  # repeated rows
    return once.where("strandframe_row = 1").drop("strandframe_row")
