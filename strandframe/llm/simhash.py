"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the product of two binary Golay codes of length 23 on the fingerprint's low 46
bits. The Golay code is perfect with covering radius 3, so each half of a fingerprint has one codeword within 3 bits; the
pair is the fingerprint's home. Two fingerprints at most THRESHOLD bits apart differ in d0 and d1 bits of the halves, with
d0 + d1 <= THRESHOLD; so each is within 3 + d0 and 3 + d1 bits of the other's home. Every distinct fingerprint is therefore
sent to all anchors within 3 + d0 and 3 + d1 for those d0 and d1 (about 60 of 16 million), and is compared there with the
fingerprints at home. No link is lost, and no pair is looked at but those that share an anchor.

Only distinct fingerprints take part, so copies cost nothing; documents meet their fingerprint's component again at the end.

Defined cases: a null or empty text, or one of white space, has fingerprint zero; texts of one or two words are one shingle;
a null id takes part but names a component only if it has no other id (then its component_id is null); repeated rows each get a row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import read, staged, text_of
from strandframe.llm.components import connected
from strandframe.llm.near import first_documents  # noqa: F401  the pipeline's stage, by its own contract

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: The binary Golay code: length, generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, covering radius.
LENGTH, GENERATOR, RADIUS = 23, 0b110001110101, 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return of(whole, SEED)
    starts = [0, *(e + 1 for e in ends)]
    counts, many = np.zeros(64, np.int64), len(words) - shingle + 1
    for i in range(0, many, 1 << 15):
        h = np.array([of(whole[a:b], SEED) for a, b in zip(starts[i : min(i + (1 << 15), many)], ends[i + shingle - 1 :], strict=False)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > many, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), shingle) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _syndrome(x: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << bit - 11
    return x


def cover(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits; for each syndrome the error patterns of up to RADIUS + threshold bits (-1: none), and how many bits over RADIUS each has."""
    bits = np.array([_syndrome(1 << i) for i in range(LENGTH)], np.int64)
    by: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + threshold + 1):
        for at in combinations(range(LENGTH), weight):
            syndrome = 0
            for i in at:
                syndrome ^= int(bits[i])
            by[syndrome].append((max(0, weight - RADIUS), sum(1 << i for i in at)))
    most = max(map(len, by))
    patterns, over = np.full((1 << 11, most), -1, np.int64), np.full((1 << 11, most), threshold + 1, np.int64)
    for s, found in enumerate(by):
        for k, (excess, pattern) in enumerate(sorted(found)):
            patterns[s, k], over[s, k] = pattern, excess
    return bits, patterns, over


def _anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, patterns, over = cover(threshold)
        mask = (1 << LENGTH) - 1

        def syndromes(x: np.ndarray) -> np.ndarray:
            out = np.zeros_like(x)
            for i in range(LENGTH):
                out ^= (x >> i & 1) * bits[i]
            return out

        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 1024):
                fp = fps[i : i + 1024]
                low, high = fp & mask, fp >> LENGTH & mask
                s0, s1 = syndromes(low), syndromes(high)
                fits = over[s0][:, :, None] + over[s1][:, None, :] <= threshold
                row, p0, p1 = np.nonzero(fits)
                anchor = (high[row] ^ patterns[s1[row], p1]) << LENGTH | (low[row] ^ patterns[s0[row], p0])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array((p0 == 0) & (p1 == 0))], ["anchor", "fp", "home"])

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs a < b of the fingerprints (fp) at most threshold bits apart.

    Spark takes what mapInArrow returns for as many rows as it got, so a table of anchors looks 60 times smaller than it is: the join
    is by exchanges, whatever its size, and nothing goes through the driver.
    """
    placed = distinct.select("fp").mapInArrow(_anchors(threshold), "anchor long, fp long, home boolean")
    home = placed.where("home").select("anchor", F.col("fp").alias("x")).alias("h")
    met = home.hint("merge").join(placed.select("anchor", F.col("fp").alias("y")).alias("p"), (F.col("h.anchor") == F.col("p.anchor")) & (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    rows = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected(links(distinct, threshold))
    rooted = distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # a table of its own, so that Spark can split the join for a large component
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = rooted.join(least.hint("merge"), "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(named.hint("merge"), F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: DuckDB has no seeded XXH64.
ORACLE_SQL = None
