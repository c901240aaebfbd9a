"""Substring dedup by seed and extend.

Seeds: hashes of K words, winnowed: of the SPAN - K + 1 that lie in a window of SPAN words, the least (the leftmost of equal
ones) is the window's anchor, so that equal windows have equal anchors. A document is a row of runs: neighbouring windows with the
same anchor. Documents are joined on anchors that occur more than once; runs with the same anchor are then extended both ways:

1. Runs with the same words all through (all windows of the run agree, to the left and to the right) form a class. All but the
   class's smallest doc_id lose the whole run.
2. If an anchor has several classes, the smallest documents of each are extended window by window: a window goes if a
   smaller document among them has it. Other members needn't be looked at: step 1 settled theirs.

So copies cost one row a run however many there are, no pairs are made, and the result is that of comparing all windows
with all others. Neighbouring windows that go are joined to maximal repeats. Runs and windows are compared by two hashes
of 64 bits each (of the anchor and of the words).

Defined cases: a null or empty text has no words; a null id stands last, where 2^63 - 1 is; rows with one id are one document's
(with the same text they get the same row each; with other texts, told apart by 64 bits of hash, each is judged by itself, and never against its namesakes);
texts shorter than SPAN words lose nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import discard, read, staged, text_of

SPAN, K = 50, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = (1 << 63) - 1
#: place: the run's first window, its number of windows (6 bits), the anchor's distance from the first window (6 bits)


class Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.of = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.of[0]) < n:
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(2 * n, base, np.uint64)
                steps[0] = 1
                self.of[i] = np.cumprod(steps, dtype=np.uint64)
        return self.of


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sums:
    """Hashes of any stretch of words, from prefix sums modulo 2^64."""

    def __init__(self, words: list[bytes], powers: Powers) -> None:
        of = xxhash.xxh64_intdigest
        hashes = np.array([of(w) for w in words], np.uint64)
        self.up, self.down = powers.upto(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(words)], out=self.sums[1:])

    def stretch(self, start: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


def runs(sums: Sums, n: int, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """first window, windows, distance of the anchor, anchor hash and hash of all words, of each run."""
    grams = sums.stretch(np.arange(n - k + 1), k)
    wide, at, reach = span - k + 1, np.arange(n - k + 1), 1
    while reach < wide:  # at[i]: place of the least among reach grams from i on
        step = min(reach, wide - reach)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        reach += step
    first = np.flatnonzero(np.diff(at, prepend=-1))
    many = np.diff(first, append=len(at))
    anchor = at[first]
    whole = sums.stretch(first, many + span - 1) + _mixed(((anchor - first) * 64 + many).astype(np.uint64))
    return first, many, anchor - first, grams[anchor], whole


def _seeds(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        names = ["doc_id", "tag", "named", "place", "anchor", "whole", "n_words", "sha"]
        for b in batches:
            ids, tags, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("tag").to_numpy(zero_copy_only=False), b.column("text")
            found, counts, digests = [], [], []
            for i in range(b.num_rows):
                words = texts[i].as_py().split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                if len(words) >= span:
                    first, many, off, anchor, whole = runs(Sums(words, powers), len(words), span, k)
                    found.append((np.full(len(first), ids[i]), np.full(len(first), tags[i]), (first << 6 | many) << 6 | off, anchor.view(np.int64), whole.view(np.int64)))
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), b.column("named"), none, none, none, pa.array(counts, pa.int64()), pa.array(digests, pa.binary())], names)
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                m = len(columns[0])
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.nulls(m, pa.bool_()), *columns[2:], pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)

    return run


def _windows(span: int):
    """Each window of the runs that are marked as open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            ids, tags, texts, marked = (b.column(c) for c in ("doc_id", "tag", "text", "runs"))
            found = []
            for i in range(b.num_rows):
                opened = [(x["place"], x["anchor"]) for x in marked[i].as_py() if x["open"]]
                if opened:
                    sums = Sums(texts[i].as_py().split(), powers)
                    first, many = np.array([p >> 12 for p, _ in opened]), np.array([p >> 6 & 63 for p, _ in opened])
                    start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    found.append((np.full(len(start), ids[i].as_py()), np.full(len(start), tags[i].as_py()), start, np.repeat(np.array([a for _, a in opened]), many), sums.stretch(start, span).view(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["doc_id", "tag", "start", "anchor", "window"])

    return run


def _removed(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts, marked, single = (b.column(c) for c in ("text", "runs", "starts"))
            rows = []
            for i in range(b.num_rows):
                words = texts[i].as_py().split()
                edges = np.zeros(len(words) + 1, np.int32)
                for x in marked[i].as_py():
                    if not x["open"]:
                        p = x["place"]
                        edges[p >> 12] += 1
                        edges[(p >> 12) + (p >> 6 & 63) + span - 1] -= 1
                for s in single[i].as_py() or ():
                    edges[s] += 1
                    edges[s + span] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((int(gone.sum()), hashlib.sha256(kept).digest(), [{"start": a, "end": e} for a, e in turns]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], kind)], ["doc_id", "tag", "n_removed", "sha", "spans"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the last number), tag (64 bits of hash of the text), named (whether there is an id) and text. The first two tell documents apart."""
    text, own = text_of().cast("binary"), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("tag"), own.isNotNull().alias("named"), text.alias("text"))


def removals(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Per document: doc_id, tag (of its text), n_words, n_removed, sha (of the words kept) and spans (start and end, in words, of what goes)."""
    if not 0 < k <= span <= k + 62:
        raise ValueError("a window has from 1 to 63 seeds")
    rows = staged(_keyed(docs).mapInArrow(_seeds(span, k), "doc_id long, tag long, named boolean, place long, anchor long, whole long, n_words long, sha binary"), "seeds")
    seeds = rows.where("anchor is not null").select("doc_id", "tag", "place", "anchor", "whole")
    common = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    # the side that is grouped is a table of its own in each join by anchor or window, so that Spark can split hot ones
    common = staged(common, "common")
    shared = staged(seeds.join(common, "anchor", "left_semi"), "shared")
    classes = staged(shared.groupBy("anchor", "whole").agg(F.min("doc_id").alias("first")), "classes")
    several = staged(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(True).alias("several")), "several")
    known = classes.join(several, "anchor", "left").select(F.col("anchor").alias("a"), F.col("whole").alias("w"), "first", "several")
    met = shared.join(known, (F.col("anchor") == F.col("a")) & (F.col("whole") == F.col("w"))).where("doc_id > first or several")
    marked = met.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("place", "anchor", (F.col("doc_id") == F.col("first")).alias("open"))).alias("runs"))
    texts = staged(_keyed(docs).join(marked, ["doc_id", "tag"]), "repeats")
    discard(shared, classes, common, several)
    windows = staged(texts.mapInArrow(_windows(span), "doc_id long, tag long, start long, anchor long, window long"), "windows")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("anchor").alias("a"), F.col("window").alias("w"), "first")
    least = staged(least, "least")
    gone = windows.join(least, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w"))).where("doc_id > first")
    starts = staged(gone.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts")), "starts")
    discard(windows, least)
    changed = texts.join(starts, ["doc_id", "tag"], "left").mapInArrow(_removed(span), "doc_id long, tag long, n_removed long, sha binary, spans array<struct<start: long, end: long>>")
    changed = staged(changed.dropDuplicates(["doc_id", "tag"]), "changed").select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "n_removed", F.col("sha").alias("kept"), "spans")
    discard(texts)
    whole = rows.where("anchor is null").select("doc_id", "tag", "named", "n_words", "sha")
    out = whole.join(changed, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left")
    return out.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "tag", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("sha"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.lower(F.hex("sha")).alias("kept_sha256"))


#: Windows of 50 words in SQL take memory and time beyond use on whole tables; tests hold the query against brute force.
ORACLE_SQL = None
