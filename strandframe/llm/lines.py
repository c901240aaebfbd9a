"""Line dedup by a deletion-neighbourhood join.

A line's key is its words, A-Z in lower case. Lines of LEAST_WORDS words or more take part; a line goes if an equal line, or
one at an edit distance of at most one word (a word put in, left out or replaced), occurs earlier, in order of doc_id
and line number. Lines are judged on the input, not on what is left. (One edit in five words or more is a similarity of at least 0.8.)

1. Equal lines become one distinct line, with its first occurrence.
2. Of two lines one edit apart, the edit is in one half, so the other half is equal: distinct lines that share neither half
   with another are done. For the rest the halves that are shared tell where an edit may be.
3. Each remaining line emits the hashes of itself and of its words without one, for those places. Lines with a variant in
   common, both without the same place (replaced) or one of them whole (put in or left out), are at most one edit apart;
   the earliest of each group is found by aggregation, so that no pairs of a group are made.
4. A line and its earliest neighbour are then compared word by word; only verified lines go.

Defined cases: a null or empty text has no lines; a null id stands last, where 2^63 - 1 is; rows with one id are one document's (equal rows get equal results;
with different texts, told apart by 64 bits of hash, they are taken in the order of that hash); shorter lines, also empty ones, always stay; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import discard, quoted, read, staged, text_of
from strandframe.llm.substrings import _LAST, Powers, Sums, _keyed, _mixed

LEAST_WORDS = 5
#: sides of a line that another line shares
PREFIX, SUFFIX = 1, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_words(line: bytes) -> list[bytes]:
    return line.lower().split()


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and of the last m words, for each m that is half of this line's or of a one word shorter line's words, less the side in the lowest bit."""
    out = []
    for m in {len(words) // 2, (len(words) - 1) // 2}:
        for side, part in ((0, words[:m]), (1, words[len(words) - m :])):
            out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(part), m) & ~1 | side))
    return out


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tag", "named", "line", "a", "b", "halves", "n_lines", "sha"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in batches:
            ids, tags, named, texts, rows = *(batch.column(c).to_pylist() for c in ("doc_id", "tag", "named")), batch.column("text"), []
            for doc, tag, has_id, text in zip(ids, tags, named, texts, strict=True):
                raw = text.as_py()
                lines = raw.split(b"\n") if raw else []
                rows.append((doc, tag, has_id, None, None, None, None, len(lines), hashlib.sha256(raw).digest()))
                for at, line in enumerate(lines):
                    words = line_words(line)
                    if len(words) >= least:
                        key = xxhash.xxh3_128_intdigest(b" ".join(words))
                        rows.append((doc, tag, None, at, _signed(key >> 64), _signed(key & (1 << 64) - 1), halves(words), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def variants(words: list[bytes], sides: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes: of the line (place -1) and of its words without the one at a place."""
    n = len(words)
    sums = Sums(words, powers)
    low = n // 2 - 2 if not sides & SUFFIX else 0  # only the first half is shared: the edit is behind it
    high = (n + 1) // 2 + 2 if not sides & PREFIX else n
    at = np.arange(max(low, 0), min(high, n))
    s, up, down = sums.sums, sums.up, sums.down
    # the words behind a place move one to the left
    left = s[at] + (s[n] - s[at + 1]) * down[1]
    return np.append(at, -1), np.append(_mixed(left + up[1:2] * np.uint64(n - 1)), _mixed(s[n : n + 1] + up[1:2] * np.uint64(n)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the lines in marks."""
    for b in batches:
        rows = []
        for doc, tag, text, marked in zip(b.column("doc_id"), b.column("tag"), b.column("text"), b.column("marks"), strict=True):
            lines, doc, tag = text.as_py().split(b"\n"), doc.as_py(), tag.as_py()
            rows += [(doc, tag, x["line"], x["sides"], b" ".join(line_words(lines[x["line"]]))) for x in marked.as_py()]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "tag", "line", "sides", "words"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in batches:
        found = []
        for doc, tag, line, sides, words in zip(*(b.column(c) for c in ("doc_id", "tag", "line", "sides", "words")), strict=True):
            at, hashes = variants(words.as_py().split(), sides.as_py(), powers)
            found.append((hashes.view(np.int64), at.astype(np.int32), np.full(len(at), doc.as_py()), np.full(len(at), tag.as_py()), np.full(len(at), line.as_py(), np.int32)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["variant", "at", "doc_id", "tag", "line"])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the lists are at an edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.select(["doc_id", "tag", "line"]).filter(pa.array([within_one(x.as_py().split(), y.as_py().split()) for x, y in zip(b.column("words"), b.column("other"), strict=True)], pa.bool_()))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, equal, near in zip(b.column("text"), b.column("equal"), b.column("near"), strict=True):
            equal, near = set(equal.as_py() or ()), set(near.as_py() or ())
            gone = equal | near
            kept = b"\n".join(x for i, x in enumerate(text.as_py().split(b"\n")) if i not in gone)
            rows.append((len(equal), len(gone) - len(equal), hashlib.sha256(kept).digest(), sorted(gone), bytes(i in gone for i in range(max(gone) + 1))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.binary())], ["doc_id", "tag", "n_equal", "n_near", "sha", "gone", "mask"])


def _neighbours(cells: DataFrame) -> DataFrame:
    """Of rows (variant, at, doc_id, tag, line): each line with its earliest neighbour, if that is earlier than the line."""
    place = F.struct("doc_id", "tag", "line")
    groups = cells.groupBy("variant", "at").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    both = groups.groupBy("variant").agg(F.min(F.when(F.col("at") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("least"))).alias("cut")).select(F.col("variant").alias("v"), "whole", "cut")
    other = F.when(F.col("at") < 0, F.col("cut")).otherwise(F.least("least", F.coalesce("whole", "least")))
    useful = staged(groups.join(both, F.col("variant") == F.col("v")).select(F.col("variant").alias("v"), F.col("at").alias("p"), "most", other.alias("other")).where("other < most").drop("most"), "useful")
    met = cells.join(useful, (F.col("variant") == F.col("v")) & (F.col("at") == F.col("p"))).where(F.col("other") < place)
    return met.groupBy("doc_id", "tag", "line").agg(F.min("other").alias("other"))


def removals(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document: doc_id, tag (of its text), n_lines, n_equal and n_near (lines that go), sha (of the text kept), gone (their numbers) and mask (a byte a line up to the last of them, 1 if it goes)."""
    rows = staged(_keyed(docs).mapInArrow(_lines(least_words), "doc_id long, tag long, named boolean, line int, a long, b long, halves array<long>, n_lines long, sha binary"), "lines")
    lines = rows.where("line is not null")
    place = F.struct("doc_id", "tag", "line")
    # halves: lines are told apart by one hash here; if two shared it, they would be looked at in vain
    parts = lines.select("a", F.explode(F.array_distinct("halves")).alias("half"))
    shared = staged(parts.groupBy("half").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low < high").select("half"), "shared")  # a table of its own, so that Spark can split the join's hot halves
    sides = staged(parts.join(shared, "half", "left_semi").groupBy("a").agg(F.bit_or(F.when(F.col("half") % 2 == 0, PREFIX).otherwise(SUFFIX)).alias("sides")), "sides")
    discard(shared)
    # the first occurrence of each distinct line; all others go
    first = staged(lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "first")
    several = first.where("n > 1").select(F.col("a").alias("x"), F.col("b").alias("y"), "first")
    again = lines.join(several, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).where(place != F.col("first"))
    equal = staged(again.groupBy("doc_id", "tag").agg(F.collect_set("line").alias("equal")), "equal")
    candidates = first.join(sides, "a").select("first.doc_id", "first.tag", F.struct("first.line", "sides").alias("mark"))
    marks = candidates.groupBy("doc_id", "tag").agg(F.collect_set("mark").alias("marks"))
    texts = staged(_keyed(docs).join(marks.hint("merge"), ["doc_id", "tag"]).mapInArrow(_candidates, "doc_id long, tag long, line int, sides int, words binary").dropDuplicates(["doc_id", "tag", "line"]), "candidates")
    discard(first, sides)
    cells = staged(texts.mapInArrow(_variants, "variant long, at int, doc_id long, tag long, line int"), "variants")
    pairs = staged(_neighbours(cells), "neighbours")
    discard(cells)
    one, two = texts.select(place.alias("p"), "words"), texts.select(place.alias("o"), F.col("words").alias("other_words"))
    met = pairs.select(place.alias("place"), "other").join(one, F.col("place") == F.col("p")).join(two, F.col("other") == F.col("o"))
    near = met.select("place.*", "words", F.col("other_words").alias("other")).mapInArrow(_verified, "doc_id long, tag long, line int")
    near = near.groupBy("doc_id", "tag").agg(F.collect_set("line").alias("near"))
    gone = staged(equal.join(near, ["doc_id", "tag"], "full"), "gone")
    discard(texts)
    # joins with whole texts are merge joins at every size: what is joined grows with the corpus
    changed = _keyed(docs).join(gone.hint("merge"), ["doc_id", "tag"]).mapInArrow(_cleaned, "doc_id long, tag long, n_equal long, n_near long, sha binary, gone array<int>, mask binary")
    changed = staged(changed.dropDuplicates(["doc_id", "tag"]), "changed")
    changed = changed.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "n_equal", "n_near", F.col("sha").alias("kept"), "gone", "mask")
    out = rows.where("line is null").select("doc_id", "tag", "named", "n_lines", "sha").join(changed, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "tag", "n_lines", zero("n_equal"), zero("n_near"), F.coalesce("kept", "sha").alias("sha"), "gone", "mask")


def cleaned_documents(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without the lines that go, with all their columns. Documents of which nothing is left stay, with an empty text; a null text stays null."""
    found = removals(docs, least_words).where("gone is not null")
    gone = staged(found.groupBy("doc_id", "tag").agg(F.first("mask").alias("mask")).select(F.col("doc_id").alias("strandframe_id"), F.col("tag").alias("strandframe_tag"), F.col("mask").alias("strandframe_mask")), "gone")
    tag = F.xxhash64(text_of().cast("binary"))
    met = docs.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("strandframe_id")) & (tag == F.col("strandframe_tag")), "left")
    mask = F.col("strandframe_mask")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: F.substring(mask, i + 1, F.lit(1)) != F.lit(b"\x01")), "\n")
    return met.withColumn("text", F.when(mask.isNull(), F.col("text")).otherwise(kept)).select(*quoted(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.col("n_equal").alias("n_removed_equal"), F.col("n_near").alias("n_removed_near"), F.lower(F.hex("sha")).alias("kept_sha256"))


#: SQL can't compare all lines by edit distance on whole tables; tests hold the query against brute force.
ORACLE_SQL = None
