"""The corpus pipeline: documents in, packed sequences out. Part of strandframe.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written to the shared
folder and read again as the next one's docs. All but the last return the columns of documents; packing returns a row a piece.

Defined cases, for every stage: nulls may stand in any column; a null or empty text is a text without words; null and repeated ids are
kept apart by their texts; further columns of any name come through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import lines, mixing, packing, quality, simhash
from strandframe.llm.common import read, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go; one without ten words always does. Of repeated rows all stay or all go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies and near copies of lines of five words or more go; n_chars follows the text. No document goes; one of which nothing is left has an empty text."""
    cleaned = lines.cleaned_documents(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash of five-word shingles, anchor points of products of Golay codes, verified
    similarity of 0.8 or more) stays: the one with the smallest id, a null id last, and of equal ids that with the least hash of its
    text. Texts without words are one group."""
    return simhash.first_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Empty texts are never taken; a null source is a source."""
    return mixing.mixed_documents(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 4096 tokens; a document taken twice is packed twice, under one id."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash", near_duplicates), ("source_mix", source_mix), ("packing", packing_plan)]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
