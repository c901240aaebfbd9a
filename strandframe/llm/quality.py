"""Quality rules: thresholds from mergeable quantile sketches per language and source.

Main path: DataFrame functions only. Each metric is a rate in integer arithmetic; its sketch is a histogram over
logarithmic bins (relative width GAMMA), so sketches merge by adding counts, and the result doesn't depend on how rows
were dealt. A group's fence is its median plus SPREAD times the distance from the median to the upper (or lower)
QUANTILE, or LEAST_SPREAD if that is more; a group with fewer than MIN_DOCS documents is merged into its language, and a language with fewer into all.

Defined cases: a null text is empty; null languages and sources are groups like any other; an empty text has no words
and fails the base rule; repeated rows each count and each get a row; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandframe.llm.common import WORD, let, quoted, read, staged, text_of, words_of

GAMMA = 1.05
MIN_DOCS = 100
QUANTILE = 90
SPREAD = 4
WINDOW = 5
#: metric: the sides on which it is fenced
METRICS = {"symbol_rate": "high", "dup_line_rate": "high", "repeat_rate": "high", "word_length": "both"}
#: What a metric may stray at least, in its unit: where nearly all documents of a group have the same rate, one more symbol or line is no fault.
LEAST_SPREAD = {"symbol_rate": 500, "dup_line_rate": 100, "repeat_rate": 50, "word_length": 75}


def _covered(pairs: Column) -> Column:
    """Words under windows whose hash occurs twice or more. pairs: (hash, position) in order."""

    def of_marked(s: Column) -> Column:
        last = F.size(s) - 1
        before = lambda e, k: F.when(k > 0, s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"]).otherwise(False)
        after = lambda e, k: F.when(k < last, s[F.least(k + 1, last)]["h"] == e["h"]).otherwise(False)
        return F.sort_array(F.transform(F.filter(s, lambda e, k: before(e, k) | after(e, k)), lambda e: e["i"]))

    def words(p: Column) -> Column:
        near = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda a, k: a + F.least(F.lit(WINDOW), p[k] - p[k - 1]))
        return F.when(F.size(p) > 1, near).otherwise(F.lit(0))

    return let(pairs, lambda s: let(of_marked(s), words))


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, in one pass without a shuffle.

    The hash of five words is folded from hashes of two and four, so that each step looks at a word once. Steps are
    columns of their own: Spark computes each once a row.
    """
    text = text_of()
    rest = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0)))  # noqa: E731  without the first k
    first = lambda c, k: F.slice(c, 1, F.greatest(F.size(c) - k, F.lit(0)))  # noqa: E731  without the last k
    folded = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    rows = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("l"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("symbols"))
    rows = rows.withColumn("two", folded(first(F.col("w"), 1), rest(F.col("w"), 1)))
    rows = rows.withColumn("four", folded(first(F.col("two"), 2), rest(F.col("two"), 2)))
    rows = rows.withColumn("five", folded(first(F.col("four"), 1), rest(F.col("w"), 4)))
    pairs = F.sort_array(F.transform("five", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("five")) < F.size("five"), _covered(pairs)).otherwise(0)
    counts = {"n_words": F.size("w"), "word_chars": F.length(F.array_join("w", "")), "n_symbols": F.col("symbols"), "n_lines": F.size("l"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_repeat_words": repeats}
    return rows.select(*(F.col(f"k_{c}").alias(c) for c in keep), *(c.cast("long").alias(n) for n, c in counts.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates(rows: DataFrame) -> DataFrame:
    """Each metric as a whole number; by integer division, so that every engine computes the same."""
    per = lambda a, k, b: F.expr(f"({a} * {k}) div greatest({b}, 1L)")
    return rows.withColumns(
        {
            "symbol_rate": per("n_symbols", "10000L", "word_chars"),
            "dup_line_rate": per("n_dup_lines", "1000L", "n_lines"),
            "repeat_rate": per("n_repeat_words", "1000L", "n_words"),
            "word_length": per("word_chars", "100L", "n_words"),
        }
    )


def sketch(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Counts by group, metric and bin: bin k holds values v with GAMMA^(k-1) < v + 1 <= GAMMA^k. Add counts to merge."""
    bins = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.ceil(F.log(F.col(m) + 1.0) / F.log(F.lit(GAMMA))).alias("bin")) for m in METRICS)))
    return rows.select(*groups, bins.alias("b")).groupBy(*groups, "b.metric", "b.bin").agg(F.count(F.lit(1)).alias("n"))


def _fences(cells: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Fences of each group with at least MIN_DOCS documents (all: any number), one row a group."""
    whole = W.partitionBy(*groups, "metric")
    run = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    counted = cells.groupBy(*groups, "metric", "bin").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(run), "total": F.sum("n").over(whole)})
    quantiles = counted.groupBy(*groups, "metric").agg(F.max("total").alias("total"), at(100 - QUANTILE).alias("low"), at(50).alias("mid"), at(QUANTILE).alias("high"))
    value = lambda c: F.pow(F.lit(GAMMA), F.col(c)) - 1.0
    least = F.coalesce(*(F.when(F.col("metric") == m, F.lit(float(x))) for m, x in LEAST_SPREAD.items()))
    fence = quantiles.withColumns({"over": value("mid") + SPREAD * F.greatest(value("high") - value("mid"), least), "under": value("mid") - SPREAD * F.greatest(value("mid") - value("low"), least)})
    limits = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m, side in METRICS.items() for c in ("over", "under")[: 1 + (side == "both")]]
    out = fence.groupBy(*groups).agg(F.max("total").alias("total"), *limits)
    return out.where(F.col("total") >= MIN_DOCS) if groups else out


def thresholds(rows: DataFrame) -> DataFrame:
    """One row for each language and source in rows, with the fences that hold there. Its size is that of the sketches, not of the rows."""
    cells = staged(sketch(rows, ("lang", "source")), "sketch")
    limits = [f"{m}_{c}" for m, side in METRICS.items() for c in ("over", "under")[: 1 + (side == "both")]]
    pairs = cells.select("lang", "source").distinct().alias("p")
    own, lang, every = (_fences(cells, g).alias(a) for g, a in ((("lang", "source"), "o"), (("lang",), "l"), ((), "e")))
    joined = pairs.join(own, F.expr("p.lang <=> o.lang and p.source <=> o.source"), "left").join(lang, F.expr("p.lang <=> l.lang"), "left").join(every, F.lit(True), "left")
    return joined.select("p.lang", "p.source", *(F.coalesce(f"o.{c}", f"l.{c}", f"e.{c}").alias(c) for c in limits))


def judge(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with base_failed and kept."""
    inside = None
    for m, side in METRICS.items():
        ok = F.col(m) <= F.col(f"{m}_over")
        ok = ok & (F.col(m) >= F.col(f"{m}_under")) if side == "both" else ok
        inside = ok if inside is None else inside & ok
    joined = rows.alias("r").join(limits.alias("t"), F.expr("r.lang <=> t.lang and r.source <=> t.source"), "left")
    return joined.select("r.*", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = rates(staged(features(docs), "features"))
    # as a table the thresholds have a known size: a row a language and source is broadcast unless it is too large
    return judge(rows, staged(thresholds(rows), "thresholds")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns.

    They are staged with their features, so that a text is looked at once: a filter on a computed feature would be pushed
    below it and compute it again, several times.
    """
    columns = docs.columns
    rows = rates(staged(features(docs.select("lang", "source", "text", F.struct(*quoted(columns)).alias("whole")), ("whole", "lang", "source")), "features"))
    limits = staged(thresholds(rows), "thresholds")
    return judge(rows, limits).where("kept").select(*(F.col("whole").getField(c).alias(c) for c in columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


_WORDS = r"[x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> '']"


def _oracle() -> str:
    rate = {"symbol_rate": "n_symbols * 10000 // greatest(word_chars, 1)", "dup_line_rate": "n_dup_lines * 1000 // greatest(n_lines, 1)", "repeat_rate": "n_repeat_words * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 100 // greatest(n_words, 1)"}
    least = " ".join(f"when '{m}' then {x}" for m, x in LEAST_SPREAD.items())
    fences = lambda name, groups: f"""{name} as (
  select {groups}{"," if groups else ""} metric, total, {GAMMA} ** mid - 1 as m, {GAMMA} ** high - 1 as h, {GAMMA} ** low - 1 as lo, case metric {least} end as least from (
    select {groups}{"," if groups else ""} metric, max(total) as total, min(bin) filter (upto * 100 >= total * {100 - QUANTILE}) as low, min(bin) filter (upto * 100 >= total * 50) as mid, min(bin) filter (upto * 100 >= total * {QUANTILE}) as high from (
      select *, sum(n) over (partition by {groups}{"," if groups else ""} metric order by bin) as upto, sum(n) over (partition by {groups}{"," if groups else ""} metric) as total from (
        select {groups}{"," if groups else ""} metric, bin, count(*) as n from cells group by all)) group by {groups}{"," if groups else ""} metric){f" where total >= {MIN_DOCS}" if groups else ""})"""  # noqa: E731
    inside = []
    for m, side in METRICS.items():
        got = lambda c: f"coalesce((select {c} from own f where f.metric = '{m}' and f.lang is not distinct from r.lang and f.source is not distinct from r.source), (select {c} from by_lang f where f.metric = '{m}' and f.lang is not distinct from r.lang), (select {c} from every f where f.metric = '{m}'))"  # noqa: E731, B023
        inside.append(f"{m} <= {got(f'm + {SPREAD} * greatest(h - m, least)')}" + (f" and {m} >= {got(f'm - {SPREAD} * greatest(m - lo, least)')}" if side == "both" else ""))
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, {_WORDS} as w from documents),
g as (select *, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as l,
    case when len(w) >= 5 then [list_aggregate(w[i:i + 4], 'string_agg', ' ') for i in range(1, len(w) - 3)] else [] end as five from d),
n as (select g.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words from g left join (
      select doc_id, count(distinct i + k) as n from (
        select doc_id, i, count(*) over (partition by doc_id, f) as c from (select doc_id, unnest(five) as f, generate_subscripts(five, 1) as i from g)
      ), (select unnest(range(0, 5)) as k) where c > 1 group by doc_id) r on r.doc_id = g.doc_id),
rated as (select *, {", ".join(f"{x} as {m}" for m, x in rate.items())} from n),
cells as (select lang, source, metric, ceil(ln(v + 1.0) / ln({GAMMA}::double)) as bin from (unpivot rated on {", ".join(METRICS)} into name metric value v)),
{fences("own", "lang, source")},
{fences("by_lang", "lang")},
{fences("every", "")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {" and ".join(inside)} as kept from rated r"""


ORACLE_SQL = _oracle()
