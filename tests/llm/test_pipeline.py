"""The pipeline's stages on a small table, each held against its operator's brute-force version or its own promise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from strandframe.llm import lines, mixing, packing, quality, registry
from strandframe.llm.common import read, staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    taken = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    assert max(taken.values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    first = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert first == taken


def test_empty_input(spark):
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
    assert docs.count() == 0


def odd_documents():
    """(doc_id, text, lang, source, more): nulls in every column, repeated rows, one id with other texts, near copies, long and empty texts."""
    r = random.Random(11)
    words = [f"word{i}" for i in range(500)] + ["The", "the", "ÉTÉ", "漢字", "#tag", "a&b"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    hot, texts = line(9), []
    for i in range(150):
        parts = [line(r.randint(5, 30)) for _ in range(r.randint(2, 6))]
        if i % 3 == 0:
            parts.append(hot if i % 2 else " ".join(["changed", *hot.split()[1:]]))
        texts.append("\n".join(parts))
    for t in texts[:20]:
        w = t.split(" ")
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
    texts += [texts[3], texts[5].upper(), None, "", " \t\n", "too short", "w1 " * 3000, line(9000), "###  " * 30 + line(12), *(" ".join(f"<|{r.choice(words)}|>" for _ in range(40)) for _ in range(3))]
    rows = [(i, t, r.choice(["en", "en", "de", None]), r.choice(["web", "web", "web", "code", None, "", "É"]), None if i % 4 else "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[7], rows[7]] + [(None, texts[k], "en", "web", "y") for k in (8, 9, 9, 152)] + [(30, line(60), "en", "web", None), (30, line(60), None, None, "z")]
    r.shuffle(rows)
    return rows


def brute_quality(rows):
    """The rows that stay, by thresholds from sorted bins."""

    def rates(text):
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        found = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        again = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)}
        chars = sum(map(len, w))
        per = lambda a, k, b: a * k // max(b, 1)
        bad = len(w) < 10 or 100 * len(again) > 20 * len(w)
        return bad, {"symbol_rate": per(len(re.findall(r"[#*$%&|<>]", text)), 10000, chars), "dup_line_rate": per(len(found) - len(set(found)), 1000, len(found)), "repeat_rate": per(len(again), 1000, len(w)), "word_length": per(chars, 100, len(w))}

    rated = [(row, *rates(row[1])) for row in rows]
    groups = defaultdict(list)
    for row, _, x in rated:
        for g in ((row[2], row[3]), (row[2],), ()):
            groups[g].append(x)
    stay = []
    for row, bad, x in rated:
        mine = next(groups[g] for g in ((row[2], row[3]), (row[2],), ()) if not g or len(groups[g]) >= quality.MIN_DOCS)
        inside = True
        for m, side in quality.METRICS.items():
            bins = sorted(math.ceil(math.log(o[m] + 1.0) / math.log(quality.GAMMA)) for o in mine)
            low, mid, high = (quality.GAMMA ** bins[-(-q * len(bins) // 100) - 1] - 1 for q in (100 - quality.QUANTILE, 50, quality.QUANTILE))
            least = quality.LEAST_SPREAD[m]
            inside = inside and x[m] <= mid + quality.SPREAD * max(high - mid, least) and (side != "both" or x[m] >= mid - quality.SPREAD * max(mid - low, least))
        if inside and not bad:
            stay.append(row)
    return stay


def brute_lines(rows):
    """The rows without the lines that go; documents are told apart by id and text."""
    place = lambda i, t, n: ((1 << 63) - 1 if i is None else i, lines._signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), n)
    key = lambda x: tuple(x.encode().lower().split())
    first = {}
    for i, t, *_ in rows:
        for n, x in enumerate((t or "").split("\n")):
            if len(key(x)) >= lines.LEAST_WORDS:
                first[key(x)] = min(first.get(key(x), (1 << 64,)), place(i, t, n))
    goes = {w: any(first[o] < first[w] and o != w and abs(len(o) - len(w)) < 2 and lines.within_one(list(o), list(w)) for o in first) for w in first}
    out = []
    for i, t, *more in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if key(x) not in first or (first[key(x)] == place(i, t, n) and not goes[key(x)])]
        out.append((i, t if t is None else "\n".join(kept), *more))
    return out


def brute_mix(rows):
    """How often each row is taken: whole epochs, then by exponential keys up to the rest."""
    import test_operators

    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += size(row[1])
    out = Counter()
    for source, target in test_operators.reference_targets(dict(sizes)).items():
        epochs = math.floor(target / sizes[source] + 1e-12) if sizes[source] else 0
        rest, placed = target - epochs * sizes[source], []
        for row in rows:
            if row[3] == source and size(row[1]):
                weight = max(5, 100 - 300 * len(re.findall(r"[#*$%&|<>]", row[1])) // max(len(row[1]), 1))
                number = int(hashlib.md5(f"{mixing.SEED}:{'null' if row[0] is None else row[0]}".encode()).hexdigest()[:12], 16)
                placed.append(((-math.log((number + 0.5) / (1 << 48)) * 100 / weight, -1 if row[0] is None else row[0], size(row[1])), row))
        placed.sort(key=lambda x: x[0])
        upto, last = 0, None
        for at, _ in placed:
            upto += at[2]
            if 2 * upto - at[2] <= 2 * rest:
                last = at
        for at, row in placed:
            out[row] += epochs + (last is not None and at <= last)
    return Counter({row: n for row, n in out.items() if n})


def test_stages_against_brute_force(spark):
    """Every stage, on all that the one before it kept, equals a plain version of itself; ids, texts and all other columns come through."""
    from test_near import grouped

    extra = ["a.b", "whole", "h", "root", "size", "tag.x`y"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *[r[4]] * (len(extra) - 1)) for r in odd_documents()], schema)
    run = lambda k, d: staged(corpus_pipeline.STAGES[k][1](spark, d, ""), "stage")

    def rows_of(d):
        assert d.columns == docs.columns
        found = [tuple(r) for r in d.collect()]
        assert all(len(set(r[4:])) == 1 for r in found)
        return [r[:5] for r in found]

    made = rows_of(docs)
    good = run(0, docs)
    assert Counter(rows_of(good)) == Counter(brute_quality(made)) and 0 < good.count() < len(made)

    cleaned = run(1, good)
    want = brute_lines(rows_of(good))
    assert Counter(rows_of(cleaned)) == Counter(want) != Counter(rows_of(good))

    single = run(2, cleaned)
    before, after = rows_of(cleaned), rows_of(single)
    group = dict(zip((r[1] for r in before), grouped([r[1] for r in before]), strict=True))
    least = {}
    for r in before:
        least[group[r[1]]] = min(least.get(group[r[1]], (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((group[r[1]], (r[0] is None, r[0] or 0)) for r in after) == sorted(least.items()) and len(after) < len(before)
    assert not Counter(after) - Counter(before)

    mixed = run(3, single)
    assert Counter(rows_of(mixed)) == brute_mix(after)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces = Counter()
    for r in rows_of(mixed):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            pieces[r[0], k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    packed = run(4, mixed).collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda rows: sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in columns]
    assert norm(df.select(*columns).collect()) == norm([tuple(r[i] for i in at) for r in found.fetchall()])
