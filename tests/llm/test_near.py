"""The pipeline's near copies against brute force over all pairs."""

import random

import corpus_pipeline


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)  # so texts without words are copies of each other


def grouped(texts):
    found = [sets(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(found[i], found[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def planted(seed=5):
    """Copies with 1 to 12 words of 200 changed (similarities on both sides of 0.8), copies of copies, and one large group."""
    r = random.Random(seed)
    line = lambda k: [f"w{r.randrange(3000)}" for _ in range(k)]

    def changed(words, k):
        out = list(words)
        for at in r.sample(range(len(out)), k):
            out[at] = f"new{r.random()}"
        return out

    texts = [line(200) for _ in range(20)]
    for base in list(texts):
        texts += [changed(base, k) for k in (1, 2, 3, 4, 5, 8, 12)]
    for base in texts[20:60]:
        texts.append(changed(base, 3))
    hot = line(120)
    texts += [changed(hot, r.randint(0, 3)) for _ in range(60)]
    texts += [line(n) for n in (1, 2, 4, 5, 6, 7) for _ in range(2)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", texts[0][0].upper()]
    r.shuffle(texts)
    return texts


def test_stage_keeps_one_of_each_group(spark, make):
    texts = planted()
    docs = make(list(enumerate(texts)))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = sorted(set(grouped(texts)))
    assert len(want) < len(texts) // 2
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_links_across_components(spark, make):
    """A group in which most pairs are below the bound: many components at each anchor, and none may be joined or left apart wrongly."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in r.sample(range(100), r.randint(0, 6)):
            words[at] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(words))
    kept = corpus_pipeline.near_duplicates(spark, make(list(enumerate(texts))), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(grouped(texts)))


def test_bits_apart():
    """No pair at the bound differs in more bits than are looked at."""
    import numpy as np
    from strandframe.llm import near

    r = np.random.default_rng(2)
    mix = r.integers(0, 1 << 64, near.BITS // 64, np.uint64) | np.uint64(1)
    for n in (16, 40, 400):
        for _ in range(300):
            whole = r.integers(0, 1 << 63, n, np.uint64)
            cut = n // 10
            a, b = near.fingerprint(whole[cut:], mix), near.fingerprint(whole[: n - cut], mix)
            assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= near.apart(0.8)


def test_any_ids(spark, make):
    """Different texts under null and repeated ids: one row for each group, a named one where there is one."""
    texts = planted()
    r = random.Random(8)
    ids = [r.choice([None, None, 7, 7, 8, i]) for i in range(len(texts))]
    kept = corpus_pipeline.near_duplicates(spark, make(list(zip(ids, texts, strict=True))), "").collect()
    group = dict(zip(texts, grouped(texts), strict=True))
    least = {}
    for i, t in zip(ids, texts, strict=True):
        least[group[t]] = min(least.get(group[t], (True, 0)), (i is None, i or 0))
    found = [(group[row["text"]], (row["doc_id"] is None, row["doc_id"] or 0)) for row in kept]
    assert sorted(found) == sorted(least.items())


def test_anchors_are_near_words():
    """Anchors are the nearest words of Golay codes to SimHash fingerprints, and pairs at exactly 0.8 share one."""
    import numpy as np
    from strandframe.llm import near, simhash

    r = np.random.default_rng(6)
    code, many = near.covering(), near.TABLES // near.ROUNDS
    width = many * near.WORDS * simhash.LENGTH
    for n, cut in ((5, (0, 1)), (18, (2, 2)), (180, (20, 20))):
        shared = np.zeros(20, bool)
        whole = [r.integers(0, 1 << 63, n + cut[0], np.uint64) for _ in shared]
        sides = [[w[cut[0] :] for w in whole], [w[: n + cut[0] - cut[1]] if cut[1] else w for w in whole]]
        for turn in range(near.ROUNDS):
            mix = np.random.default_rng([near.SEED, turn]).integers(0, 1 << 64, -(-width // 64), np.uint64) | np.uint64(1)
            found = []
            for side in sides:
                margins = np.array([2 * near.votes(s, mix)[:width] - len(s) for s in side], np.float32).reshape(len(side), many, near.WORDS, -1)
                anchors, there = near.nearest(margins, many * turn, code)
                assert there[:, :, 0].all()
                found.append([set(a[t].tolist()) for a, t in zip(anchors, there, strict=True)])
                for text in range(3):
                    for table in range(many):
                        assert anchors[text, table, 0] >> 12 * near.WORDS == many * turn + table
                        for k in range(near.WORDS):
                            top = int(anchors[text, table, 0]) >> 12 * (near.WORDS - 1 - k) & 0xFFF
                            word = top << 11 | simhash._syndrome(top << 11)
                            hard = sum(1 << i for i in range(simhash.LENGTH) if margins[text, table, k, i] > 0)
                            assert (word ^ hard).bit_count() <= simhash.RADIUS + near.FURTHER
            shared |= [bool(a & b) for a, b in zip(*found, strict=True)]
        assert shared.all()


def test_links_and_components_broadcast_nothing(spark):
    """A row becomes about 60 anchors that Spark doesn't count: what looks small enough to broadcast isn't."""
    from pyspark.sql import functions as F

    from strandframe.llm import simhash
    from strandframe.llm.common import staged

    few = staged(spark.range(1000).select(F.xxhash64("id").alias("fp")), "few")
    plan = simhash.links(few)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
