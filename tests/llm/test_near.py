import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import near

WORDS = [a + b for a in "ka lo mi ne pu ra st vo".split() for b in "ber din gal hos".split()]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    common = " ".join(r.choices(WORDS, k=30))
    out = ["", None, "  ", "Ka", "ka", "lo mi", "lo  MI", common]
    for n in (5, 9, 30, 64, 64, 200, 900):
        base = r.choices(WORDS, k=n)
        out.append(" ".join(base))
        for changed in (1, 2, 4, 8, 16):
            w = list(base)
            for i in r.sample(range(n), min(n, changed)):
                w[i] = r.choice(WORDS)
            out.append(" ".join(w))
    out += [common + " " + " ".join(r.choices(WORDS, k=k)) for k in (2, 5, 8, 40, 60, 80) for _ in range(3)]
    # a chain: neighbours link, the ends don't
    chain = r.choices(WORDS, k=140)
    out += [" ".join(chain[i : i + 100]) for i in range(0, 41, 8)]
    return [(i, t) for i, t in enumerate(out)] + [(None, "no id"), (3, "Ka"), (None, None)]


def test_stage_leaves_one_of_each_component(spark, texts):
    sets = [shingles(t) for _, t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(root(i), []).append(d)
    want = sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)
    docs = spark.createDataFrame([(d, t, "en", i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, sig string, n int").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == want
    assert len(want) < len(texts) - 20
    # buckets in tiles, and pairs of a second comparison, give the same
    tiny = near.keep_one(docs, tile=1)
    assert sorted((r["doc_id"] for r in tiny.collect()), key=str) == want


def test_bit_sliced_buckets_find_what_all_pairs_find():
    r = random.Random(4)
    sets = []
    for n in (4, 5, 10, 40, 200):
        for _ in range(12):
            base = [r.getrandbits(64) for _ in range(n)]
            for m in range(0, n // 8 + 1):
                sets.append(np.unique(np.array(base[m:] + [r.getrandbits(64) for _ in range(m // 2)], np.uint64)))
    prints = [near._print(s) for s in sets]
    for s, p in zip(sets, prints, strict=True):
        assert p == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in s) * 2 > len(s))
    far = [(prints[i] ^ prints[j]).bit_count() for i in range(len(sets)) for j in range(i) if 5 * len(b := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(b))]
    assert len(far) > 100 and max(far) <= near.RADIUS


def test_stage_on_hard_inputs(spark):
    rows = [(None, None, 1), (None, "", 2), (7, "  \n", 3), (1, "W" * 200000, 4), (2, "w" * 200000, 5), (2, "w" * 200000, 6), (9, "é 日本 é 日本 é", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first long").withColumn("c", F.lit(1))
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == [1, 7, 9]
    assert near.keep_one(docs.limit(0)).count() == 0 and near.keep_one(docs).columns == docs.columns
