import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import resample


def corpus(spark, n=1500):
    rnd = random.Random(1)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 120)))
        kind = "toxic" if i % 10 == 0 else "junk" if i % 10 == 1 else "good"
        if kind == "toxic":
            text += " idiot scum, trash!"
        elif kind == "junk":
            text = " ".join(w + "!!" for w in text.split())
        rows.append((i, text, kind))
        if i % 3 == 0:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_good_documents_stay_and_bad_ones_go(spark):
    docs, labels = corpus(spark)
    got = {r["id"] for r in resample.resample(docs, labels).collect()}
    kinds = {r["doc_id"]: r["weight"] for r in docs.collect()}
    rate = lambda k: np.mean([i in got for i, v in kinds.items() if v == k])
    assert rate("good") > 0.98 and rate("toxic") < 0.05 and rate("junk") < 0.05
    assert got == {r["id"] for r in resample.resample(docs.repartition(3), labels).collect()}
    assert resample.keep_drawn(docs, labels).columns == docs.columns


def test_edges(spark):
    docs, labels = corpus(spark, 300)
    odd = spark.createDataFrame([(9001, None, ""), (9002, "", ""), (None, "x", ""), (0, "a a a", ""), (9003, "y " * 100_000, "")], docs.schema)
    got = resample.resample(docs.unionByName(odd), labels)
    assert all(r["weight"] == 0 for r in got.collect() if r["id"] in (9001, 9002))
    every = resample.keep_drawn(docs.unionByName(odd), labels.limit(0))
    assert every.count() == 305 and every.columns == docs.columns  # null and repeated ids too
    assert resample.resample(docs, labels.limit(0)).count() == 300  # nothing to learn from
    assert resample.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("k", [1, 2, 37, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(0)
    x = np.r_[np.round(rng.normal(size=990), 2), [5.0] * 10]
    df = spark.createDataFrame([(float(v),) for v in x], "key double")
    assert resample.kth_largest(df, k) == np.sort(x)[::-1][k - 1]


@pytest.mark.parametrize("temperature", [resample.TEMPERATURE, 40.0])
def test_weights_and_draw_against_brute_force(spark, temperature):
    """Models, weights and the draw again, by dictionaries and a sort."""
    docs, labels = corpus(spark, 600)
    texts, known = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r for r in labels.collect()}
    seeds = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)).alias("part"), resample.gumbel(F.xxhash64("doc_id", F.xxhash64("text"))).alias("noise"))
    seeds = {r["doc_id"]: r for r in seeds.collect()}
    codes = resample.Codes()
    grams = {i: Counter(resample.buckets(t, codes).tolist()) for i, t in texts.items()}
    target = [i for i, r in known.items() if r["quality"] == 1 and r["toxic"] == 0 and seeds[i]["part"] > 0]

    def counts(ids):
        n, d = Counter(), Counter()
        for i in ids:
            n.update(grams[i])
            d.update(grams[i].keys())
        return n, d

    (rn, rd), (tn, td) = counts(texts), counts(target)
    kind = lambda g: 0 if g < resample.WORDS else 1 if g < resample.WORDS + resample.PAIRS else 2
    share = [sum(v for g, v in tn.items() if kind(g) == k) / sum(v for g, v in rn.items() if kind(g) == k) for k in range(3)]

    def ratio(g):
        e, f = rd[g] * len(target) / len(texts), td[g]
        stat = 2 * ((f * math.log(f / e) if f else 0) - (f - e))
        return math.log((tn[g] + resample.SMOOTH) / (rn[g] * share[kind(g)] + resample.SMOOTH)) / (1 + math.exp((resample.EVIDENCE - stat) / 2))

    want = {i: sum(n * ratio(g) for g, n in c.items()) for i, c in grams.items()}
    got = {r["id"]: r["weight"] for r in resample.resample(docs, labels, temperature=temperature).collect()}
    assert all(abs(w - want[i]) < 1e-3 * (1 + abs(want[i])) for i, w in got.items())
    assert max(want.values()) > 0 > min(want.values())  # both signs count
    key = {i: want[i] / temperature + seeds[i]["noise"] for i in texts}
    best = sorted(texts, key=lambda i: -key[i])[: len(got)]
    edge = key[best[-1]]
    assert all(i in got or abs(key[i] - edge) < 0.01 for i in best) and all(i in best or abs(key[i] - edge) < 0.01 for i in got)
    assert temperature < 1 or got.keys() != {i for i in texts if want[i] >= sorted(want.values())[-len(got)]}  # the noise has its say


def test_the_draw_follows_the_weights(spark):
    """Of many equal pairs, how often the heavier is drawn is what Gumbel noise gives: a logistic of the difference."""
    n = 20_000
    noise = [r[0] for r in spark.range(2 * n).select(resample.gumbel(F.col("id"))).collect()]
    won = np.mean(1.0 + np.array(noise[:n]) > np.array(noise[n:]))
    assert abs(won - 1 / (1 + math.exp(-1))) < 0.015


def test_rows_of_one_id_are_drawn_by_themselves(spark):
    docs, labels = corpus(spark, 600)
    bad = " ".join(["idiot scum, trash!"] * 30)
    odd = spark.createDataFrame([(2, bad, ""), (None, bad, "")], docs.schema)
    kept = resample.keep_drawn(docs.unionByName(odd), labels)
    assert kept.where(F.col("text") == bad).count() == 0 and kept.where("doc_id = 2").count() == 1
