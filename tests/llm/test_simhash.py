import numpy as np
import pytest
import xxhash

from loomgraph.llm import simhash
from loomgraph.llm.common import connected_components


def brute_fp(text, k):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A b\tc\x0bd e", "É É é x y z", "x " * 999, "a b a b a b a b", "\x1f\x85 q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == brute_fp(text, 4)


def components(x, radius):
    x = np.asarray(x, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("block", "radius"), [(4096, 4), (8, 4), (4096, 8)])
def test_links_join_all_that_are_near(spark, monkeypatch, block, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    x = set(seeds.tolist()) | {0, (1 << 64) - 1}
    for s in seeds.tolist():
        v = s
        for _ in range(15):  # chains and balls about each seed
            for b in rng.choice(64, rng.integers(1, radius + 3), replace=False):
                v ^= 1 << int(b)
            x.add(v)
            v = s if rng.random() < 0.5 else v
    x = sorted(x)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in x], "fp long")
    found = simhash.links(df, radius)
    got = {r["node"]: r["component"] for r in connected_components(found).collect()}
    mine = [got.get(int(np.uint64(v).view(np.int64)), int(np.uint64(v).view(np.int64))) for v in x]
    want = components(x, radius)
    pairs = lambda c: {tuple(np.flatnonzero(np.array(c) == v)) for v in set(c)}
    assert pairs(mine) == pairs(want.tolist())
    assert found.count() < 40 * len(x)


def test_hot_cell_over_batches(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in range(9, 17):  # two points of one cell, parted by its other members; each batch is of 10 rows
            monkeypatch.setattr(simhash, "cell_masks", lambda radius: [(1 << 64) - (1 << 48)])
            spread = [(k * 0x9E3779B97F4A7C15 & 0x3FFFFFFFFFFF) | 1 << 40 for k in range(1, n - 1)]
            x = sorted({0, *spread, 1 << 47 | 3 << 42})
            x = [v for v in x if v in (0, 1 << 47 | 3 << 42) or min(v.bit_count(), (v ^ (1 << 47 | 3 << 42)).bit_count()) > 4]
            rest = [(k << 48) | 5 for k in range(1, 30)]
            df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in x + rest], "fp long")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
            got = {(r["a"], r["b"]) for r in simhash.links(df, 4).collect()}
            assert (0, 1 << 47 | 3 << 42) in got or (1 << 47 | 3 << 42, 0) in got, n
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base), (7, None), (8, ""), (2, "other words here at all now"), (9, base), (11, base.replace("w7 ", "v7 "))]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string")
    got = sorted((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect())
    fps = np.array([simhash.fingerprint(t, 4) for _, t in rows], np.uint64)
    ids = np.array([i for i, _ in rows])
    label = components(fps, 4)
    assert got == sorted((int(i), int(ids[label == c].min())) for i, c in zip(ids, label, strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and 3 in {r["doc_id"] for r in kept.collect()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and len(got) == 303
