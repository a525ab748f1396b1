import numpy as np
import pytest

from loomgraph.llm import similar
from loomgraph.llm.simhash import embed


def sets_of(texts):
    return [similar.shingle_set(similar._words(t), 5) for t in texts]


def groups(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return label


def test_fingerprint_bits():
    import xxhash

    words = [f"w{i % 13}".encode() for i in range(40)]
    hs = [xxhash.xxh3_128_digest(b" ".join(words[i : i + 5])) for i in range(36)]
    a, b = similar.fingerprint(words, 5)
    got = np.unpackbits(np.array([a, b], np.uint64).view(np.uint8))
    assert got.tolist() == [int(2 * sum(h[k // 8] >> (7 - k % 8) & 1 for h in hs) > 36) for k in range(128)]
    assert similar.fingerprint([], 5) == (0, 0) and similar.fingerprint(words[:3], 5) != (0, 0)


@pytest.mark.parametrize(("every", "block"), [(True, 4096), (True, 7), (False, 4096), (False, 7)])
def test_candidates_against_brute_force(spark, monkeypatch, every, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "ROWS", 100)
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, (6, 2), np.uint64)
    x = np.array([[int(w) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 10), replace=False)) for w in s] for s in seeds for _ in range(30)], np.uint64)
    label = rng.integers(0, 3, len(x))
    masks, radius = similar.grid(1 << 14, 0.8)
    rows = [(i, *(int(w.view(np.int64)) for w in v), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    got = [(r["a"], r["b"]) for r in similar.candidates(spark.createDataFrame(rows, "node long, f0 long, f1 long, label long"), masks, radius, every).collect()]
    e = np.stack([embed(x[:, 0]), embed(x[:, 1])], axis=1)
    share = lambda i, j: any(((e[i] ^ e[j]) & m == 0).all() for m in masks)
    near = {(i, j) for j in range(len(x)) for i in range(j) if np.bitwise_count(x[i] ^ x[j]).sum() <= radius and share(i, j)}
    if every:
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in near if label[i] != label[j]}
    else:
        assert set(got) <= near | {(i, j) for j in range(len(x)) for i in range(j) if np.bitwise_count(x[i] ^ x[j]).sum() <= radius}
        assert groups(len(x), got) == groups(len(x), near)


def test_grid_recalls_pairs_of_just_the_similarity():
    """Pairs whose bits differ as often as at 0.8 share a cell and lie within the radius, as promised, at any size."""
    rng = np.random.default_rng(2)
    for n in (1000, 10**7, 10**8):
        masks, radius = similar.grid(n, 0.8)
        x = rng.integers(0, 1 << 63, (3000, 2), np.uint64)
        y = x ^ np.packbits(rng.random((3000, 128)) < similar.flips(0.8), axis=1).view(np.uint64)
        d = np.stack([embed(x[:, k]) ^ embed(y[:, k]) for k in (0, 1)], axis=1)
        cell = np.zeros(3000, bool)
        for m in masks:
            cell |= ((d & m) == 0).all(axis=1)
        assert cell.mean() > 0.88 and (np.bitwise_count(x ^ y).sum(axis=1) <= radius).mean() > 0.97


def test_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(None, "no id"), (900, None), (901, ""), (902, "  \n"), (903, "Short text"), (904, "short  TEXT"), (905, "w " * 30_000)]
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(60, 400)))]
        rows.append((len(rows) * 3, " ".join(words)))
        for _ in range(int(rng.integers(0, 4))):
            new = [w if rng.random() > rng.choice([0.005, 0.01, 0.02, 0.05]) else f"v{rng.integers(0, 99)}" for w in words]
            rows.append((len(rows) * 3, " ".join(new)))
    rows.append((rows[-1][0], rows[-1][1]))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    ids = sorted({i for i, _ in rows if i is not None})
    texts = {i: t for i, t in rows if i is not None}
    sets = sets_of([texts[i] for i in ids])
    alike = [(i, j) for j in range(len(ids)) for i in range(j) if similar.jaccard(sets[i], sets[j]) >= 0.8]
    want = groups(len(ids), alike)
    found = similar.similar_documents(docs)
    got = {r["id"]: r["component"] for r in found.collect()}
    assert set(got) == set(ids) and found.count() == len(rows) - 1
    joined = sum(got[ids[i]] == got[ids[j]] for i, j in alike)
    assert len(alike) > 50 and joined >= 0.95 * len(alike)
    at = {i: k for k, i in enumerate(ids)}
    assert all(want[k] == want[at[got[i]]] for k, i in enumerate(ids))  # nothing below the similarity
    assert got[902] == 900 and got[904] == 903 and got[905] == 905
    kept = similar.keep_similar(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in ids if got[i] == i} | {None}
    assert similar.similar_documents(docs.limit(0)).count() == 0 and similar.keep_similar(docs.limit(0)).count() == 0


def test_a_family_of_hundreds(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 3000, 400)]
    texts = []
    for _ in range(120):
        at = set(rng.choice(400, 9, replace=False).tolist())
        cousin = [f"v{rng.integers(0, 10**6)}" if k in at else w for k, w in enumerate(base)]
        at = set(rng.choice(400, 4, replace=False).tolist())
        texts += [cousin, [f"u{rng.integers(0, 10**6)}" if k in at else w for k, w in enumerate(cousin)]]
    texts = [" ".join(t) for t in texts]
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    sets = sets_of(texts)
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if similar.jaccard(sets[i], sets[j]) >= 0.8]
    found = similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["id"]: r["component"] for r in found.collect()}
    want = groups(len(texts), alike)
    assert len(alike) > 100 and len(set(want)) > 60
    assert sum(got[i] == got[j] for i, j in alike) >= 0.97 * len(alike)
    assert all(want[i] == want[c] for i, c in got.items())


def test_unlike_texts_of_one_fingerprint(spark):
    pad = "x " * 3000
    words = lambda c, n: [f"{c}{k}" for k in range(n)]
    b = words("b", 500)
    rows = [(1, pad + " ".join(words("a", 500))), (2, pad + " ".join(b)), (3, pad + " ".join([*b[:490], *words("z", 10)])), (4, pad + " ".join(words("c", 500)))]
    assert len({similar.fingerprint(similar._words(t), 5) for _, t in rows}) == 1
    found = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["component"] for r in found.collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
