import hashlib
import random
import re

import pytest

from loomgraph.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        k = min(10, len(b))
        for win in {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == win:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("size", [decontaminate.PATTERN_BYTES, 120])
def test_against_brute_force(spark, size):
    rnd = random.Random(9)
    some = lambda n: " ".join(rnd.choice(["a", "B", "c", "é", "x1"]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate((25, 14, 10, 9, 6, 40, 12))] + [(90, None), (91, "..."), (92, "zz"), (93, "A b, C!"), (10, "zz")]
    rows = [(i, some(rnd.randint(0, 60))) for i in range(60)] + [(70 + i, some(5) + " - " + t + ". " + some(4)) for i, t in items[:7]]
    rows += [(100, None), (101, ""), (102, "zz zz"), (103, "x ".join(["q"] * 3000)), (102, "zz zz"), (104, "a\x7fb_c")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, slice_bytes=size)
    got = sorted((r["id"], r["n_words"], tuple(r["spans"]), tuple(r["items"])) for r in found.collect())
    assert len(got) == len(rows)
    for (i, t), (j, n, spans, its) in zip(sorted(rows, key=lambda r: (r[0], r[1] or "")), got, strict=True):
        want = brute(t, items)
        assert (i, n, sum(z - a for a, z in zip(spans[::2], spans[1::2], strict=True)), len(its)) == (j, *want[:3])
    if size > 1000:
        q = {r["doc_id"]: r for r in decontaminate.query(docs, bench).collect()}
        for i, t in rows:
            assert (q[i]["n_words"], q[i]["n_hit"], q[i]["n_items"], q[i]["items_sha256"], q[i]["contaminated"]) == brute(t, items)


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "B")], "item_id long, text string")
    assert decontaminate.query(docs.limit(0), bench).count() == 0
    assert decontaminate.query(docs, bench.limit(0)).where("contaminated").count() == 0
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()] == [2]
