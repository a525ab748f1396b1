import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import linededup


def test_shifted_passages_and_columns(spark):
    lines = [f"This is line {i} of a passage that repeats.\n" for i in range(40)]
    passage = "".join(lines)
    rows = [(1, passage, "k"), (2, "Own start. " + passage + "Own end", "k"), (3, "Nothing in common\nat all", "k"), (4, None, "k"), (5, "", "k"), (6, passage, "k"), (None, passage, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(docs).collect()}
    assert linededup.remove_repeats(docs).columns == docs.columns
    assert got[1] == passage and got[3] == rows[2][1] and got[4] is None and got[5] == "" and got[None] == passage
    assert got[6] == ""
    assert got[2].startswith("Own start. This is line 0") and got[2].endswith("Own end") and len(got[2]) < 0.5 * len(passage)


def test_repeats_within_a_document_and_ties(spark):
    block = "".join(f"Sentence number {i} stands here. " for i in range(30))
    docs = spark.createDataFrame([(1, block + "Middle.\n" + block), (1, block + "Middle.\n" + block)], "doc_id long, text string")
    out = [r["text"] for r in linededup.remove_repeats(docs).collect()]
    assert len(out) == 2 and out[0] == out[1] and len(block) <= len(out[0]) < 2 * len(block)


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 50_000), (2, "a.\n" * 20_000), (3, "a.\n" * 20_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_chars"] for r in linededup.query(docs).collect()}
    assert got == {1: 250_000, 2: 60_000, 3: 0}
    assert linededup.query(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sentences", [1, 2, 3, 4, 5, 6])
def test_embedded_passages(spark, sentences):
    rng = random.Random(sentences)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + ". "
    passage = "".join(say(-(-52 // sentences) + k % 3) for k in range(sentences))
    own = [["".join(say(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 8))) for _ in range(2)] for _ in range(12)]
    rows = [(i, a + passage + b) for i, (a, b) in enumerate(own)]
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=50, long_line=0).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == own[i][0] + own[i][1] for i in range(1, 12))


def cut(text, long_line=linededup.LONG_LINE):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    return [u for x in lines for u in (re.findall(r"(?s).+?(?:[.!?] |\Z)", x) if len(x) > long_line else [x])]


def test_units_are_lines(spark):
    texts = ["One. Two! Three\nnext", "\n\na", "x. " * 100 + "\nshort. line", "no end", "\n", "y " * 150 + "z? Q. \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = [r["u"] for r in df.select(linededup.units_of(F.col("t")).alias("u")).collect()]
    assert got == [cut(t) for t in texts] and got[0] == ["One. Two! Three\n", "next"] and len(got[2]) == 102


def test_repeated_ids_with_other_texts(spark):
    passage = "".join(f"This is line {i} of a passage that repeats.\n" for i in range(40))
    rows = [(1, passage), (1, "x"), (2, passage), (2, "x"), (1, "U"), (1, passage), (0, passage + "end"), (0, passage + "tail"), (None, passage), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in linededup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted([(r["doc_id"], r["text"]) for r in linededup.remove_repeats(docs.repartition(3)).collect()], key=str)
    assert len(got) == len(rows) and (1, "x") in got and (1, "U") in got and (2, "x") in got and (2, None) in got and (None, passage) in got
    long = [t for i, t in got if i is not None and t and t[0] == "T"]
    assert sum(t.startswith(passage) for t in long) == 1 and sorted(len(t) for t in long)[-2] < len(passage) / 2


def brute(texts, words):
    """Units that stand in an earlier run of whole units with so many words: all of them, looked for one by one."""
    units = [cut(t) for t in texts]
    seen, gone = {}, set()
    for d, u in enumerate(units):
        count = [max(1, len(x.split())) for x in u]
        for i in range(len(u)):
            for j in range(i, len(u)):
                if sum(count[i : j + 1]) >= words:
                    if seen.setdefault(tuple(u[i : j + 1]), (d, i)) != (d, i):
                        gone |= {(d, k) for k in range(i, j + 1)}
    return ["".join(x for i, x in enumerate(u) if (d, i) not in gone) for d, u in enumerate(units)]


def test_passages_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MIN_UNITS", 10**6)  # passages alone
    rng = random.Random(3)
    pool = ["a " * rng.choice([0, 1, 2, 3, 5, 8, 13]) + f"u{k % 25}" + rng.choice(["\n", ". ", "! "]) for k in range(40)] + ["\n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    texts += [texts[0], "a.\n" * 60, "x " * 70, "own. " + texts[3] + "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeats(docs, words=15).collect()}
    want = brute(texts, 15)
    assert [got[i] for i in range(len(texts))] == want and want[:-3] != texts[:-3]
