import pytest

import corpus_pipeline
from loomgraph.llm import queries
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def test_names():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, seen = docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).persist()
        seen.append(after.count())
        if name != "sentencepiece":
            assert after.columns == docs.columns
        docs = after
    assert n >= seen[0] == seen[1] >= seen[2] >= seen[3] == seen[4] > 0.5 * n
    rows = sorted((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert rows == sorted((r["doc_id"], r["decoded_sha256"]) for r in docs.collect())
