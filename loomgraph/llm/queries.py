"""The queries over the driver's tables, one for each operator, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, forest, linededup, pieces, pii, rans, resample, simhash, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    bits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), bits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.query(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(_table(spark, sf_dir, "pages"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query(_table(spark, sf_dir, "pages"))


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rans.write_tokens(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return rans.read_tokens(files.df)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return drawn.select(F.col("id").alias("doc_id"), F.col("weight").alias("log_weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_simhash": op2_simhash,
        "op3_linededup": op3_linededup,
        "op4_warc": op4_warc,
        "op5_urls": op5_urls,
        "op6_rans": op6_rans,
        "op7_pieces": op7_pieces,
        "op8_forest": op8_forest,
        "op9_decontaminate": op9_decontaminate,
        "op10_resample": op10_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pii": pii.oracle_sql(),
        "op3_linededup": linededup.oracle_sql(),
        "op4_warc": warc.oracle_sql(),
        "op5_urls": urls.oracle_sql(),
        "op9_decontaminate": decontaminate.oracle_sql(),
    }
