"""The corpus pipeline: each stage reads what the stage before it wrote."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, linededup, pieces, resample, similar
from loomgraph.llm.common import Written, release
from loomgraph.llm.queries import tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier does not draw."""
    return resample.keep_drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of lines, and repeated passages of 50 words or more, out of the texts. Units are sentences throughout, as passages may begin within a line."""
    out = linededup.remove_repeats(docs, words=50, long_line=0)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more."""
    return similar.keep_similar(docs, shingle=5, similarity=0.8)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold passages of the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with the digest of what they decode to."""
    out = pieces.encode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("sentencepiece", tokenize),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = Written(stage(spark, docs, sf_dir), name)
        release(after)  # what the stage wrote on its way, and the table before
        docs = after.df
    return docs
