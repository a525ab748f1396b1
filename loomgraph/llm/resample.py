"""Quality by importance resampling: target over raw n-gram models, Gumbel top-k.

A text's n-grams are its words without the marks around them, its pairs of
neighbouring words and the marks of each word, all hashed to buckets. Counts over
all documents make the raw model; counts over accepted labelled documents, of at
most TARGET_ROWS labelled rows, make the target model. A bucket's log ratio is
log(p_target / p_raw), of either sign, with SMOOTH pseudo-counts that follow the
raw model, times the chance that the models differ there at all: the logistic of
half the G statistic of the bucket's numbers of texts less EVIDENCE, since texts
of rare words would else gather chance alone. A document's log weight is the sum
over its n-grams, each as often as it occurs. How many documents to take, k, is
the number whose weight reaches the threshold that separates a held-out fifth of
the labelled rows best; the k rows with the largest log weight over TEMPERATURE
plus Gumbel noise are drawn, which samples without replacement by weight.

Defined cases: null and empty texts have no n-grams and log weight zero. Each
row is drawn by itself; its noise is seeded by its id and text, so equal rows
share their fate, and rows of one id with other texts, or with a null id, do not.
Without labelled rows of both kinds all documents are drawn. An empty table
gives no rows. Only the named columns are read.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import Written, parts_of, scratch, strings, worker_state

#: Labelled rows used at most: those with the smallest hash of their id.
TARGET_ROWS = 40_000
#: Buckets of words, of pairs and of marks.
WORDS, PAIRS, MARKS = 1 << 19, 1 << 18, 1 << 10
#: Where each kind of bucket ends.
_ENDS = (WORDS, WORDS + PAIRS, WORDS + PAIRS + MARKS)
#: Pseudo-counts, evidence at which a difference is as likely as not, and what log weights are divided by before noise is added.
SMOOTH, EVIDENCE, TEMPERATURE = 4.0, 8.0, 0.5
#: Tokens that a worker's table keeps.
KEPT = 100_000
#: Values of one histogram when the k-th largest key is looked for.
BINS = 4096

_MARKS = ".,;:!?%$#*&|()[]{}\"'-_/\\<>=+~`^@…–—«»“”¿¡"


class Codes(dict):
    """token: the hash of its core above that of its marks."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        core = token.strip(_MARKS)
        marks = token.replace(core, "", 1) if core else token
        code = zlib.crc32((core or token).encode("utf-8", "replace")) << 16 | zlib.crc32(marks.encode("utf-8", "replace")) & 0xFFFF
        if len(token) <= 64:
            self[token] = code
        return code


def buckets(text: str, codes: Codes) -> np.ndarray:
    """The bucket of each n-gram of a text, repeats included; pairs' follow the words', marks' the pairs'."""
    tokens = text.lower().split()
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    core, marks = (code >> 16).astype(np.uint64), code & (MARKS - 1)
    mix, down = np.uint64(0x9E3779B97F4A7C15), np.uint64(40)
    word = (core * mix >> down) & np.uint64(WORDS - 1)
    pair = ((core[:-1] * np.uint64(0x85EBCA77C2B2AE63) + core[1:]) * mix >> down) & np.uint64(PAIRS - 1)
    return np.concatenate([word.astype(np.int64), pair.astype(np.int64) + WORDS, marks + _ENDS[1]])


def _counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(occurrences, texts that have it) of each bucket, and all texts: one row a task and bucket, then sums."""

    def run(batches):
        codes = worker_state("codes", Codes)
        size = _ENDS[2] + 1
        total, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in parts_of(batches):
            total[-1] += b.num_rows
            held, once, n = [], [], 0

            def add():
                if held:
                    total[:] += np.bincount(np.concatenate(held), minlength=size)
                    seen[:] += np.bincount(np.concatenate(once), minlength=size)

            for t in strings(b.column(0)):
                x = buckets(t, codes)
                held.append(x)
                once.append(np.unique(x))
                n += len(x)
                if n > 1 << 18:
                    add()
                    held, once, n = [], [], 0
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(seen[at])], names=["bucket", "n", "texts"])

    rows = texts.mapInArrow(run, "bucket int, n long, texts long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).toArrow()
    out = np.zeros((2, _ENDS[2] + 1), np.int64)
    out[:, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy(), rows.column("texts").to_numpy()
    return out[0, :-1], out[1, :-1], int(out[0, -1])


def log_ratios(raw: np.ndarray, target: np.ndarray, raw_texts: np.ndarray, target_texts: np.ndarray, share: float) -> np.ndarray:
    """The log ratio of each bucket. share: of the documents that are targets."""
    out = np.zeros(len(raw))
    for a, z in zip((0, *_ENDS), _ENDS, strict=False):
        r, t = raw[a:z], target[a:z]
        ratio = np.log((t + SMOOTH) / (r * (t.sum() / max(1, r.sum())) + SMOOTH))
        expected, found = np.maximum(raw_texts[a:z] * share, 1e-9), target_texts[a:z]
        g = 2 * (np.where(found > 0, found * np.log(np.maximum(found, 1) / expected), 0) - (found - expected))
        out[a:z] = ratio / (1 + np.exp(np.minimum((EVIDENCE - g) / 2, 700)))
    return out.astype(np.float32)


def _scored(docs: DataFrame, ratios: np.ndarray, text_col: str) -> DataFrame:
    """docs with __weight, the log weight of each row's text."""
    sent, place = docs.sparkSession.sparkContext.broadcast(ratios), docs.columns.index(text_col)

    def run(batches):
        codes, r = worker_state("codes", Codes), sent.value
        for b in parts_of(batches):
            w = [float(r[buckets(t, codes)].sum(dtype=np.float64)) for t in strings(b.column(place))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(w, 6), pa.float64())], names=[*b.schema.names, "__weight"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__weight", T.DoubleType())]))


def threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight from which documents count as good: the largest balanced accuracy, then the lowest such weight."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    kept = g.sum() - np.r_[0, np.cumsum(g)]
    thrown = np.r_[0, np.cumsum(~g)]
    value = kept / g.sum() + thrown / (~g).sum()
    value[1:-1][w[1:] == w[:-1]] = -1  # no threshold between equal weights
    at = int(np.argmax(value))
    if at == 0:
        return -np.inf
    return float((w[at - 1] + w[min(at, len(w) - 1)]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column key, by histograms that narrow down to it."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where(F.col("key").between(low, high))
        if low == high:
            return low
        step = (high - low) / BINS
        bin_ = F.least(F.floor((F.col("key") - low) / F.lit(step)), F.lit(BINS - 1).cast("long"))
        rows = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if r["n"] >= k:
                break
            k -= r["n"]
        if (r["a"], r["z"]) == (low, high) or step == 0:  # keys too close to be told apart further
            return float(np.sort([x[0] for x in inside.select("key").distinct().collect()])[::-1][0])
        low, high = r["a"], r["z"]


def gumbel(seed):
    """Standard Gumbel noise, a function of the seed, which is a long."""
    uniform = (F.pmod(F.xxhash64(seed, F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, target_rows: int, temperature: float, only: list[str] | None = None) -> DataFrame:
    """The rows drawn, with the columns of docs, or only those, and __weight. What is scored is written once, with its weight, and then filtered."""
    with scratch() as keep:
        id_ = F.col(id_col).cast("long").alias("id")
        known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
        known = known.agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
        known = known.orderBy(F.xxhash64("id"), "id").limit(target_rows)  # the documented bound
        known = Written(known.withColumn("fit", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) > 0), "labels").df
        texts = docs.select(id_, F.col(text_col).alias("text"))
        target = texts.join(F.broadcast(known.where("fit AND good").select("id")), "id", "left_semi").select("text")
        raw, raw_texts, n = _counts(texts.select("text"))
        wanted, wanted_texts, m = _counts(target)
        scored = _scored(docs, log_ratios(raw, wanted, raw_texts, wanted_texts, m / max(1, n)), text_col)
        scored = scored.withColumn("__noise", gumbel(F.xxhash64(id_, F.xxhash64(text_col))))
        scored = Written(scored.select(*(only or docs.columns), "__weight", "__noise"), "scored")
        keep(scored)
        all_, scored = scored.df.drop("__noise"), scored.df
        held = scored.select(id_, F.col("__weight").alias("weight")).join(F.broadcast(known.where("NOT fit")), "id").select("weight", "good").toPandas()
        good = held["good"].to_numpy(bool)
        if not good.any() or good.all():
            return all_
        k = scored.where(F.col("__weight") >= threshold(held["weight"].to_numpy(float), good)).count()
        if not k:
            return all_.limit(0)
        key = F.col("__weight") / temperature + F.col("__noise")
        return scored.where(key >= kth_largest(scored.select(key.alias("key")), k)).drop("__noise")


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = TARGET_ROWS,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """(id, weight) of the rows drawn. labels: doc_id, quality and toxic; accepted: quality 1 and toxic 0."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _drawn(df, labels, "id", "text", target_rows, temperature, ["id"]).select("id", F.col("__weight").alias("weight"))


def keep_drawn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, temperature: float = TEMPERATURE
) -> DataFrame:
    """The rows drawn, with all columns of docs."""
    return _drawn(docs, labels, id_col, text_col, target_rows, temperature).drop("__weight")
