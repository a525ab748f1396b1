"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of benchmark words. Patterns of one length are searched
together: a table gives for each block of two words how far the search may move
on, a block that ends some pattern selects a bucket by the hash of those last
words, and each pattern of the bucket is compared word by word. A document word
inside any occurrence is hit.

Defined cases: null texts have no words; an item without words has no window and
is never found; an item of fewer words than a window is one shorter window.
Windows that several items share count for each. Repeated rows of documents are
each judged; repeated item ids count once. Only the named columns are read, so
extra columns do not matter. Empty documents give no rows; an empty benchmark
hits nothing. If the benchmark is larger than PATTERN_BYTES it is searched in
slices of that size, and each document's occurrences are then put together.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Written, parts_of, strings

#: Bytes of benchmark text searched at once: the bound on what is sent to the executors.
PATTERN_BYTES = 4 << 20
#: Words of a window.
WINDOW = 10

#: A-Z to lower case; other ASCII but digits and letters to blanks; what isn't ASCII stays.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WuManber:
    """Searches lists of words for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[int, ...]]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - 2 : end] if self.block == 2 else pattern[0]
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            key = pattern[-2:] if self.block == 2 else pattern[0]
            self.bucket.setdefault(key, []).append((list(pattern), items))

    def search(self, words: list[bytes]):
        """(start, items) of each occurrence, in order."""
        n, length, most = len(words), self.length, self.most
        shift, bucket, pair = self.shift.get, self.bucket, self.block == 2
        at = length - 1
        while at < n:
            key = (words[at - 1], words[at]) if pair else words[at]
            step = shift(key, most)
            if step:
                at += step
                continue
            start = at - length + 1
            found = words[start : at + 1]
            for pattern, items in bucket[key]:
                if pattern == found:
                    yield start, items
            at += 1


def windows(text: str | None, window: int) -> list[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return []
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))]


def _engines(items: list[tuple[int, str]], window: int) -> list[WuManber]:
    by_length: dict[int, dict] = {}
    for item, text in items:
        for w in windows(text, window):
            by_length.setdefault(len(w), {}).setdefault(w, set()).add(item)
    return [WuManber(n, {p: tuple(i) for p, i in found.items()}) for n, found in sorted(by_length.items())]


def _search(docs: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    """(id, n_words, spans, items): occurrences as flat starts and ends, merged."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)

    def run(batches):
        engines = _engines(sent.value, window)
        for b in batches:
            counts, spans, hits = [], [], []
            for text in strings(b.column(1)):
                words = words_of(text)
                found, got = [], set()
                for engine in engines:
                    for start, of in engine.search(words):
                        found.append((start, start + engine.length))
                        got.update(of)
                flat: list[int] = []
                for start, end in sorted(found):
                    if flat and start <= flat[-1]:
                        flat[-1] = max(flat[-1], end)
                    else:
                        flat += [start, end]
                counts.append(len(words))
                spans.append(flat)
                hits.append(sorted(got))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))],
                names=["id", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, "id long, n_words long, spans array<long>, items array<long>")


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> list[DataFrame]:
    """The benchmark's (item, text) in parts of some slice_bytes."""
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    bench = bench.where("item IS NOT NULL AND text IS NOT NULL")
    n = 1 + (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [bench.where(part == k) for k in range(n)] if n > 1 else [bench]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slice_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """(id, n_words, spans, items): hit words as flat starts and ends, and the items found, ascending."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = _slices(benchmark, item_col, item_text_col, slice_bytes)
    if len(parts) == 1:
        return _search(docs, [tuple(r) for r in parts[0].collect()], window)
    # Ids may repeat, so rows are told apart before slices are put together.
    docs = Written(docs.withColumn("row", F.monotonically_increasing_id()), "documents").df
    every = None
    for bench in parts:
        rows = [tuple(r) for r in bench.collect()]
        one = Written(_search(docs.select(F.col("row").alias("id"), "text"), rows, window), "slice").df
        every = one if every is None else every.union(one)
    every = every.groupBy("id").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def merge(batches):
        for b in batches:
            out = []
            for flat in b.column(2).to_pylist():
                merged: list[int] = []
                for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
                    if merged and start <= merged[-1]:
                        merged[-1] = max(merged[-1], end)
                    else:
                        merged += [start, end]
                out.append(merged)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64())), b.column(3)], names=["id", "n_words", "spans", "items"]
            )

    every = every.mapInArrow(merge, "id long, n_words long, spans array<long>, items array<long>")
    rows = docs.select("row", F.col("id").alias("own"))
    return rows.join(every.withColumnRenamed("id", "row"), "row").select(F.col("own").alias("id"), "n_words", "spans", "items")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slice_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """The rows of docs without any hit word, with all their columns. Each row is judged where it lies: nothing is shuffled."""
    sc, place = docs.sparkSession.sparkContext, docs.columns.index(text_col)

    def clean(items: list[tuple[int, str]]):
        sent = sc.broadcast(items)

        def run(batches):
            engines = _engines(sent.value, window)
            for b in parts_of(batches):
                words = map(words_of, strings(b.column(place)))
                yield b.filter(pa.array([not any(True for e in engines for _ in e.search(w)) for w in words], pa.bool_()))

        return run

    for bench in _slices(benchmark, "item_id", "text", slice_bytes):
        docs = docs.mapInArrow(clean([tuple(r) for r in bench.collect()]), docs.schema)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    lengths = F.aggregate(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"),
        lambda n, i: n + F.get("spans", i + 1) - F.get("spans", i),
    )
    hit = F.when(F.size("spans") > 0, lengths).otherwise(F.lit(0).cast("long"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def oracle_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    pat AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    ks AS (SELECT DISTINCT k FROM pat),
    win AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
    hit AS (SELECT DISTINCT doc_id, win.k, i, item_id FROM win JOIN pat ON pat.k = win.k AND pat.p = win.p),
    pos AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
           sha256(coalesce(its.j, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""
