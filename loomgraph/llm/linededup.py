"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A text is cut into units: its lines with their ends; a line of over LONG_LINE
characters, a parameter, is cut into its sentences instead, as texts without line
ends would be one unit. A rolling hash over the hashes of each unit and the one
before marks a boundary where it is larger than at both neighbours, so boundaries
depend on nearby units alone and chunks find themselves again after shifts.
Chunks of MIN_UNITS units or more whose hash occurs more than once are brought
together and compared byte by byte; of equal chunks the first, by id and place,
stays and the others are removed.

Chunks alone miss most passages that stand between other text. With words set,
the runs of units that just reach that many words (from each unit onwards, and
from each unit back; a unit counts one word at least) are held against each other
like the chunks, but by SHA-256, as they overlap. Every run of whole units with that many words or more is covered
by them from end to end, so it goes wherever it stood before, be it a single long
unit; what is removed has an equal unit at an earlier place that stays.

Defined cases: a null or empty text has no chunk and comes back as it was (null
stays null); a text may become empty. Repeated ids: a row is known by its id and
the hash of its text, so rows of one id with other texts are other documents, and
the one with the smaller hash comes first; rows of one id and text are copies of
one another and treated alike, so the first chunk stays in all of them. Rows with
a null id are returned untouched. Other columns pass through; names starting with
two underscores are reserved. No rows, no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_BYTES, Written, by_frequent_key, scratch

#: A line with its end; a sentence with its blank, in lines of over so many characters.
LINE, SENTENCE, LONG_LINE = r"[^\n]*\n|[^\n]+", r"(?s).+?(?:[.!?] |\z)", 200
MIN_UNITS = 2

#: What tells rows apart: the id and the hash of the text.
_ROW = ["id", "key"]


def units_of(text: Column, long_line: int = LONG_LINE) -> Column:
    lines = F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > long_line, F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(0))).otherwise(F.array(x))))


def unit_hash(unit: Column) -> Column:
    """The first 32 bits of the MD5 of a unit, as a long."""
    return F.conv(F.md5(F.encode(unit, "UTF-8")).substr(1, 8), 16, 10).cast("long")


def _boundaries(units: Column) -> Column:
    """Indices of the units that end a chunk, but for the last."""
    hashes = F.transform(units, unit_hash)

    def rolled(h: Column) -> Column:
        return F.transform(h, lambda x, i: (x * 31 + F.when(i > 0, F.get(h, i - 1)).otherwise(0) * 17) % 1_000_003)

    def peaks(r: Column) -> Column:
        flags = F.transform(
            r, lambda x, i: F.when((i > 0) & (i < F.size(r) - 1) & (x > F.get(r, i - 1)) & (x > F.get(r, i + 1)), i).otherwise(-1)
        )
        return F.filter(flags, lambda i: i >= 0)

    # Each array is bound to a name once, else the lambdas would make it anew for each element.
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return bound(hashes, lambda h: bound(rolled(h), peaks))


def _packed(first: Column, n: Column) -> Column:
    """A span of units as one long, as sets of longs are hashed and sets of structs are not."""
    return F.shiftleft(first.cast("long"), 32) + n


def _passages(units: Column, words: int) -> Column:
    """Packed spans of the runs that just reach that many words, onwards and back from each unit."""
    levels = words.bit_length()
    steps = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(2**k).alias("size")) for k in reversed(range(levels))))

    def run(table: Column, at: Column, back: bool) -> Column:
        """How many units from there stay under that many words."""

        def step(acc: Column, k: Column) -> Column:
            size = k["size"]
            start = at - acc["n"] - size + 1 if back else at + acc["n"]
            total = acc["words"] + F.get(F.get(table, k["level"]), start)
            take = F.coalesce(total < words, F.lit(False))
            return F.struct(F.when(take, acc["n"] + size).otherwise(acc["n"]).alias("n"), F.when(take, total).otherwise(acc["words"]).alias("words"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), step, lambda acc: acc["n"])

    def spans(table: Column) -> Column:
        counts = F.get(table, F.lit(0))
        on = F.transform(counts, lambda _, i: _packed(i, run(table, i, False) + 1))
        back = F.transform(counts, lambda _, i: F.get(F.transform(F.array(run(table, i, True)), lambda n: _packed(i - n, n + 1)), F.lit(0)))
        inside = lambda s: (s >= 0) & (F.shiftright(s, 32) + s.bitwiseAND(F.lit(0xFFFFFFFF)) <= F.size(counts))
        return F.array_union(F.filter(on, inside), F.filter(back, inside))

    # Each level is bound to a name once, as in _boundaries.
    def build(table: Column, level: int) -> Column:
        if level == levels:
            return spans(table)
        top = lambda t: F.get(t, F.lit(level - 1))
        more = lambda t: F.concat(t, F.array(F.transform(top(t), lambda x, i: x + F.get(top(t), i + 2 ** (level - 1)))))
        return F.get(F.transform(F.array(more(table)), lambda t: build(t, level + 1)), F.lit(0))

    counts = F.transform(units, lambda u: F.greatest(F.lit(1), F.regexp_count(u, F.lit(r"\S+"))))
    return F.get(F.transform(F.array(F.array(counts)), lambda t: build(t, 1)), F.lit(0))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, t) of the rows that may lose chunks."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id IS NOT NULL AND t <> ''")
    return df.select("id", F.xxhash64("t").alias("key"), "t")


def chunks(docs: DataFrame, id_col: str, text_col: str, words: int | None = None, long_line: int = LONG_LINE, digest: bool = False) -> DataFrame:
    """(id, key, first, n, hash) of the chunks of MIN_UNITS units or more and, with words, of the runs that just reach them.

    With digest also the SHA-256 of the bytes.
    """
    df = _rows(docs, id_col, text_col).select(*_ROW, units_of(F.col("t"), long_line).alias("u"))
    df = df.withColumn("b", _boundaries(F.col("u")))
    ends = F.concat("b", F.array(F.size("u") - 1))
    df = df.withColumn("e", ends)
    spans = F.transform(
        "e", lambda e, i: F.struct(F.when(i > 0, F.get("e", i - 1) + 1).otherwise(0).alias("first"), e.alias("last"))
    )
    spans = F.filter(spans, lambda s: s["last"] - s["first"] + 1 >= MIN_UNITS)
    spans = F.transform(spans, lambda s: _packed(s["first"], s["last"] - s["first"] + 1))
    if words:
        spans = F.array_union(spans, _passages(F.col("u"), words))
    first, n = (lambda s: F.shiftright(s, 32).cast("int")), (lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))

    def row(s: Column) -> Column:
        units = F.slice("u", first(s) + 1, n(s))
        own = [F.unhex(F.sha2(F.array_join(units, ""), 256)).alias("digest")] if digest else []
        return F.struct(first(s).alias("first"), n(s).alias("n"), F.xxhash64(units).alias("hash"), *own)

    return df.select(*_ROW, F.inline(F.transform(spans, row)))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_line: int = LONG_LINE) -> DataFrame:
    """(id, key, first, n) of the chunks to remove: equal, byte for byte, to an earlier one. key: the text's xxHash64."""
    found = Written(chunks(docs, id_col, text_col, long_line=long_line), "chunks")
    often = Written(found.df.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    if often.bytes() <= BROADCAST_BYTES:
        twice = found.df.join(F.broadcast(often.df.drop("c")), "hash")
    else:
        twice = by_frequent_key(found.df, often.df, "hash", "c", found.df.count())
    lists = twice.groupBy(*_ROW).agg(F.collect_set(F.struct("first", "n", "hash")).alias("cands"))
    lists = Written(lists, "candidates")
    texts = _rows(docs, id_col, text_col).join(lists.sized(), _ROW).select(*_ROW, units_of(F.col("t"), long_line).alias("u"), "cands")
    chunk = lambda c: F.array_join(F.slice("u", c["first"] + 1, c["n"]), "")
    texts = texts.select(*_ROW, F.inline(F.transform("cands", lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), c["hash"].alias("hash"), chunk(c).alias("chunk")))))
    # Grouped by the bytes themselves: partial sums first, so that a common chunk crosses the network once a task.
    kept = texts.groupBy("hash", "chunk").agg(F.min(F.struct(*_ROW, "first", "n")).alias("k")).select("k.*")
    every = lists.df.select(*_ROW, F.inline("cands")).select(*_ROW, "first", "n")
    return every.join(kept, [*_ROW, "first", "n"], "left_anti")


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, words: int, long_line: int) -> DataFrame:
    """(id, key, first, n) of the chunks and of the runs of that many words to remove: equal to an earlier one.

    Runs overlap, so their bytes would be many times the text: here they are told
    apart by hash and SHA-256. Two scans instead of a table of all runs: the first
    counts hashes, the second keeps the runs whose hash is frequent, by a broadcast
    while those hashes are few; a run that stands alone is its own first in any case.
    """
    hashes = chunks(docs, id_col, text_col, words, long_line).select("hash")
    often = Written(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash"), "often")
    runs = chunks(docs, id_col, text_col, words, long_line, digest=True)
    if often.bytes() <= BROADCAST_BYTES:
        runs = runs.join(F.broadcast(often.df), "hash", "left_semi")
    runs = Written(runs, "runs").df
    kept = runs.groupBy("hash", "digest").agg(F.min(F.struct(*_ROW, "first", "n")).alias("k")).select("k.*")
    return runs.select(*_ROW, "first", "n").join(kept, [*_ROW, "first", "n"], "left_anti")


def _merged(spans: Column) -> Column:
    """Sorted spans (first, n) that may overlap, as spans that do not."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["n"], s["first"] + s["n"] - last["first"]).alias("n"))
        touch = F.coalesce(s["first"] <= last["first"] + last["n"], F.lit(False))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, long_line: int = LONG_LINE) -> DataFrame:
    """docs with repeated chunks taken out of the text, and repeated passages of at least so many words; all columns stay."""
    with scratch() as keep:
        found = repeated_passages(docs, id_col, text_col, words, long_line) if words else repeated_chunks(docs, id_col, text_col, long_line)
        gone = found.groupBy(*_ROW).agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("__gone"))
        gone = Written(gone.select(F.col("id").alias("__id"), F.col("key").alias("__key"), _merged(F.col("__gone")).alias("__gone")), "gone")
        keep(gone)
    same = (docs[id_col].cast("long") == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key"))
    df = docs.join(gone.sized(), same, "left")

    def rest(units: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda g: g["first"] + g["n"]))
        ends = F.concat(F.transform("__gone", lambda g: g["first"]), F.array(F.size(units)))
        parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda p: F.slice(units, p["a"] + 1, p["z"] - p["a"]))
        return F.array_join(F.flatten(parts), "")

    new = F.get(F.transform(F.array(units_of(F.col(text_col), long_line)), rest), F.lit(0))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(new)
    return df.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    """The digest of each text left, its length and the characters removed."""
    out = remove_repeats(docs.select("doc_id", "text", F.length("text").cast("long").alias("before")))
    left = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", F.length(left).cast("long").alias("n_chars"), (F.coalesce("before", F.lit(0)) - F.length(left)).alias("n_removed"),
        F.sha2(left, 256).alias("text_sha256"),
    )


def oracle_sql() -> str:
    num = lambda s, n: f"('0x' || substr(md5({s}), 1, {n}))::BIGINT"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, flatten([CASE WHEN length(l) > {LONG_LINE} THEN regexp_extract_all(l, '{SENTENCE}') ELSE [l] END FOR l IN regexp_extract_all(coalesce(text, ''), '{LINE}')]) AS u FROM documents),
    x AS (SELECT doc_id, i, u[i] AS s, {num("u[i]", 8)} AS h FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM d)),
    r AS (SELECT *, (h * 31 + coalesce(lag(h) OVER w, 0) * 17) % 1000003 AS r FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    b AS (SELECT *, coalesce(r > lag(r) OVER w AND r > lead(r) OVER w, false)::INT AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b),
    k AS (SELECT doc_id, c, min(i) AS first, count(*) AS n, string_agg(s, '' ORDER BY i) AS chunk FROM c GROUP BY doc_id, c),
    m AS (SELECT *, n >= {MIN_UNITS} AND row_number() OVER (PARTITION BY n >= {MIN_UNITS}, chunk ORDER BY doc_id, first) > 1 AS gone FROM k),
    o AS (SELECT doc_id, coalesce(string_agg(chunk, '' ORDER BY c) FILTER (NOT gone), '') AS t FROM m GROUP BY doc_id)
    SELECT d.doc_id, length(coalesce(o.t, '')) AS n_chars, length(d.t) - length(coalesce(o.t, '')) AS n_removed, sha256(coalesce(o.t, '')) AS text_sha256
    FROM d LEFT JOIN o ON o.doc_id = d.doc_id"""
