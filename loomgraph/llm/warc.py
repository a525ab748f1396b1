"""WARC records and a Merkle audit of replicas.

Pages become WARC response records, RECORDS to an archive file, each with its
offset. For an audit each replica's records are hashed, leaf by leaf in order of
offset; every level above hashes FANOUT neighbours, each with its offset range,
up to one root a file. The audit compares the roots and goes down only where
hashes differ: at each level the children of differing nodes are picked from
either replica, by a broadcast while those nodes are few, and only they meet.
All levels are kept as rows (level, file, piece, node, first, last, hash), a
folder a level.

Defined cases: a null payload or url counts as empty; a null id is left out. A
record that one replica lacks differs from any hash; one whose length changed
moves the offsets after it in the file, and all records moved are reported, as
their ranges no longer hold. Records of one offset are hashed in order of their
bytes. Rows that repeat an id are records of their own; where repeats make a
span of ids hold over SPLIT records, it is dealt into further files, its pieces,
by the hash of the record and its place among equal ones. Empty tables: no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Written, scratch

#: Records of a file, and children of a node. Both bound what one task groups.
RECORDS, FANOUT = 256, 8
#: Records of a span of ids beyond which it is dealt into pieces.
SPLIT = 4 * RECORDS

_PLACE = ["file", "piece"]


def _placed(df: DataFrame) -> DataFrame:
    """df(id, url, body) with file and piece. A file holds the ids of one span of RECORDS, so its place does not depend on other files."""
    df = df.withColumn("file", F.floor(F.col("id") / RECORDS))
    full = Written(df.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT), "spans")
    if full.df.isEmpty():
        full.drop()
        return df.withColumn("piece", F.lit(0).cast("long"))
    spans = full.sized()
    # Equal rows are counted, dealt out by blocks of RECORDS, and only then made rows again.
    equal = df.join(spans, "file").groupBy("file", "id", "url", "body", "n").agg(F.count(F.lit(1)).alias("copies"))
    last = F.floor((F.col("copies") - 1) / RECORDS)
    equal = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = F.ceil(F.col("n") / RECORDS)
    equal = equal.withColumn("piece", 1 + F.pmod(F.xxhash64("id", "url", "body", "block"), pieces)).repartition(*_PLACE)
    here = F.least(F.lit(RECORDS).cast("long"), F.col("copies") - F.col("block") * RECORDS)
    equal = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), here)))
    rest = df.join(spans, "file", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    return rest.unionByName(equal.select(*rest.columns))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(file, piece, offset, length, id, record): the bytes of a WARC response record for each page; offsets run within a file and piece."""
    df = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    df = _placed(df.where("id IS NOT NULL"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"), F.col("body"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.col("id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("http").cast("string"), F.lit("\r\n\r\n"),
    )
    df = df.withColumn("http", http)
    df = df.select(*_PLACE, "id", F.encode(F.concat(head, F.col("http"), F.lit("\r\n\r\n")), "UTF-8").alias("record"))
    df = df.select(*_PLACE, F.octet_length("record").cast("long").alias("length"), "id", "record")
    w = Window.partitionBy(*_PLACE).orderBy("id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return df.select(*_PLACE, F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), "length", "id", "record")


def _bound(c: Column, f) -> Column:
    """f of c, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tree(records: DataFrame, levels: int) -> DataFrame:
    """(level, file, piece, node, first, last, hash) of all levels; level 0 has a leaf for each record, by its place.

    Only hashes and ranges are brought together, all those of a file at once.
    """
    leaf = records.select(*_PLACE, "offset", F.sha2("record", 256).alias("hash"), (F.col("offset") + F.col("length")).alias("last"))
    files = leaf.groupBy(*_PLACE).agg(F.array_sort(F.collect_list(F.struct("offset", "hash", "last"))).alias("c"))

    def node(level: int, at: Column, first: Column, last: Column, below: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", first, last, below), 256)
        return F.struct(F.lit(level).alias("level"), at.cast("long").alias("node"), first.alias("first"), last.alias("last"), digest.alias("hash"))

    def parents(level: int, below: Column) -> Column:
        def parent(i: Column) -> Column:
            part = F.slice(below, (i * FANOUT + 1).cast("int"), FANOUT)
            return _bound(part, lambda p: node(level, i, p[0]["first"], F.element_at(p, -1)["last"], F.array_join(F.transform(p, lambda x: x["hash"]), "")))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int")), parent)

    files = files.withColumn("l0", F.transform("c", lambda x, i: node(0, i, x["offset"], x["last"], x["hash"])))
    for level in range(1, levels + 1):
        files = files.withColumn(f"l{level}", parents(level, F.col(f"l{level - 1}")))
    every = F.concat(*(F.col(f"l{k}") for k in range(levels + 1)))
    return files.select(*_PLACE, F.inline(every)).select("level", *_PLACE, "node", "first", "last", "hash")


def differing(a: DataFrame, b: DataFrame, level: int, parents: DataFrame | None = None) -> DataFrame:
    """The nodes of a level whose hashes differ between two trees, with what both say of them; of children of parents only, if given."""
    sides = []
    for t, x in ((a, "a"), (b, "b")):
        side = t.where(F.col("level") == level).select(*_PLACE, "node", F.col("first").alias(f"f{x}"), F.col("last").alias(f"l{x}"), F.col("hash").alias(f"h{x}"))
        if parents is not None:
            side = side.withColumn("up", F.floor(F.col("node") / FANOUT)).join(parents, [*_PLACE, "up"], "left_semi").drop("up")
        sides.append(side)
    return sides[0].join(sides[1], [*_PLACE, "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, piece, node, first, last, seen, reached): the leaves that differ between two sets of records.

    first, last: where a has the record, else where b does; seen: "changed",
    "missing" in b or "extra" in b; reached: comparisons that led to it.
    """
    size = max(x.groupBy(*_PLACE).count().agg(F.max("count")).first()[0] or 0 for x in (a, b))
    levels = 0
    while FANOUT**levels < size:
        levels += 1
    ta, tb = (Written(tree(x, levels), "tree", by="level").df for x in (a, b))
    open_ = differing(ta, tb, levels)
    for level in range(levels - 1, -1, -1):
        above = Written(open_.select(*_PLACE, F.col("node").alias("up")), "open")
        open_ = differing(ta, tb, level, above.sized())
    seen = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    found = open_.select(*_PLACE, "node", F.coalesce("fa", "fb").alias("first"), F.coalesce("la", "lb").alias("last"), seen.alias("seen"), F.lit(levels + 1).alias("reached"))
    return found


def damaged(records: DataFrame, damage: Column) -> DataFrame:
    """A replica in which the last byte of the body of some records has another value: what an audit must find."""
    n = F.octet_length("record")
    changed = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.encode(F.lit("#"), "UTF-8"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    return records.withColumn("record", F.when(damage & (n > 5), changed).otherwise(F.col("record")))


def query(pages: DataFrame) -> DataFrame:
    """Both replicas of all pages; in the second, pages whose id leaves 13 by 97 are damaged, and every fifth file lacks its last record."""
    with scratch() as keep:
        made = Written(records(pages), "records")
        ends = Written(made.df.groupBy(*_PLACE).agg(F.max("id").alias("last_id")).where("file % 5 = 2"), "ends")
        replica = damaged(made.df, F.col("id") % 97 == 13).join(ends.sized(), _PLACE, "left")
        replica = replica.where("last_id IS NULL OR id <> last_id").drop("last_id")
        found = Written(audit(made.df, replica), "found")
        keep(made, found)
    ids = made.df.select(*_PLACE, F.col("offset").alias("first"), "id")
    return ids.join(found.sized(), [*_PLACE, "first"]).select(F.col("id").alias("page_id"), "file", "node", "first", "last", "seen")


def oracle_sql() -> str:
    return rf"""
    WITH h AS (SELECT page_id, coalesce(url, '') AS url, concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=UTF-8', chr(13), chr(10), chr(13), chr(10), coalesce(html, '')) AS http FROM pages),
    r AS (SELECT page_id, page_id // {RECORDS} AS file, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
          'WARC-Target-URI: ', regexp_replace(url, '[\r\n]', ' ', 'g'), chr(13), chr(10), 'Content-Type: application/http;msgtype=response', chr(13), chr(10), 'Content-Length: ', octet_length(encode(http)),
          chr(13), chr(10), chr(13), chr(10), http, chr(13), chr(10), chr(13), chr(10)) AS record FROM h),
    o AS (SELECT page_id, file, record, octet_length(encode(record)) AS length,
                 coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
                 row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS node, max(page_id) OVER (PARTITION BY file) AS last_id FROM r)
    SELECT page_id, file, node, first, first + length AS last,
           CASE WHEN page_id = last_id AND file % 5 = 2 THEN 'missing' ELSE 'changed' END AS seen
    FROM o WHERE (page_id % 97 = 13 AND substr(record, length(record) - 4, 1) <> '#') OR (page_id = last_id AND file % 5 = 2)"""
