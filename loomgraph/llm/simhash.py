"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

Each 64-bit fingerprint is cut into 32 segments of two bits; its embedding is
the vector of their bit counts. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints. The 32 axes are dealt into
radius + 3 blocks: if two points are at most radius apart, three blocks or more
are at distance zero, so the points share a cell of the grid over some three
blocks. Points of a cell are held against each other by Manhattan distance,
then by Hamming distance, and a forest of links comes out, never all pairs.

Defined cases: a null or empty text has no words and fingerprint zero; such
documents are linked like any other. Fewer words than a shingle has: the whole
sequence is the one shingle. Repeated shingles count each time; a bit set in
exactly half of them is 0. Rows that repeat an id are all returned. Only the id
and text columns are read, by name; extra columns do not matter. An empty table
gives no rows.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Written, by_frequent_key, connected_components, parts_of, scratch, strings

#: Members of a cell that one task holds at once; larger cells are dealt into blocks of this size.
BLOCK = 4096
#: Shingles whose bits are unpacked at once.
SLICE = 1 << 16
#: Zero blocks that two points within the radius share.
SHARED = 3


def fingerprint(text: str | None, shingle: int) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(b" ".join(words), 42)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((hashed(g, 42) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): a row for each document; fp holds the fingerprint's bits as a long."""

    def run(batches):
        for b in parts_of(batches):
            fps = [fingerprint(t, shingle) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long"
    )


def embed(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in unary: distances of these words are Manhattan distances."""
    low = np.uint64(0x5555555555555555)
    one, up = np.uint64(1), x >> np.uint64(1)
    return ((x | up) & low) | (((x & up) & low) << one)


def cell_masks(radius: int) -> list[int]:
    """A mask of the embedding for each choice of SHARED blocks."""
    blocks = np.array_split(np.arange(32), radius + SHARED)
    masks = [sum(3 << (2 * int(s)) for s in b) for b in blocks]
    return [sum(c) for c in combinations(masks, SHARED)]


def _near(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, radius: int) -> np.ndarray:
    near = np.bitwise_count(ea ^ eb) <= radius
    near[near] = np.bitwise_count((a ^ b)[near]) <= radius
    return near


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of x that are joined by steps of at most radius: under len(x) of them."""
    e = embed(x)
    left, links = np.arange(len(x)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            p = frontier.pop()
            near = _near(np.broadcast_to(x[p], len(left)), x[left], np.broadcast_to(e[p], len(left)), e[left], radius)
            if near.any():
                hit = left[near]
                links += [(int(x[p]), int(x[h])) for h in hit]
                frontier += hit.tolist()
                left = left[~near]
    return links


def _link_cells(cell: np.ndarray, x: np.ndarray, radius: int, small: int = 6) -> list[tuple[int, int]]:
    """Links within each run of equal cells."""
    if len(x) < 2:
        return []
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(x)])
    of = np.repeat(sizes, sizes)
    e, links = embed(x), []
    for s in range(1, small):
        at = np.flatnonzero((cell[s:] == cell[:-s]) & (of[:-s] <= small))
        at = at[_near(x[at], x[at + s], e[at], e[at + s], radius)]
        links += zip(x[at].tolist(), x[at + s].tolist(), strict=True)
    for k in np.flatnonzero(sizes > small):
        links += forest(x[starts[k] : starts[k] + sizes[k]], radius)
    return links


def _out(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    a = np.array(rows, dtype=object).reshape(-1, 4)
    u = lambda c: pa.array(a[:, c].astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [u(0), u(1), u(2), pa.array(a[:, 3].astype(np.int32))], names=["a", "b", "cell", "chunk"]
    )


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that join all that differ in at most radius bits."""
    spark = distinct.sparkSession
    masks = np.array(cell_masks(radius), np.uint64)
    mixes = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for k in range(len(masks))], np.uint64)

    def cells(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 2048):
                part = x[at : at + 2048]
                e = embed(part)[:, None] & masks[None, :]
                with np.errstate(over="ignore"):
                    key = (e ^ (e >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixes[None, :]
                    key ^= key >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))],
                    names=["cell", "fp"],
                )

    def sweep(batches):
        """Over rows in order of cell: links within cells; what a cell has beyond BLOCK also comes out in chunks."""
        cell, x, chunk = np.empty(0, np.int64), np.empty(0, np.uint64), 0
        for b in batches:
            cell = np.concatenate([cell, b.column(0).to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            rows = []
            if last:
                if chunk:
                    end = int(np.searchsorted(cell, cell[0], "right"))
                    rows += [(int(v), 0, int(cell[0]) & 0xFFFFFFFFFFFFFFFF, chunk + 1) for v in x[:end]]
                    chunk = 0
                rows += [(a, c, 0, -1) for a, c in _link_cells(cell[:last], x[:last], radius)]
                cell, x = cell[last:], x[last:]
            while len(x) >= BLOCK:
                chunk += 1
                rows += [(int(v), 0, int(cell[0]) & 0xFFFFFFFFFFFFFFFF, chunk) for v in x[:BLOCK]]
                rows += [(a, c, 0, -1) for a, c in forest(x[:BLOCK], radius)]
                cell, x = cell[BLOCK:], x[BLOCK:]
            if rows:
                yield _out(rows)
        rows = [(a, c, 0, -1) for a, c in _link_cells(cell, x, radius)]
        if chunk:
            rows += [(int(v), 0, int(cell[0]) & 0xFFFFFFFFFFFFFFFF, chunk + 1) for v in x]
        if rows:
            yield _out(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = Written(
        distinct.select("fp")
        .mapInArrow(cells, "cell long, fp long")
        .repartition(parts, "cell")
        .sortWithinPartitions("cell", "fp")
        .mapInArrow(sweep, "a long, b long, cell long, chunk int"),
        "sweep",
    )
    found = swept.df.where("chunk < 0").select("a", "b")
    hot = swept.df.where("chunk > 0").select(F.col("a").alias("fp"), "cell", "chunk")
    if hot.isEmpty():
        return found.distinct()

    # Cells of several chunks: each pair of chunks goes to a task of its own.
    most = hot.groupBy("cell").agg(F.max("chunk").alias("chunks")).where("chunks > 1")
    dealt = hot.join(most, "cell").select(
        "cell", "fp", "chunk", F.explode(F.sequence(F.lit(1), "chunks")).alias("other")
    )
    dealt = dealt.where("chunk <> other").select(
        "fp", F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("pair")
    )

    def pairs(batches):
        key, x = np.empty(0, np.int64), np.empty(0, np.uint64)

        def flush(key, x):
            found = []
            for part in np.split(x, np.flatnonzero(key[1:] != key[:-1]) + 1):
                found += forest(part, radius)
            return _out([(a, c, 0, -1) for a, c in found])

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            x = np.concatenate([x, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) and (last := int(np.searchsorted(key, key[-1]))):
                yield flush(key[:last], x[:last])
                key, x = key[last:], x[last:]
        if len(x):
            yield flush(key, x)

    more = (
        dealt.select("pair", "fp")
        .repartition(parts, "pair")
        .sortWithinPartitions("pair", "fp")
        .mapInArrow(pairs, "a long, b long, cell long, chunk int")
    )
    return found.union(more.select("a", "b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most radius bits."""
    with scratch() as keep:
        fps = Written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
        total = fps.df.count()
        distinct = Written(fps.df.groupBy("fp").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("copies")), "distinct").df
        found = connected_components(links(distinct, radius))
        member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "root", "copies", F.coalesce("component", "fp").alias("class")
        )
        # A class of many fingerprints: its smallest id by partial sums, then back to its members.
        member = Written(member, "classes").df
        lows = Written(member.groupBy("class").agg(F.min("root").alias("component"), F.count(F.lit(1)).alias("size")), "lows").df
        placed = Written(by_frequent_key(member, lows, "class", "size", total).select("fp", "component", "copies"), "placed")
        keep(fps, placed)
    return by_frequent_key(fps.df, placed.df, "fp", "copies", total).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents whose id is the smallest of its group, with all columns of docs."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    kept = found.where("id = component").select(F.col("id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col] == kept["__kept"], "left_semi")
