"""Nearest neighbours by a forest of random-projection trees, in two levels.

Trees halve their rows at the median of the projection on the line through two of
them. TREES trees are grown on a sample of at most SAMPLE rows, those with the
smallest hash of their id, and every row is filed under its cell in each. A query
walks these trees through one priority queue, nearest branch first, until the
cells seen hold a share REACH of the PROBE sample rows that are nearest to it, so
easy data need few cells and hard data get more. The number of cells grows with
the table until they hold LEAST sample rows; a cell of over HELD rows is dealt
into blocks, so one task never holds more. A block of over LEAF rows is split
again where it lies: trees of its own, down to leaves of LEAF rows, are searched
through one queue until its share of the block's probe rows is seen. Rows of the
leaves seen are scored exactly, and the k best are returned.

Vectors travel once a tree in the precision they came in, queries once a cell.
Nearness is the largest inner product. For the trees, rows get one more
coordinate that gives all the same length, which turns it into nearness.

Defined cases: vectors that are null, zero, or hold null or non-finite values
take no part, nor do those of another length than most rows have, nor null ids.
Fewer than k candidates: all that were found. Ties go to the smaller id. Rows
that repeat an id count as one vector, the smallest of them in the order of
their components. No rows, no rows.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import Written, scratch

#: Rows that the forest is grown on at most; trees; rows of the sample in a cell, at most and, in large tables, at least.
SAMPLE, TREES, CELL, LEAST = 20_000, 2, 640, 32
#: Nearest sample rows of a query that its search looks for, and the share of them that ends it.
PROBE, REACH = 100, 0.96
#: Rows of a cell that one task holds, rows that are scored together, trees of a block of more, and its probe rows and
#: the nearest of these that its search looks for.
HELD, LEAF, INNER, INNER_PROBE, INNER_NEAREST = 1 << 16, 4096, 4, 512, 32

#: A tree is three arrays: normals (nodes, dim), splits, and children (nodes, 2): a node, or -1 - leaf. Arrays alone are
#: broadcast, as classes of this package would have to be importable where they arrive.
Tree = tuple


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    normal, split, child = tree
    at = np.zeros(len(x), np.int64) if len(split) else np.full(len(x), -1)
    live = np.flatnonzero(at >= 0)
    while len(live):
        node = at[live]
        side = np.einsum("ij,ij->i", x[live], normal[node]) >= split[node]
        at[live] = child[node, side.astype(np.int64)]
        live = live[at[live] >= 0]
    return -1 - at


def grow(x: np.ndarray, leaf: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    normals, splits, children, leaves = [], [], [], 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        for _ in range(5 if len(rows) > leaf else 0):
            a, b = rng.choice(rows, 2, replace=False)
            v = x[a] - x[b]
            p = x[rows] @ v
            right = p >= np.median(p)
            if right.all() or not right.any():
                continue
            n = len(splits)
            normals.append(v / np.linalg.norm(v))
            splits.append(float(np.median(p) / np.linalg.norm(v)))
            children.append([0, 0])
            children[n] = [node(rows[~right]), node(rows[right])]
            return n
        leaves += 1
        return -leaves

    node(np.arange(len(x)))
    return np.array(normals).reshape(-1, x.shape[1]), np.array(splits), np.array(children, np.int64).reshape(-1, 2)


def search(trees: list[Tree], q: np.ndarray, wanted: list[dict[int, list[int]]], enough: int) -> tuple[list[tuple[int, int]], set[int]]:
    """(tree, leaf) in the order met, and the probe rows seen. wanted: by tree, the probe rows in each leaf."""
    heap = [(0.0, t, 0 if len(tree[1]) else -1) for t, tree in enumerate(trees)]
    seen: set[int] = set()
    out = []
    while heap and len(seen) < enough:
        far, t, node = heapq.heappop(heap)
        normal, split, child = trees[t]
        while node >= 0:
            gap = float(q @ normal[node]) - split[node]
            side = int(gap >= 0)
            heapq.heappush(heap, (max(far, abs(gap)), t, int(child[node, 1 - side])))
            node = int(child[node, side])
        out.append((t, -1 - node))
        seen.update(wanted[t].get(-1 - node, ()))
    return out, seen


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))]


def probes(in_leaf: list[np.ndarray], rows: list[int]) -> list[dict[int, list[int]]]:
    """By tree, the given rows by the leaf they are in."""
    out: list[dict[int, list[int]]] = [{} for _ in in_leaf]
    for t, leaves in enumerate(in_leaf):
        for j in rows:
            out[t].setdefault(int(leaves[j]), []).append(j)
    return out


class Block:
    """Rows of a cell. Up to leaf of them are scored at once; more are split into leaves by trees of their own."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int, reach: float, k: int):
        order = np.argsort(ids, kind="stable")  # what a search finds does not depend on the order of arrival
        self.ids, self.x, self.reach, self.trees = ids[order], x[order], reach, None
        if len(x) > leaf:
            up = lifted(self.x, float((self.x * self.x).sum(axis=1).max()))
            self.trees = [grow(up, leaf, seed) for seed in range(INNER)]
            self.in_leaf = [leaves_of(t, up) for t in self.trees]
            self.rows = [[np.flatnonzero(x == k) for k in range(int(x.max()) + 1)] for x in self.in_leaf]
            self.probe = np.random.default_rng(0).choice(len(x), min(len(x), max(INNER_PROBE, 8 * k)), replace=False)

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """The rows to score for a query: over k of them, if there are."""
        scores = self.x[self.probe] @ q
        n = min(max(INNER_NEAREST, 2 * k), len(scores))
        near = self.probe[np.argpartition(-scores, n - 1)[:n]]
        found, _ = search(self.trees, np.r_[q, 0.0], probes(self.in_leaf, near.tolist()), int(np.ceil(self.reach * n)))
        return np.unique(np.concatenate([self.rows[t][leaf] for t, leaf in found]))

    def best(self, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the query, id, score) of the k best rows, and ties of the k-th, that score least or more; own ids left out."""
        if self.trees is None:
            return self._of(np.arange(len(q)), np.arange(len(self.x)), q_ids, q, least, k)
        # Rows that bound the k-th score may be in leaves not seen, so that bound does not hold here.
        least = np.full(len(q), -np.inf)
        parts = [self._of(np.array([i]), self.candidates(q[i], k), q_ids, q, least, k) for i in range(len(q))]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _of(self, who: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
        x, of = (self.x, self.ids) if len(rows) == len(self.x) else (self.x[rows], self.ids[rows])
        s = q[who] @ x.T
        s[q_ids[who][:, None] == of[None, :]] = -np.inf
        s[s < least[who][:, None]] = -np.inf
        if s.shape[1] > k:
            s[s < np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None] - 1e-9] = -np.inf
        i, j = np.nonzero(np.isfinite(s))
        return who[i], of[j], (q[who[i]] * x[j]).sum(axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, as float or double."""
    own = vectors.schema[vec_col].dataType
    v = F.col(vec_col) if own in (T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)) else F.col(vec_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & whole)


def _once(rows: DataFrame) -> DataFrame:
    """One row an id. Vectors are shuffled only if some id repeats, and then only those of such ids."""
    twice = Written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    if twice.df.isEmpty():
        return rows
    ids = twice.sized()
    return rows.join(ids, "id", "left_anti").unionByName(rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample: int = SAMPLE,
    trees: int = TREES,
    cell: int = CELL,
    reach: float = REACH,
    held: int = HELD,
    leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each query."""
    with scratch() as keep:
        found = _nearest(vectors, queries, k, id_col, vec_col, sample, trees, cell, reach, held, leaf)
        if found is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        found = Written(found, "nearest")
        keep(found)
        return found.df


def _nearest(vectors, queries, k, id_col, vec_col, sample, trees, cell, reach, held, leaf) -> DataFrame | None:
    spark = vectors.sparkSession
    rows = Written(_once(usable(vectors, id_col, vec_col)), "vectors").df
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    dim, total = size["d"], size["count"]
    rows = rows.where(F.size("v") == dim)
    asked = _once(usable(queries, id_col, vec_col)).where(F.size("v") == dim)
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    s_ids, s = sampled.column("id").to_numpy(), _matrix(sampled.column("v"))
    longest = float((s * s).sum(axis=1).max())
    # As many cells as keep them near half of held rows, within what the sample can tell apart.
    cell = int(max(min(LEAST, cell), min(cell, len(s) * held / 2 // max(total, 1))))
    up = lifted(s, longest)
    grown = [grow(up, cell, seed) for seed in range(trees)]
    in_leaf = [leaves_of(t, up) for t in grown]
    width = max(int(x.max()) for x in in_leaf) + 1
    sent = spark.sparkContext.broadcast((s_ids, s, grown, in_leaf))
    vector = rows.schema["v"].dataType

    def file(batches):
        """A row for each tree: the row's cell in it."""
        _, _, grown, _ = sent.value
        for b in batches:
            x = lifted(_matrix(b.column(1)), longest)
            cells = np.concatenate([leaves_of(t, x) + n * width for n, t in enumerate(grown)])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c] * len(grown)) for c in b.columns] + [pa.array(cells.astype(np.int32))], names=["id", "v", "cell"])

    filed = rows.select("id", "v").mapInArrow(file, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", vector), T.StructField("cell", T.IntegerType())]))
    # One row a cell, as many as the forest has: rows in it, hence blocks.
    counts = filed.groupBy("cell").count().collect()
    blocks = np.ones(width * trees, np.int64)
    for r in counts:
        blocks[r["cell"]] = -(-r["count"] // held)
    most = int(blocks.max()) + 1
    dealt = spark.sparkContext.broadcast(blocks)

    def walk(batches):
        s_ids, s, grown, in_leaf = sent.value
        blocks = dealt.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1))
                scores = q @ s.T
                scores[ids[:, None] == s_ids[None, :]] = -np.inf
                n = min(max(PROBE, 2 * k), len(s_ids))
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                out_least, out_keys = [], []
                for i, row in enumerate(best):
                    row = row[np.isfinite(scores[i, row])]
                    enough = int(np.ceil(reach * n)) if n < len(s_ids) else 1 << 60  # few rows: all cells
                    found, seen = search(grown, np.r_[q[i], 0.0], probes(in_leaf, row.tolist()), enough)
                    # Sample rows in the cells found bound the k-th score there from below, with room for rounding.
                    kept = np.sort(scores[i, list(seen)])[::-1]
                    out_least.append(float(kept[k - 1]) - 1e-9 * (1 + abs(kept[k - 1])) if len(kept) >= k else -np.inf)
                    out_keys.append([(t * width + x) * most + j for t, x in found for j in range(blocks[t * width + x])])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out_least), pa.array(out_keys, pa.list_(pa.int64()))], names=["id", "v", "least", "keys"]
                )

    here = F.get(F.lit([int(n) for n in blocks]), F.col("cell")) if most > 2 else F.lit(1)
    key = F.col("cell").cast("long") * most + F.pmod(F.xxhash64("id"), here.cast("long"))
    items = filed.select("id", "v", F.lit(None).cast("double").alias("least"), key.alias("key"), F.lit(0).alias("kind"))
    walked = asked.select("id", "v").mapInArrow(
        walk, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", vector), T.StructField("least", T.DoubleType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    )
    walked = walked.select("id", "v", "least", F.explode("keys").alias("key"), F.lit(1).alias("kind"))

    def score(batches):
        """Rows of a key in order: the items of its block are held, the queries after them are scored in batches."""
        now, ids, xs, block = None, [], [], None
        for b in batches:
            keys, kinds = b.column(3).to_numpy(), b.column(4).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist(), strict=True):
                if a == z:
                    continue
                part = b.slice(a, z - a)
                if keys[a] != now:
                    now, ids, xs, block = keys[a], [], [], None
                if kinds[a] == 0:
                    ids.append(part.column(0).to_numpy())
                    xs.append(_matrix(part.column(1)))
                    continue
                if not ids:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(xs), leaf, reach, k)
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    q_ids = some.column(0).to_numpy()
                    i, of, value = block.best(q_ids, _matrix(some.column(1)), some.column(2).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(of), pa.array(value)], names=["query_id", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = items.unionByName(walked).repartition(parts, "key").sortWithinPartitions("key", "kind")
    found = found.mapInArrow(score, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
