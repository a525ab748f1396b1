"""Near duplicates by SimHash, verified: groups of texts of a Jaccard similarity.

Fingerprints of 128 bits are made of a text's shingles and embedded as the bit
counts of 64 two-bit segments, whose Manhattan distance never exceeds the Hamming
distance. The grid is laid over choices of segments: texts with the same counts
in all segments of a choice share a cell, and points of a cell are held against
each other by Manhattan distance, then by Hamming distance. How many segments a
choice has follows the number of texts, LEAST at least, so that a cell holds some
CELL of unrelated ones at most; how many choices there are follows from that and
from how often texts of just the wanted similarity agree in a segment, so that
such a pair shares a cell with probability RECALL at least, whatever the size of
the table. Candidates are then
verified on the whole texts.

In cells crowded with near points only a forest of links comes out, never all
pairs. Where links fail their check, all points of that group which have other
classes by then are candidates, so no near pair that shares a cell is left out.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Written, by_frequent_key, connected_components, few, parts_of, scratch, strings
from loomgraph.llm.simhash import SLICE, embed

#: Unrelated points of a cell, segments of a choice, points of a cell that are dealt into chunks if there are more, rows
#: worked on at once, and near pairs of a cell that come out as they are, or as many as it has points.
CELL, LEAST, BLOCK, ROWS, FEW = 2048, 8, 4096, 1 << 16, 10
#: Rounds in which only the nearest links are checked.
ROUNDS = 2
#: How surely a pair of just the wanted similarity becomes a candidate, as regards cells and as regards the radius.
RECALL, SIGMAS = 0.9, 2.33
BITS, SEGMENTS = 128, 64
#: How often two unrelated points have the same count in a segment.
CHANCE = 0.375

_FP = ["f0", "f1"]


def fingerprint(words: list[bytes], shingle: int) -> tuple[int, int]:
    """Bit i is set if over half of the shingles' hashes have it set; as two unsigned 64-bit numbers."""
    import xxhash

    if not words:
        return 0, 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams)), np.uint8).reshape(-1, 16)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    a, b = np.packbits(ones * 2 > n).view(np.uint64)
    return int(a), int(b)


def flips(similarity: float) -> float:
    """How often a bit differs between two texts of that Jaccard similarity and like size."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def grid(n: int, similarity: float) -> tuple[np.ndarray, int]:
    """(masks, radius) for n points: a mask over both words of the embedding for each choice of segments."""
    p = flips(similarity)
    same = (1 - p) ** 2 + p * p / 2
    size = max(LEAST, round(math.log(max(1.0, n / CELL)) / math.log(1 / CHANCE)))
    # A pair that disagrees in some number of segments agrees in a choice that has none of them.
    agree = [math.comb(SEGMENTS - u, size) / math.comb(SEGMENTS, size) for u in range(SEGMENTS + 1)]
    often = [math.comb(SEGMENTS, u) * (1 - same) ** u * same ** (SEGMENTS - u) for u in range(SEGMENTS + 1)]
    choices = 1
    while sum(w * (1 - (1 - q) ** choices) for w, q in zip(often, agree, strict=True)) < RECALL:
        choices += 1 + choices // 20
    rng = np.random.default_rng(size)
    masks = np.zeros((choices, 2), np.uint64)
    for k in range(choices):
        for s in rng.choice(SEGMENTS, size, replace=False).tolist():
            masks[k, s // 32] |= np.uint64(3 << (2 * (s % 32)))
    return masks, math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _forest(x: np.ndarray, e: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between rows of x that join all that are joined by steps of at most radius: under len(x) of them."""
    left, links = np.arange(len(x)), []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _distance(e[left], e[at][None, :]) <= radius
            near[near] = _distance(x[left[near]], x[at][None, :]) <= radius
            hit = left[near].tolist()
            links += [(at, h) for h in hit]
            frontier += hit
            left = left[~near]
    return links


def _pairs(key, kind, x, label, chunk, own, masks, radius, every):
    """Near pairs (i, j) within runs of equal keys. every: all of those with different labels, else a forest where a cell is crowded."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    of = np.repeat(np.arange(len(starts)), sizes)
    after = (starts + sizes)[of] - np.arange(len(key))  # rows of the cell from each row on
    e = np.stack([embed(x[:, 0]), embed(x[:, 1])], axis=1)
    count, most = np.zeros(len(starts), np.int64), np.maximum(FEW, sizes)
    found, live, s = [], np.arange(len(key)), 0
    while True:
        s += 1
        live = live[after[live] > s]
        if not every:
            live = live[count[of[live]] <= most[of[live]]]
        if not len(live):
            break
        i, j = live, live + s
        ok = own[i] | (chunk[i] != chunk[j])
        if every:
            ok &= label[i] != label[j]
        i, j = i[ok], j[ok]
        ok = _distance(e[i], e[j]) <= radius
        i, j = i[ok], j[ok]
        ok = _distance(x[i], x[j]) <= radius
        i, j = i[ok], j[ok]
        if len(i):
            np.add.at(count, of[i], 1)
            # Each pair comes out of the first choice of segments that it agrees in.
            diff, first = e[i] ^ e[j], np.ones(len(i), bool)
            for k in range(int(kind[i].max())):
                first &= (kind[i] <= k) | ((diff & masks[k]) != 0).any(axis=1)
            found.append((i[first], j[first]))
    i, j = (np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else ((), ())))
    if not every:
        crowded = count > most
        ok = ~crowded[of[i]] if len(i) else np.empty(0, bool)
        i, j = i[ok], j[ok]
        for c in np.flatnonzero(crowded).tolist():
            a, z = starts[c], starts[c] + sizes[c]
            links = np.array(_forest(x[a:z], e[a:z], radius), np.int64).reshape(-1, 2) + a
            i, j = np.r_[i, links[:, 0]], np.r_[j, links[:, 1]]
    return i, j, _distance(x[i], x[j])


def candidates(points: DataFrame, masks: np.ndarray, radius: int, every: bool = False) -> DataFrame:
    """(a, b, bits): near points (node, f0, f1) that share a cell; with every, all pairs of points of different label."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixes = np.random.default_rng(1).integers(1, 1 << 63, (len(masks), 1), np.uint64) | np.uint64(1)

    def cells(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                f = [part.column(k).to_numpy().view(np.uint64) for k in (1, 2)]
                with np.errstate(over="ignore"):
                    x, y = ((embed(f[k])[:, None] & masks[None, :, k]) for k in (0, 1))
                    key = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (y ^ (y >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    key = (key ^ (key >> np.uint64(32))) * mixes.T
                    key ^= key >> np.uint64(29)
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(masks)))
                kinds = np.tile(np.arange(len(masks), dtype=np.int16), part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(kinds), *(c.take(rows) for c in part.columns)], names=["cell", "kind", "node", *_FP, "label"]
                )

    def run(batches):
        def flush(c):
            x = np.stack([c[3].view(np.uint64), c[4].view(np.uint64)], axis=1)
            i, j, bits = _pairs(c[0], c[1], x, c[5], c[6], c[7], masks, radius, every)
            a, b = c[2][i], c[2][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits.astype(np.int32))], names=["a", "b", "bits"])

        kept, size = [], 0
        for b in batches:
            kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= ROWS:
                every_ = [np.concatenate(c) for c in zip(*kept, strict=True)]
                last = int(np.searchsorted(every_[0], every_[0][-1]))
                if last:
                    yield flush([c[:last] for c in every_])
                kept = [[c[last:] for c in every_]]
                size = len(kept[0][0])
        if size:
            yield flush([np.concatenate(c) for c in zip(*kept, strict=True)])

    points = points.select("node", *_FP, (F.col("label") if "label" in points.columns else F.lit(0).cast("long")).alias("label"))
    dealt = points.mapInArrow(cells, "cell long, kind short, node long, f0 long, f1 long, label long")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    if every:  # cells of one class have nothing to say
        wanted = Written(sizes.where("low <> high").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "cells")
        dealt = dealt.join(wanted.sized(), "cell")
    else:
        full = Written(sizes.where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "cells")
        dealt = dealt.withColumn("chunks", F.lit(1)) if full.df.isEmpty() else dealt.join(full.sized(), "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    # A cell of several chunks: each pair of chunks meets by itself, rows of one chunk where it meets itself.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    split = F.xxhash64("cell", F.least("chunk", "other"), F.greatest("chunk", "other"))
    dealt = dealt.withColumn("key", F.when(F.col("chunks") > 1, split).otherwise(F.col("cell")))
    dealt = dealt.select("key", "kind", "node", *_FP, "label", "chunk", (F.col("chunk") == F.col("other")).alias("own"))
    met = dealt.repartition(parts, "key").sortWithinPartitions("key", *_FP, "node")
    return met.mapInArrow(run, "a long, b long, bits int").where("a <> b")


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The different shingles of a text as sorted hashes; fewer words: the whole sequence is the one shingle."""
    import xxhash

    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) between texts of that similarity at least. sets: id, h."""

    def run(batches):
        for batch in batches:
            good = [
                jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    total, held = edges.count(), edges
    for end in "ab":
        degree = edges.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        of_end = sets.join(degree, F.col("id") == F.col(end)).select(end, F.col("h").alias(f"h{end}"), "n")
        held = by_frequent_key(held, of_end, end, "n", total)
    return held.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long").distinct()


def _nearest(edges: DataFrame) -> DataFrame:
    """(a, b): the link of each end with the fewest bits."""
    both = edges.select("a", "b", "bits").union(edges.select("b", "a", "bits"))
    best = both.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("x"), F.greatest("a", "best.b").alias("b")).distinct().toDF("a", "b")


def _apart(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges whose ends lie in different components ca and cb; an end without one is its own."""
    for end in "ab":
        edges = edges.join(label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return edges.withColumns({f"c{end}": F.coalesce(f"c{end}", end) for end in "ab"}).where("ca <> cb")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component): near duplicates whose shingle sets have at least that Jaccard similarity; component: the smallest id of the group.

    First each document's link to its nearest is verified, in a few rounds that
    leave out links within a component, then the candidates that still lie between
    different components, then all pairs of texts of different components in groups
    of candidates where a link failed. Texts of the
    same words are one node; texts without words are alike. Rows that repeat an id
    are one node, linked if any of them is; a null id has no component. An empty
    table gives no rows.
    """
    with scratch() as keep:
        found = _similar(docs, id_col, text_col, shingle, similarity)
        found = Written(found, "similar")
        keep(found)
    return found.df


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    def sketched(batches):
        import xxhash

        for b in parts_of(batches):
            made = []
            for words in map(_words, strings(b.column(1))):
                made.append((*fingerprint(words, shingle), xxhash.xxh64_intdigest(b" ".join(words), 7)))
            made = np.array(made, np.uint64).reshape(-1, 3).view(np.int64)
            fps, keys = made[:, :2], made[:, 2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(keys)], names=["id", *_FP, "key"])

    def hashed(batches):
        for part in parts_of(batches):
            sets = [shingle_set(_words(t), shingle).tobytes() for t in strings(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "h"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    keyed = Written(df.mapInArrow(sketched, "id long, f0 long, f1 long, key long"), "keyed").df
    total = keyed.count()
    # Texts by fingerprint and words; then fingerprints, each with the least id of its texts.
    texts = Written(keyed.groupBy(*_FP, "key").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("copies")), "texts").df
    points = Written(texts.groupBy(*_FP).agg(F.min("root").alias("node"), F.count(F.lit(1)).alias("size")), "points").df
    masks, radius = grid(points.count(), similarity)
    found = candidates(points, masks, radius)
    shared = points.where("size > 1").select(F.struct(*_FP).alias("fp"), "node", "size")
    same = by_frequent_key(texts.select(F.struct(*_FP).alias("fp"), "root"), shared, "fp", "size", total)
    same = same.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(0).alias("bits"))
    edges = Written(found.unionByName(same).groupBy("a", "b").agg(F.min("bits").alias("bits")), "candidates").df
    both = edges.union(edges.select("b", "a", "bits"))
    chosen = Written(both.select(F.col("a").alias("id")).distinct(), "chosen").sized()
    sets = df.join(chosen, "id", "left_semi").mapInArrow(hashed, "id long, h binary")
    sets = Written(sets, "sets").df
    # In a family each link that holds spares others, so a few rounds check each text's nearest link out of its component.
    rows = edges.count()
    tested = good = edges.select("a", "b").limit(0)
    label = None
    for k in range(ROUNDS + 1):
        left = edges
        if k:
            left = _apart(edges.join(tested, ["a", "b"], "left_anti"), label).select("a", "b", "bits")
            left = Written(few(left, rows), "left").df
            if left.isEmpty():
                break
        picked = left.select("a", "b") if k == ROUNDS else _nearest(left)
        picked = Written(few(picked, rows), "picked").df
        good = Written(few(good.union(_verified(picked, sets, similarity)), rows), "good").df
        tested = Written(few(tested.union(picked), rows), "tested").df
        label = connected_components(good)
    # Crowded cells gave a forest, so where one of its links failed the ends' neighbours were perhaps never compared. In a
    # group of candidates that is not one component, each component has a failed link to another.
    label = label.toDF("root", "label")
    failed = _apart(edges, label.toDF("node", "component")).select(F.explode(F.array("ca", "cb")).alias("label")).distinct()
    failed = Written(few(failed, rows), "failed").sized()
    ends = both.select(F.col("a").alias("root")).distinct().join(label, "root", "left").withColumn("label", F.coalesce("label", "root"))
    loose = few(ends, rows).join(failed, "label", "left_semi").join(texts, "root").select(F.col("root").alias("node"), *_FP, "label")
    missed = candidates(Written(loose, "loose").df, masks, radius, every=True).select("a", "b").distinct().join(edges, ["a", "b"], "left_anti")
    label = connected_components(good.union(_verified(Written(missed, "missed").df, sets, similarity)))
    placed = texts.join(label.withColumnRenamed("node", "root"), "root", "left")
    placed = Written(placed.select(F.struct(*_FP, "key").alias("text"), F.coalesce("component", "root").alias("component"), "copies"), "placed").df
    keyed = keyed.select("id", F.struct(*_FP, "key").alias("text"))
    return by_frequent_key(keyed, placed, "text", "copies", total).select("id", "component")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id is the smallest of its group of similar_documents, and those with a null id, with all columns of docs.

    Only the ids that go are joined, by a broadcast while their files are small.
    """
    found = similar_documents(docs, id_col, text_col, **options)
    ids = found.groupBy("id").agg(F.min("component").alias("component")).where("id <> component").select(F.col("id").alias("__gone"))
    with scratch() as keep:
        gone = Written(ids, "gone")
        keep(gone)
    return docs.join(gone.sized(), docs[id_col].cast("long") == F.col("__gone"), "left_anti")
