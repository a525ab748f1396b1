"""SentencePiece BPE by a prefix table of last tokens, and its decoding.

For each prefix of a segment there is just one token that can end its encoding:
of the pieces that an automaton finds to end there, the one that is compatible
with the last token of what is left before it. The table of these tokens is
filled from left to right; ids are then read off backwards. Two tokens are
compatible if merging their joint text gives back just the two.

No piece has the blank mark after another character, so a text falls into
segments, a mark and a word, that are encoded apart and kept in a bounded table.
Runs of marks are merged from the left, after all else, as their scores ask.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to an empty text. Characters without a piece become their UTF-8 bytes' pieces.
Rows that repeat an id are all returned; only the named columns are read.
"""
from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import strings, worker_state

MARK = "▁"
#: Entries of the tables of segments and of pairs at most; a full table is emptied.
SEGMENTS, PAIRS = 120_000, 1 << 20
#: Segments encoded at once, and characters beyond which a segment is encoded alone.
AT_ONCE, LONG = 20_000, 64
#: Texts whose words are learnt together, and texts whose ids are put out together.
SLICE, OUT = 300, 100


class Table:
    """Unsigned 64-bit keys to values of at least 0, looked up many at a time; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.down, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        at = self.slot(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.values[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.last

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            value = self.values[at]
            hit = (self.keys[at] == keys) & (value >= 0)
            out[todo[hit]] = value[hit]
            more = ~hit & (value >= 0)
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & self.last
        return out


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if not (plain and norm.escape_whitespaces and train.byte_fallback and not train.treat_whitespace_as_suffix and train.model_type == 2):
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.text = [p.piece for p in proto.pieces]
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in self.id):
            raise ValueError("a piece has a blank mark after another character")
        self.mark = self.id[MARK]
        found = ahocorasick.Automaton()
        whole = []
        for p, i in self.id.items():
            if p[:2] != MARK * 2 and self.merge(p) == [p]:
                found.add_word(p, (i, len(p)))
                whole.append((p, i))
        found.make_automaton()
        self.prepare(whole)
        self.matches = found.iter
        self.segments: dict[str, tuple] = {}
        self.decimal = [str(i) for i in range(len(self.text))]
        self.plain = [p.replace(MARK, " ") for p in self.text]
        self.anchor = next(i for p, i in self.id.items() if len(p) == 1 and p.isascii() and p.isalpha())
        self.runs: dict[int, list[int]] = {0: []}

    def merge(self, s: str, stop: bool = False) -> list[str]:
        """Merges by score, then from the left: what defines the encoding. stop: but for the merge that would end it."""
        parts: list[str | None] = list(s)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score, heap = self.score.get, []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (v := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-v, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            if stop and a + b == s:
                return [a, b]
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in parts if p is not None]

    def prepare(self, whole: list[tuple[str, int]]) -> None:
        """Tables for many segments at once: a trie, how tokens were merged, and which pairs merge."""
        order = sorted((i for p, i in whole if len(p) > 1), key=lambda i: -self.score[self.text[i]])
        self.rank = np.zeros(len(self.text), np.int64)
        self.rank[order] = np.arange(1, len(order) + 1)
        self.left = np.full(len(self.text), -1, np.int64)
        self.right = np.full(len(self.text), -1, np.int64)
        ids = dict(whole)
        merged: dict[int, int] = {}
        trie: dict[tuple[int, int], int] = {}
        token = [-1]
        for p, i in whole:
            for k in range(1, len(p)):
                if (x := ids.get(p[:k])) is not None and (y := ids.get(p[k:])) is not None:
                    merged[x << 32 | y] = i
            if len(p) > 1:
                x, y = self.merge(p, stop=True)
                self.left[i], self.right[i] = ids[x], ids[y]
            node = 0
            for c in p:
                node = trie.setdefault((node, ord(c)), len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.token = np.array(token, np.int32)
        self.longest = max(len(p) for p, _ in whole)
        self.trie = Table(np.array([n << 21 | c for n, c in trie], np.uint64), np.array(list(trie.values())))
        self.merged = Table(np.array(list(merged), np.uint64), np.array(list(merged.values())))
        self.pair_keys = np.full(PAIRS, np.iinfo(np.uint64).max, np.uint64)
        self.pair_fits = np.zeros(PAIRS, bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of tokens stay apart: their merges are undone, latest first, and none across may come sooner."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (PAIRS - 1)
        fits = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            x, y = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
            good, todo = np.ones(len(pairs), bool), np.arange(len(pairs))
            limit = np.full(len(pairs), np.iinfo(np.int64).max)
            while len(todo):
                over = self.merged.get(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
                bad = (over >= 0) & (self.rank[over] < limit)
                good[todo[bad]] = False
                of_x = (self.left[x] >= 0) & ((self.left[y] < 0) | (self.rank[x] > self.rank[y]))
                more = ~bad & (of_x | (self.left[y] >= 0))
                todo, x, y, of_x = todo[more], x[more], y[more], of_x[more]
                limit = np.where(of_x, self.rank[x], self.rank[y] + 1)
                x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
            fits[new] = good[back]
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = key[new], fits[new]
        return fits

    def segment(self, s: str) -> list[int]:
        """The ids of a text with at most one mark, at its start; automaton matches give the candidates."""
        n = len(s)
        last = [-1] * (n + 1)  # by prefix: its last token; -1: a character without a piece
        size = [1] * (n + 1)
        for end, (token, length) in self.matches(s):
            end += 1
            before = last[end - length] if end > length else -1
            if before >= 0 and not self.compatible(np.array([before]), np.array([token]))[0]:
                continue
            last[end], size[end] = token, length
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            else:
                out += [self.byte[b] for b in reversed(s[n - 1].encode())]
            n -= size[n]
        out.reverse()
        return out

    def fill(self, words: list[str]) -> None:
        """Encodes the words, each after a mark, with one prefix table for all of them."""
        alone = [w for w in words if len(w) >= LONG]
        words = sorted((w for w in words if len(w) < LONG), key=len, reverse=True)
        for w in alone:
            self.known(w)
        if not words:
            return
        chars = np.frombuffer(MARK.join(["", *words]).encode("utf-32-le"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64) + 1
        begin = np.cumsum(sizes) - sizes
        room = np.repeat(begin + sizes, sizes) - np.arange(len(chars))  # characters from here to the segment's end
        match = np.full((self.longest, len(chars)), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for d in range(self.longest):
            live = room[at] > d
            at, node = at[live], node[live]
            node = self.trie.get(node << np.uint64(21) | chars[at + d])
            at, node = at[node >= 0], node[node >= 0]
            match[d, at] = self.token[node]
            node = node.astype(np.uint64)
        last, size = np.full(len(chars), -1, np.int32), np.ones(len(chars), np.int64)
        for end in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -end, "right"))  # segments are in order of falling size
            stop = begin[:live] + end
            for length in range(1, min(end, self.longest) + 1):
                token = match[length - 1, stop - length]
                cand = np.flatnonzero(token >= 0)
                if not len(cand):
                    continue
                if length < end:
                    before = last[stop[cand] - length - 1]
                    fits = before < 0
                    test = np.flatnonzero(~fits)
                    fits[test] = self.compatible(before[test], token[cand[test]])
                    cand = cand[fits]
                last[stop[cand] - 1], size[stop[cand] - 1] = token[cand], length
        of, where, step = np.arange(len(words)), begin + sizes - 1, 0
        found = []
        odd = np.zeros(len(words), bool)
        while len(of):
            token = last[where]
            odd[of[token < 0]] = True
            found.append((of, np.full(len(of), step), token, where))
            where = where - size[where]
            more = where >= begin[of]
            of, where, step = of[more], where[more], step + 1
        of, steps, tokens, wheres = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-steps, of))
        ends = np.cumsum(np.bincount(of, minlength=len(words))).tolist()
        raw = tokens[order].astype("<i4").tobytes()
        tokens, wheres = tokens[order].tolist(), wheres[order].tolist()
        decimal, plain, begin_at = self.decimal, self.plain, 0
        for w, strange, end in zip(words, odd.tolist(), ends, strict=True):
            if strange:
                ids = []
                for token, place in zip(tokens[begin_at:end], wheres[begin_at:end], strict=True):
                    ids += [token] if token >= 0 else [self.byte[b] for b in chr(int(chars[place])).encode()]
                self.segments[w] = self.entry(ids)
            else:
                ids = tokens[begin_at:end]
                self.segments[w] = raw[4 * begin_at : 4 * end], ",".join([decimal[i] for i in ids]), "".join([plain[i] for i in ids])
            begin_at = end

    def learn(self, texts: list[str]) -> None:
        """Sees to it that the words of the texts are known, as far as the table's bound allows."""
        words = {w for t in texts if t for w in t.replace(MARK, " ").split(" ")}
        new = [w for w in words if w not in self.segments and w]
        if len(new) + len(self.segments) > SEGMENTS:
            self.segments.clear()
            new = [w for w in words if w][:SEGMENTS]
        for at in range(0, len(new), AT_ONCE):
            self.fill(new[at : at + AT_ONCE])

    def run(self, n: int) -> list[int]:
        """The ids of n marks."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs = {0: []}
            self.runs[n] = [self.id[p] for p in self.merge(MARK * n)]
        return self.runs[n]

    def known(self, word: str) -> tuple:
        """(ids as 32-bit integers, ids in decimal, decoded text) of a mark and the word."""
        got = self.segments.get(word)
        if got is None:
            if len(self.segments) >= SEGMENTS:
                self.segments.clear()
            got = self.entry(self.segment(MARK + word))
            if len(word) <= 4 * LONG:
                self.segments[word] = got
        return got

    def entry(self, ids: list[int]) -> tuple:
        return np.array(ids, "<i4").tobytes(), ",".join(map(str, ids)), self.lib.decode([self.anchor, *ids])[1:]

    def parts(self, text: str) -> list[tuple]:
        """The entries that follow one another in the encoding of the text."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        known = self.known
        if "" not in words:
            return [known(w) for w in words]
        out, blank = [], 0
        for w in words:
            if not w:
                blank += 1
                continue
            e = known(w)
            if blank:
                ids = np.frombuffer(e[0], "<i4").tolist()
                if ids[0] == self.mark:  # the word's own mark stays free and joins the run
                    out.append(self.entry(self.run(blank + 1)))
                    e = self.entry(ids[1:])
                else:
                    out.append(self.entry(self.run(blank)))
                blank = 0
            out.append(e)
        if blank:
            out.append(self.entry(self.run(blank)))
        return out

    def encode(self, text: str) -> list[int]:
        self.learn([text])
        return np.frombuffer(b"".join([e[0] for e in self.parts(text)]), "<i4").tolist()


def entries(m: PieceModel, texts: list[str]):
    """(text, its entries), learning the words of SLICE texts at a time."""
    for at in range(0, len(texts), SLICE):
        part = texts[at : at + SLICE]
        m.learn(part)
        for t in part:
            yield t, m.parts(t)


def model(path: str) -> PieceModel:
    return worker_state(f"pieces:{path}", lambda: PieceModel(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of each text and the text that they decode to."""

    def run(batches):
        m = model(path)
        for b in batches:
            for at in range(0, b.num_rows, OUT):  # what comes out is held for OUT texts at a time
                part = b.slice(at, OUT)
                ids, back = [], []
                for _, parts in entries(m, strings(part.column(1))):
                    ids.append(b"".join([e[0] for e in parts]))
                    back.append("".join([e[2] for e in parts])[1:])
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(back, pa.string())], names=["id", "ids", "decoded"])

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(run, "id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of lists of ids; null counts as empty."""

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [m.lib.decode(ids) if ids else "" for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    df = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return df.mapInArrow(run, "id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without moving ids or texts."""

    def run(batches):
        m = model(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, ids, back = [], [], []
            for _, parts in entries(m, strings(b.column(1))):
                n.append(sum(len(e[0]) for e in parts) // 4)
                ids.append(sha(",".join(e[1] for e in parts if e[1])))
                back.append(sha("".join(e[2] for e in parts)[1:]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return df.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
