"""Token ids in a static range-ANS file format.

A file holds the documents of one range of ids in ascending order: their ids and
lengths, one frequency table for all its blocks, and the blocks. Each block of
BLOCK tokens is coded by LANES interleaved coders that share a stream of 32-bit
words; every CHECKPOINT steps the coders' states, the place in the stream and a
CRC-32 of the tokens that follow are kept, so that all parts decode at once.
Files are made as rows of a Parquet table in the shared folder: Spark's committer
makes each of them appear once, whatever tasks are lost or run again.
export_files writes them out as files of their own, import_files opens such.

Defined cases: a null text counts as empty, so its document is the end id alone;
documents that repeat an id follow one another and are all returned; those with
a null id come first and keep it; an empty table gives no files and no rows.
Only the named columns are read. A checksum that does not hold raises
ValueError, as does a tokenizer file whose normaliser or pattern is not the one
that the cutting of texts relies on.
"""
from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Written, strings, worker_state

MAGIC = b"TOKRANS1"
#: Tokens of a file, after which it ends with the document; of a block; coders of a block; steps between checkpoints.
FILE, BLOCK, LANES, CHECKPOINT = 1 << 20, 1 << 15, 32, 256
#: Lower bound of a coder's state; words are 32 bits.
LOW = 1 << 31
#: Entries and characters of each of the tokenizer's tables at most; a full table is emptied.
WORDS, CHARS = 500_000, 20_000_000
#: Characters of the texts whose pieces are held at once; a longer text is cut at blanks.
SLICE = 50_000


def frequencies(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, scaled counts, bits): counts of at least one that sum to 1 << bits."""
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    bits = max(16, int(len(symbols) - 1).bit_length() + 2) if len(symbols) else 16
    freq = np.maximum(1, counts[symbols] * (1 << bits) // max(1, len(tokens))).astype(np.int64)
    over = int(freq.sum()) - (1 << bits)
    for i in np.argsort(-freq, kind="stable"):  # the most frequent give or take the rest
        if not over:
            break
        step = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= step
        over -= step
    return symbols, freq, bits


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, known: np.ndarray | None = None) -> bytes:
    """known: which ids are not null; all of them if it is not given."""
    n = len(tokens)
    known = np.ones(len(doc_ids), bool) if known is None else known
    symbols, freq, bits = frequencies(tokens)
    start = np.cumsum(freq) - freq
    blocks = max(1, -(-n // BLOCK))
    steps = -(-(-(-n // blocks)) // LANES) if n else 0
    size = steps * LANES
    blocks = -(-n // size) if n else 0
    padded = np.full(blocks * size, tokens[0] if n else 0, np.uint32)
    padded[:n] = tokens
    at = np.zeros(int(symbols[-1]) + 1 if n else 1, np.int64)
    at[symbols] = np.arange(len(symbols))
    grid = at[padded].reshape(blocks, steps, LANES)
    f64, s64 = freq.astype(np.uint64), start.astype(np.uint64)
    x = np.full((blocks, LANES), LOW, np.uint64)
    words, used = np.zeros((blocks, steps, LANES), np.uint32), np.zeros((blocks, steps, LANES), bool)
    marks = range(0, steps, CHECKPOINT)
    states = np.zeros((blocks, len(marks), LANES), np.uint64)
    scale = np.uint64(((LOW >> bits) << 32))
    b, w, low = np.uint64(bits), np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        k = grid[:, t]
        f = f64[k]
        full = x >= scale * f
        words[:, t], used[:, t] = x & low, full
        x = np.where(full, x >> w, x)
        q = x // f
        x = (q << b) + (x - q * f) + s64[k]
        if t % CHECKPOINT == 0:
            states[:, t // CHECKPOINT] = x
    stream = words[used]
    per_step = used.sum(axis=2)
    places = np.zeros((blocks, len(marks)), np.int64)
    if n:
        before = (np.cumsum(per_step.ravel()) - per_step.ravel()).reshape(blocks, steps)
        places = before[:, list(marks)]
    sums = [zlib.crc32(padded.reshape(blocks, steps, LANES)[i, t : t + CHECKPOINT].astype("<u4").tobytes()) for i in range(blocks) for t in marks]
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    docs = zlib.compress(np.diff(doc_ids, prepend=np.int64(0)).astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + np.packbits(known).tobytes(), 1)
    head = struct.pack("<8s9Q", MAGIC, n, len(doc_ids), len(symbols), bits, blocks, steps, len(table), len(docs), len(stream))
    body = table + docs + states.astype("<u8").tobytes() + places.astype("<u8").tobytes() + np.array(sums, "<u4").tobytes() + stream.astype("<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(body[: len(body) - 4 * len(stream)], zlib.crc32(head))) + body


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, tokens, which ids are not null) of a file; ValueError if a checksum does not hold."""
    head = struct.calcsize("<8s9Q")
    if len(data) < head + 4:
        raise ValueError("not a token file")
    magic, n, ndocs, nsym, bits, blocks, steps, table, docs, nwords = struct.unpack_from("<8s9Q", data)
    (check,) = struct.unpack_from("<I", data, head)
    end = len(data) - 4 * nwords
    if magic != MAGIC or zlib.crc32(data[head + 4 : end], zlib.crc32(data[:head])) != check:
        raise ValueError("a token file's index is damaged")
    at = head + 4
    raw = np.frombuffer(zlib.decompress(data[at : at + table]), "<u4")
    symbols, freq = np.cumsum(raw[:nsym].astype(np.int64)), raw[nsym:].astype(np.int64)
    at += table
    raw = zlib.decompress(data[at : at + docs])
    doc_ids = np.cumsum(np.frombuffer(raw, "<i8", ndocs))
    lengths = np.frombuffer(raw, "<u4", ndocs, 8 * ndocs).astype(np.int64)
    known = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 12 * ndocs), count=ndocs).astype(bool)
    at += docs
    marks = -(-steps // CHECKPOINT)
    units = blocks * marks
    x = np.frombuffer(data, "<u8", units * LANES, at).reshape(units, LANES).copy()
    at += 8 * units * LANES
    place = np.frombuffer(data, "<u8", units, at).astype(np.int64)
    at += 8 * units
    sums = np.frombuffer(data, "<u4", units, at)
    at += 4 * units
    stream = np.frombuffer(data, "<u4", nwords, at).astype(np.uint64)
    stream = np.append(stream, np.uint64(0))
    slot = np.repeat(np.arange(nsym), freq)
    start = np.cumsum(freq) - freq
    f64, s64 = freq.astype(np.uint64), start.astype(np.uint64)
    out = np.zeros((blocks, marks, CHECKPOINT, LANES), np.uint32)
    b, mask, w = np.uint64(bits), np.uint64((1 << bits) - 1), np.uint64(32)
    x = x.reshape(blocks, marks, LANES)
    place = place.reshape(blocks, marks)
    for t in range(min(CHECKPOINT, steps)):
        live = marks if (marks - 1) * CHECKPOINT + t < steps else marks - 1  # the last part may be short
        v = x[:, :live]
        low = v & mask
        k = slot[low.astype(np.int64)]
        out[:, :live, t] = symbols[k]
        v = f64[k] * (v >> b) + low - s64[k]
        need = v < LOW
        rank = np.cumsum(need, axis=2)
        p = place[:, :live]
        got = stream[np.minimum(p[:, :, None] + rank - 1, nwords)]
        x[:, :live] = np.where(need, (v << w) | got, v)
        place[:, :live] = p + rank[:, :, -1]
    flat = out.reshape(blocks, marks * CHECKPOINT, LANES)[:, :steps]
    for i in range(blocks):
        for m in range(marks):
            part = flat[i, m * CHECKPOINT : (m + 1) * CHECKPOINT]
            if zlib.crc32(np.ascontiguousarray(part, "<u4").tobytes()) != sums[i * marks + m]:
                raise ValueError(f"block {i}, part {m}: the checksum does not hold")
    return doc_ids, lengths, flat.reshape(-1)[:n], known


#: What a tokenizer file must do to texts for WordTokenizer's cuts to hold (fixed values of its format).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Table(dict):
    """What parts of a text are encoded to, within WORDS entries and CHARS characters."""

    chars = 0

    def missing(self, used: set[str]) -> list[str]:
        """Those to be learnt before all of used are held."""
        new = [p for p in used if p not in self]
        if len(self) + len(new) > WORDS or self.chars > CHARS:
            self.clear()
            self.chars, new = 0, list(used)
        self.chars += sum(map(len, new))
        return new


class WordTokenizer:
    """The tokenizers library over parts of a text that its pattern never joins, each encoded once.

    Texts of Latin-1 characters are in composed form already, so in lower case the
    pattern's own pieces are the parts: an expression finds them whose classes of
    characters the library, asked for each character, has told. In other texts so
    are the ASCII words; the rest are cut at blanks, and before the marks at a
    word's end if the library tells them apart from the character before.
    A text that holds an added token is cut at blanks alone.
    """

    TAIL = ".,!?;:%$#*&|"

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.added = [t["content"] for t in spec["added_tokens"]]
        whole = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or set(t["content"]) <= set(self.TAIL) or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
        ends_marked = any(t[-1:] in self.TAIL for t in self.added)
        if (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS or split[0].get("pattern") != {"Regex": PATTERN} or not whole or ends_marked:
            raise ValueError(f"{path}: not the normaliser, pattern or added tokens that words are cut by")
        suffix = spec["model"].get("end_of_word_suffix") or "\0"
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.lib.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        kinds: dict[str, str] = {"blank": "", "letter": "", "number": "", "mark": ""}
        for c in map(chr, range(256)):
            kinds[self.kind(c)] += re.escape(c.lower())
        letter, number, others = f"[{kinds['letter']}]+", f"[{kinds['number']}]", f"[^{kinds['blank']}{kinds['letter']}{kinds['number']}]+"
        self.find = re.compile(f"{PATTERN.split('|[', 1)[0]}|{letter}|{number}|{others}").findall
        self.words, self.parts = Table(), Table()
        self.apart: dict[str, bool] = {}

    def pieces(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))

    def kind(self, char: str) -> str:
        if self.lib.normalizer.normalize_str(char) == " ":
            return "blank"
        if len(self.pieces("a" + char)) == 1:
            return "letter"
        return "number" if len(self.pieces(char + char)) == 2 else "mark"

    def cuts_after(self, char: str) -> bool:
        """Whether marks that follow the character are a piece of their own."""
        if char not in self.apart:
            pieces = self.pieces(char + ".")
            self.apart[char] = len(pieces) > 1 and pieces[-1][0] == "."
        return self.apart[char]

    def look_up(self, parts: list[str]) -> None:
        """Encode parts; letters alone are one piece, mostly, whose last token has the word-end suffix, so many go in one text."""
        alone = [p for p in parts if not p.isalpha()]
        rest = [p for p in parts if p.isalpha()]
        joint = [rest[at : at + 400] for at in range(0, len(rest), 400)]
        for some, e in zip(joint, self.lib.encode_batch_fast([" ".join(some) for some in joint], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(some):
                alone += some
                continue
            raw, begin = ids.tobytes(), 0
            for p, end in zip(some, cuts, strict=True):
                self.parts[p] = raw[4 * begin : 4 * end]
                begin = end
        for p, e in zip(alone, self.lib.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.parts[p] = np.array(e.ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        split, need = [], set()
        for w in self.words.missing(words):
            core = w.rstrip(self.TAIL)
            if core != w and not (core and self.cuts_after(core[-1])):
                core = w
            split.append((w, core, w[len(core) :]))
            need.update(split[-1][1:])
        self.look_up(self.parts.missing(need))
        for w, core, tail in split:
            self.words[w] = self.parts[core] + self.parts[tail]

    def cut(self, text: str) -> list[tuple[bool, list[str]]]:
        """(whether they are words, parts) in order; other parts are pieces."""
        if any(t in text for t in self.added):
            return [(True, text.replace("\n", " ").split(" "))]
        try:
            text.encode("latin-1")
            return [(False, self.find(text.lower()))]
        except UnicodeEncodeError:
            runs = itertools.groupby(text.replace("\n", " ").split(" "), str.isascii)
            return [(False, self.find(" ".join(run).lower())) if ascii else (True, list(run)) for ascii, run in runs]

    def slices(self, texts: list[str]):
        """(number of the text, part of it that ends before a blank), up to SLICE characters or one run without blanks."""
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > SLICE:
                end = t.rfind(" ", at + 1, at + SLICE)
                end = end if end > 0 else t.find(" ", at + SLICE)
                if end < 0:
                    break
                yield i, t[at:end]
                at = end
            yield i, t[at:] if at else t

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[tuple[bool, list[str]]]]] = []
        size = 0

        def flush():
            self.learn(set().union(*(p for _, cut in held for words, p in cut if words)))
            # After the words, as their parts may empty the table.
            found = [[None if words else list(map(self.parts.get, p)) for words, p in cut] for _, cut in held]
            new = {p for (_, cut), got in zip(held, found, strict=True) for (_, parts), ids in zip(cut, got, strict=True) if ids and None in ids for p, e in zip(parts, ids, strict=True) if e is None}
            self.look_up(self.parts.missing(new))
            word, piece = self.words.__getitem__, self.parts.__getitem__
            for (i, cut), got in zip(held, found, strict=True):
                for (words, parts), ids in zip(cut, got, strict=True):
                    if ids and None in ids:
                        ids = [piece(p) if e is None else e for p, e in zip(parts, ids, strict=True)]
                    out[i].append(b"".join(map(word, parts) if words else ids))

        for i, t in self.slices(texts):
            if held and size + len(t) > SLICE:
                flush()
                held, size = [], 0
            held.append((i, self.cut(t)))
            size += len(t)
        flush()
        return [b"".join(o) for o in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Written:
    """Files (part, seq, start, n_tokens, n_docs, data) of all documents in ascending order of id.

    start: tokens before the file among the files of its part; parts ascend too.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        tok = worker_state(f"words:{path}", lambda: WordTokenizer(path))
        ids, sizes, held, total = [], [], [], 0

        def flush():
            nonlocal seq, start, ids, sizes, held, total
            tokens = np.frombuffer(b"".join(held), "<u4")
            known = np.array([i is not None for i in ids])
            data = encode_file(np.array([i or 0 for i in ids], np.int64), np.array(sizes, np.int64), tokens, known)
            row = [[part], [seq], [start], [total], [len(ids)]]
            seq, start = seq + 1, start + total
            ids, sizes, held, total = [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in row), pa.array([data], pa.binary())], names=["part", "seq", "start", "n_tokens", "n_docs", "data"]
            )

        for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            for i, e in zip(b.column(0).to_pylist(), tok.encode_all(strings(b.column(1))), strict=True):
                e += end
                ids.append(i)
                sizes.append(len(e) // 4)
                held.append(e)
                total += len(e) // 4
                if total >= FILE:
                    yield flush()
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    df = df.repartitionByRange(parts, "id").sortWithinPartitions("id")
    return Written(df.mapInArrow(run, "part long, seq long, start long, n_tokens long, n_docs long, data binary"), "tokens")


def _named(part: int, seq: int) -> str:
    return f"{part:08d}-{seq:08d}.tokens"


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """(name, bytes): every file written under its own name to a folder that all executors reach, as a path or an address.

    A file appears under its name when it is whole, and a task run again writes the same bytes.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        for b in batches:
            names, sizes = [], []
            for part, seq, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base)
                name = _named(part, seq)
                began = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(began) as out:
                    out.write(data)
                store.move(began, f"{base}/{name}")
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return Written(files.select("part", "seq", "data").mapInArrow(run, "name string, bytes long"), "exported").df


def import_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of such a folder as write_tokens returns them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    name = F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.tokens$", 1), F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.tokens$", 2)
    # The head of a file: its mark, then counts of tokens and documents, little-endian.
    number = lambda at: F.conv(F.concat(*(F.hex(F.expr(f"substring(content, {at + i}, 1)")) for i in reversed(range(8)))), 16, 10).cast("long")
    rows = found.select(name[0].cast("long").alias("part"), name[1].cast("long").alias("seq"), number(9).alias("n_tokens"), number(17).alias("n_docs"), F.col("content").alias("data"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    return rows.join(sizes, ["part", "seq"]).select("part", "seq", "start", "n_tokens", "n_docs", "data")


def starts(files: DataFrame) -> DataFrame:
    """(part, before): tokens of all parts before. One row a part, so the window's rows are few by construction."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, tokens_crc32) of every document, from the files."""

    def run(batches):
        for b in batches:
            for part, start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, lengths, tokens, known = decode_file(data.as_py())
                raw = memoryview(tokens.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part)), pa.array(ids, mask=~known), pa.array(begins + start), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "start", "data").mapInArrow(run, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = F.broadcast(starts(files))  # one row a part
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
