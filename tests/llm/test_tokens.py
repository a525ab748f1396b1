import hashlib
import json
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm import pieces, rans

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  ", " a", "a  b   c", "▁x ▁▁", " " * 40 + "☃", "\t\n a\n\n", "<s> </s><unk>", "日本語テスト  漢字☃️", "naïve x", "a" * 300, "ab" * 200, " " * 31, "\x00 z", "ﬁ ％",
    "a<|endoftext|>b <|startoftext|>, <|ENDOFTEXT|> x", "\x1c\x85 x　y", "ΑΣ ΣΑΣ ς,", "İI", "é ́x", "it's we'll IT'S o'clock'", "K Å", "각 한글", "١٢ ½x ²", "a.b.c... x|y| |",
    "İ. aİ, x İ! क़. ﬃ; ǅ: ΑΣ. Σ, K! é. é, 가. ², Ⅷ. ৳.", "<|endoftext|. x<|endoftext|>. |<|endoftext|>|",
]


def texts():
    rnd = random.Random(4)
    return ODD + ["".join(rnd.choice("aBcÉéti.,'! \n1²<>s_") for _ in range(rnd.randint(1, 60))) for _ in range(400)]


def docs(spark):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts())] + [(-1, None, "z")], "doc_id long, text string, ids string")


def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in pieces.digests(docs(spark), PIECES).collect()}
    for i, t in [*enumerate(texts()), (-1, "")]:
        ids = lib.encode(t)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))), t


def test_pieces_round_trip(spark):
    encoded = pieces.encode(docs(spark), PIECES)
    back = {r["id"]: r["text"] for r in pieces.decode(encoded, PIECES).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts()))


def test_pieces_by_merging_and_alone():
    m = pieces.PieceModel(PIECES)
    for w in ["hello", "unbelievable", "ééà", "aaaaaaa", "x" * 90]:
        want = [m.id[p] for p in m.merge(pieces.MARK + w)]
        assert m.segment(pieces.MARK + w) == want == m.encode(w)
    m.segments.clear()
    assert m.encode("hello hello") == m.encode("hello") * 2


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000, 40_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    tokens = (rng.zipf(1.3, n) % 49_000).astype(np.uint32)
    lengths = np.array([n // 3, 0, n - n // 3])
    known = np.array([False, True, True])
    ids, sizes, back, kept = rans.decode_file(rans.encode_file(np.array([0, 5, 900]), lengths, tokens, known))
    assert ids.tolist() == [0, 5, 900] and sizes.tolist() == lengths.tolist() and (back == tokens).all() and (kept == known).all()


def test_rans_one_symbol_and_damage():
    data = rans.encode_file(np.array([1]), np.array([1000]), np.full(1000, 7, np.uint32))
    assert len(data) < 1000 and (rans.decode_file(data)[2] == 7).all()
    data = bytearray(rans.encode_file(np.array([1]), np.array([9000]), np.random.default_rng(1).integers(0, 500, 9000).astype(np.uint32)))
    for at in (3, 90, len(data) - 2):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode_file(bytes(broken))


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_files_equal_the_library(spark, monkeypatch, size):
    monkeypatch.setattr(rans, "FILE", size)
    lib = Tokenizer.from_file(WORDS)
    df = docs(spark).repartition(5)
    got = sorted(rans.read_tokens(rans.write_tokens(df, WORDS).df).collect())
    start = 0
    for row, (i, t) in zip(got, [(-1, ""), *enumerate(texts())], strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(row) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert rans.read_tokens(rans.write_tokens(df.limit(0), WORDS).df).count() == 0


def test_every_character_before_every_mark():
    lib, own = Tokenizer.from_file(WORDS), rans.WordTokenizer(WORDS)
    marks = own.TAIL
    chars = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Co", "Cn")]
    texts = [f"{c}{marks[i % len(marks)]} b{c}{marks[i * 7 % len(marks)]}. {c.upper()}!{c}" for i, c in enumerate(chars)]
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(some, add_special_tokens=False)]
        assert own.encode_all(some) == want


@pytest.mark.parametrize("held", [500_000, 3])
def test_joined_latin_and_other_texts(monkeypatch, held):
    monkeypatch.setattr(rans, "WORDS", held)
    monkeypatch.setattr(rans, "SLICE", 50)
    lib, own, rnd = Tokenizer.from_file(WORDS), rans.WordTokenizer(WORDS), random.Random(9)
    latin, odd = "".join(map(chr, range(256))) * 2 + " 'aést" * 60, "İΑΣ\u0301\u0327Å é가'’—² \n\u3000<|endoftext|> "
    texts = ["".join(rnd.choice(latin) for _ in range(rnd.randint(0, 90))) for _ in range(2000)]
    texts += ["".join(rnd.choice(latin[-200:] + odd) for _ in range(rnd.randint(0, 90))) for _ in range(2000)]
    texts += ["we'll it'S <|endoftext|>'s x", "a" * 200 + " b'" + "é" * 100 + "\u3000 x"]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.encode_all(texts) == want and own.encode_all(texts[::-1]) == want[::-1]


def test_another_tokenizer_is_refused(tmp_path):
    spec = json.loads(open(WORDS, encoding="utf-8").read())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            rans.WordTokenizer(str(path))


def test_null_and_repeated_ids_and_files(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b", "z"), (7, "c", "z"), (7, "c", "z"), (None, None, "z"), (-3, "d.", "z")], "doc_id long, text string, part string")
    files = rans.write_tokens(df, WORDS).df
    got = sorted((tuple(r) for r in rans.read_tokens(files).collect()), key=lambda r: r[1])
    assert [(r[0], r[2]) for r in got[2:]] == [(-3, 3), (7, 2), (7, 2)] and sorted((r[0], r[2]) for r in got[:2]) == [(None, 1), (None, 3)]
    names = rans.export_files(files, f"file://{tmp_path}/out").collect()
    assert all((tmp_path / "out" / r["name"]).stat().st_size == r["bytes"] for r in names)
    opened = rans.import_files(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, opened.drop("data").collect())) == sorted(map(tuple, files.drop("data").collect()))
    assert sorted(map(tuple, rans.read_tokens(opened).collect()), key=str) == sorted(got, key=str)
