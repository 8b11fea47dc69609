"""op12: encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grainline.llm import bpe
from grainline.llm.queries import QUERIES

from ..conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def theirs(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ours(encoder, texts):
    return [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)]


@pytest.mark.parametrize("letters", ["ab", "aaab", "the in gan er", "étèàüß aeious", "日本語 中国", "'stremdl ", "0123 .,!?<|>", "σΣΑΒİÍé ", "e\u0301a\u0308 x"])
def test_random_texts(vocabulary, letters):
    draw = random.Random(len(letters))
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 70))) for _ in range(3000)]
    assert ours(bpe.Encoder(vocabulary), texts) == [theirs(t) for t in texts]


def test_joined_tokens_and_all_pairs_that_fit(vocabulary):
    draw = random.Random(3)
    names = [n.removesuffix("</w>") for n in vocabulary.names.values()]
    texts = ["".join(draw.choices(names, k=draw.randint(1, 5))) for _ in range(8000)]
    assert ours(bpe.Encoder(vocabulary, most=1000), texts) == [theirs(t) for t in texts]
    # a pair fits exactly if merging its bytes anew gives the pair
    inside = list(vocabulary.inside.items())
    pairs = [(draw.choice(inside), draw.choice(list(vocabulary.last.items()))) for _ in range(300)]
    pairs += [(draw.choice(inside[:600]), draw.choice(list(vocabulary.last.items())[:600])) for _ in range(300)]
    fits = vocabulary.fits(np.array([a for (_, a), _ in pairs]), np.array([b for _, (_, b) in pairs]))
    assert fits.tolist() == [vocabulary.merged(x + y) == [a, b] for (x, a), (y, b) in pairs]
    assert 0 < fits.sum() < len(pairs)


def test_proposals_that_fail_are_merged(vocabulary):
    words = [f"{a}{b}{c}".encode() for a in ("un", "re", "th", "st") for b in ("here", "ing", "ated", "iness") for c in ("ful", "ers", "th", "ings")]
    failing = [w for w in words if vocabulary.propose(w) != vocabulary.merged(w)]
    assert failing
    assert vocabulary.tokens(words) == [vocabulary.merged(w) for w in words]


def test_every_code_point_is_split_alike(vocabulary):
    for c in (*range(0xD800), *range(0xE000, 0x20000, 7)):
        text = f"a{chr(c)}b"
        plain = LIBRARY.normalizer.normalize_str(text)
        assert vocabulary.words(text) == [plain[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(plain)], hex(c)


def test_long_texts_are_cut_where_nothing_lies_across(vocabulary, monkeypatch):
    draw = random.Random(9)
    text = "".join(draw.choices(["e", "\u0301", " ", "\n", "word", "<|endoftext|>", "it's", "x" * 300], k=4000))
    monkeypatch.setattr(bpe, "PIECE", 64)
    assert "".join(bpe.pieces(text, 64)) == text
    assert ours(bpe.Encoder(vocabulary), [text, "y" * 5000]) == [theirs(text), theirs("y" * 5000)]


def test_tables_with_odd_rows(spark, make):
    long = "lorem ipsum " * 200_000
    rows = [(1, "Hello it's 12"), (1, "Hello it's 12"), (None, "a<|endoftext|>b"), (2, None), (3, ""), (4, " \t"), (5, long)]
    encoded = bpe.encode(make(rows), PATH)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    decoded = {(r.doc_id, r.text[:60]): r.n_tokens for r in bpe.decode(encoded, PATH).collect()}
    expect = {(i, LIBRARY.decode(theirs(t or ""), skip_special_tokens=False)[:60]): len(theirs(t or "")) for i, t in rows}
    assert decoded == expect and encoded.count() == len(rows)
    assert bpe.encode(make([]), PATH).collect() == []
    clash = encoded.selectExpr("doc_id", "'x' AS _row", "'y' AS _text", "ids")
    assert bpe.decode(clash, PATH, out_col="out").columns == ["doc_id", "_row", "_text", "out"]
    assert spark.createDataFrame([(None,), (b"",), (np.array([1 << 20], "<u4").tobytes(),)], "ids binary").transform(bpe.decode, PATH).collect() == [("",)] * 3


def test_query_is_the_library(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expect = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = theirs(r.text or "")
        expect.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, QUERIES["op12_bpe"](spark, SF).collect())) == sorted(expect)


def test_other_files_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        bpe.Vocabulary(f.read())
