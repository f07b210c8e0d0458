import base64
import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import LONG, awkward, empty, read
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseyard.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encode():
    return bpe.text_encoder(bpe.vocabulary(bpe.read_file(PATH)), public_tokenizers.PATTERN, bpe.COARSE)


def packed(reference, text):
    return np.array(reference.encode_ordinary(text), "<u4").tobytes()


ODD = ["", " ", "\n\n", " \n x", "a" * 3000, "é" * 2000, "!" * 1500, "it's 'tis we'll", "\x1c a\x1d\x1eb", "a b 　 c\r\n\n d  \x85x", "½²٣ 12345678", "😀🧑‍🚀" * 300]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(reference, encode, text):
    assert encode([text])[0] == packed(reference, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=80))
def test_any_text(text):
    ref, enc = test_any_text.reference, test_any_text.encode
    ids = enc([text])[0]
    assert ids == packed(ref, text)
    assert test_any_text.vocab.decode(ids) == text.encode()


@pytest.fixture(autouse=True)
def _attach(reference, encode):
    test_any_text.reference, test_any_text.encode = reference, encode
    test_any_text.vocab = bpe.vocabulary(bpe.read_file(PATH))


def wide_pieces():
    draw = random.Random(5)
    tokens = [t for t in bpe.vocabulary(bpe.read_file(PATH)).ranks if len(t) > 1]
    letters = string.ascii_letters.encode()
    yield from (b"internationalization", bytes(range(256)), b"=" * 77, b"a" * 5001, b"ab" * 3000, b"the" * 2000)
    for size in (2, 3, 700, 4000):
        yield bytes(draw.choices(letters, k=size))
        yield bytes(draw.choices(b"abe", k=size))
        yield bytes(draw.choices(range(256), k=size))
        yield b"".join(draw.choices(tokens, k=size // 2))
        yield "".join(chr(draw.randrange(0x4E00, 0x5200)) for _ in range(size)).encode()


def test_wide_rows_equal_the_library(reference):
    """A row alone, a row among others, and a piece cut into rows give the ids of the library."""
    vocab = bpe.vocabulary(bpe.read_file(PATH))
    for piece in wide_pieces():
        wanted = np.array(reference._core_bpe.encode_single_piece(piece), "<u4").tobytes()
        assert vocab.encode_pieces([piece]) == [wanted]
        if piece not in vocab.ranks:
            assert vocab._merge_row(piece) == vocab._merge_rows([piece], bpe._width(len(piece)))[0] == wanted
            assert b"".join(vocab._merge_row(part) for part in vocab._parts(piece)) == wanted


def test_runs_of_lower_rank():
    """Tokens whose rank is below that of their halves, which single rounds meet in mid-run."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"aba": 256, b"bab": 257, b"ab": 258, b"ba": 259, b"abab": 260, b"aab": 261, b"aa": 262, b"abaab": 263}
    vocab = bpe.Vocabulary(ranks)
    core = tiktoken.Encoding("small", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    draw = random.Random(6)
    for trial in range(400):
        piece = bytes(draw.choices(b"ab" if trial % 2 else b"aabc", k=draw.randrange(2, 90)))
        if piece not in ranks:
            assert vocab._merge_row(piece) == np.array(core.encode_single_piece(piece), "<u4").tobytes()


def test_pair_table():
    left, right = np.arange(5000) % 71, np.arange(5000) // 71
    table = bpe.PairTable(left, right, np.arange(5000, dtype=np.int32))
    assert (table.ranks(left, right) == np.arange(5000)).all()
    assert (table.ranks(np.array([99, -1]), np.array([99, 0])) == bpe._NEVER).all()


def test_query_equals_library(spark, reference):
    from pulseyard.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, "documents").select("doc_id", "text").collect()}
    got = QUERIES["op6_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = packed(reference, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_awkward_rows(spark, reference):
    docs = awkward(spark)
    done = bpe.encode_decode(docs.withColumn("decoded", F.lit(1)), PATH, public_tokenizers.PATTERN, bpe.COARSE)
    rows = done.collect()
    assert len(rows) == docs.count() and done.columns.count("decoded") == 1
    for r in rows:
        assert bytes(r["token_ids"]) == packed(reference, r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode_decode(empty(spark), PATH, public_tokenizers.PATTERN).collect() == []


def test_chunks_never_cut_a_match():
    import regex

    for text in [*ODD, LONG[:5000], "a  b\n\n c 's 'S\t\tq"]:
        chunks = re.findall(bpe.COARSE, text)
        assert "".join(chunks) == text
        assert [p for c in chunks for p in regex.findall(public_tokenizers.PATTERN, c)] == regex.findall(public_tokenizers.PATTERN, text)
