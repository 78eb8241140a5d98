"""Ids and bytes against the public library, on every kind of text."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tradewind.llm import bpe as B
from tradewind.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return queries.production_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0      　​"
TEXTS = [
    None,
    "",
    " ",
    "  \n\n x  ",
    "It's we'll I'd THEY'RE 's",
    "Grüße, naïve façade — 東京 ½ ²³ 😀👩‍👩‍👧 é",
    SPACES,
    " ".join(SPACES),
    "a" + SPACES + "b",
    "<|endoftext|> <|im_start|>",
    "\x00\x01\x7f�\U0010ffff",
    "1234567890 ٣٤٥ Ⅷ",
    "x" * 5000,
    "ab" * 300 + " " + "ab" * 100,
    "aaaaaaaaaaaaaaa" * 20,
    "".join(chr(random.Random(2).randrange(97, 123)) for _ in range(3000)),
    "zqxj vkwpfghh bvcxzasdf " * 50,
    "lorem ipsum " * 60_000,
]


def want(library, text):
    return library.encode_ordinary(text or "")


def frame(spark, texts):
    rows = [(i if i != 3 else None, t, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("word", F.lit(1))


@pytest.mark.parametrize("words,size,bytes_", [(1 << 19, 250, 64), (3, 2, 2)])
def test_ids_equal_the_library(spark, vocabulary, library, monkeypatch, words, size, bytes_):
    """Also with a dictionary of three words: nearly everything is folded in its row."""
    monkeypatch.setattr(B, "DICTIONARY", words)
    monkeypatch.setattr(B, "SLICE", size)
    monkeypatch.setattr(B, "DICTIONARY_BYTES", bytes_)
    texts = TEXTS[:-1] if words == 3 else TEXTS
    got = B.decode(B.encode(frame(spark, texts), vocabulary), vocabulary).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(by_id) == len(texts)
    for i, text in enumerate(texts):
        row = by_id[i if i != 3 else None]
        assert row.ids == want(library, text), i
        assert bytes(row.decoded) == (text or "").encode()
        assert bytes(row.packed) == np.array(row.ids, "<u4").tobytes()


def test_heap_equals_fold(vocabulary, library):
    rng = random.Random(4)
    for n in (2, 3, 10, 100, 700):
        for alphabet in ("ab", "the an", "abcdefghijklmnopqrstuvwxyzé"):
            piece = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert B.merge_with_heap(piece, vocabulary.ranks) == library._encode_single_piece(piece)


def test_fold_of_random_words(spark, vocabulary, library):
    rng = random.Random(6)
    words = {"".join(rng.choice(" etaoinshrdluéß東😀0") for _ in range(rng.randrange(1, 25))) for _ in range(400)}
    fold = B.fold_merges(vocabulary)
    df = spark.createDataFrame([(w,) for w in words], "word string").select("word", fold(F.col("word")).alias("t"))
    for r in df.collect():
        assert B._tokens(r.t).tolist() == library._encode_single_piece(r.word.encode()), r.word


def test_pieces_of_ascii_texts(vocabulary, library):
    """The short form of the pattern on every ASCII character, in all neighbourhoods of two."""
    assert B._ascii_pattern(r"\p{Lu}+") is None
    text = "".join(chr(a) + chr(b) for a in range(128) for b in range(128)) + " x's  9 \n\n 'LL'll"
    assert "".join(vocabulary.splitter()(text)) == text
    unicode_pieces = vocabulary.splitter()(text + "é")
    assert vocabulary.splitter()(text)[:-3] == unicode_pieces[: len(vocabulary.splitter()(text)) - 3]
    assert [i for p in vocabulary.splitter()(text) for i in library._encode_single_piece(p.encode())] == want(library, text)


def test_empty_table(spark, vocabulary):
    assert B.decode(B.encode(frame(spark, []), vocabulary), vocabulary).count() == 0


def test_query_equals_the_library(spark, library):
    found = {r.doc_id: r for r in queries.QUERIES["op6_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = want(library, d.text)
        assert found[d.doc_id].n_tokens == len(ids)
        assert found[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
