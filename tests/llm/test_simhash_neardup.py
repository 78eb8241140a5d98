import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tradewind.llm import simhash_neardup as S


def slow_fingerprint(text, words=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not tokens:
        return 0
    shingles = [tokens[i : i + words] for i in range(len(tokens) - words + 1)] or [tokens]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, most):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                label[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least.get(find(i)) for i in range(len(fps))]


TEXTS = [
    "one two three four five six seven",
    "ONE two  three\tfour five six seven",
    "one two three four five six seven eight",
    "one",
    "one two",
    "one two three",
    "",
    None,
    " \n",
    "ÄÖ\u00a0x y z ÄÖ",
    "a a a a a a a a",
    "lorem " * 200_000,
    "one two three four five six seven",
]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 3)
    for text in TEXTS[:11]:
        assert S.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_bits_above_half(spark):
    rng = random.Random(3)
    for n in range(1, 30):
        text = " ".join(rng.choice("abcdefgh") for _ in range(n))
        assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_edge_texts_end_to_end(spark):
    ids = [*range(100, 100 + len(TEXTS) - 1), None]
    df = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)
    fps = [slow_fingerprint(t) for t in TEXTS]
    want = brute_components(ids, fps, 3)
    assert got == sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, want)), key=str)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_documents_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    assert S.drop_near_duplicates(df).count() == 2


@pytest.mark.parametrize("leaf", [4, 20, 1024])
def test_links_connect_what_brute_force_connects(spark, leaf):
    """Random fingerprints, chains, a dense ball and ones that share whole blocks."""
    rng = random.Random(leaf)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            fps.add(x)
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    for _ in range(150):
        fps.add(ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)))
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(f), f"{f}") for f in fps], "fp long, t string")
    rows = df.select(F.monotonically_increasing_id().alias("row_id"), F.col("fp").alias("doc_id"), "fp")
    got = {r.fp: r.component_id for r in S._row_components(rows, 3, leaf).collect()}
    signed = [S._signed(f) for f in fps]
    assert [got[s] for s in signed] == brute_components(signed, fps, 3)


def test_descent_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    x, y = S.close_pairs(fps, 3)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert set(zip(x.tolist(), y.tolist())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
    assert S.drop_near_duplicates(df).count() == 0
