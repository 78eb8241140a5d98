import random
import re
from collections import defaultdict

import pytest

from tradewind.llm import paragraph_dedup, passage_dedup as P
from tradewind.llm import queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, size=50):
    """Rows as the operator returns them, from all windows of all documents."""
    at, texts = defaultdict(list), [tokens(t) for _, t in docs]
    for row, found in enumerate(texts):
        for i in range(len(found) - size + 1):
            at[tuple(found[i : i + size])].append((docs[row][0] is None, docs[row][0] or 0, row, i))
    runs = defaultdict(set)
    for places in at.values():
        source = min(places)
        if len({p[2] for p in places}) > 1:
            for _, _, row, i in places:
                runs[row, source[2], i - source[3]].add(i)
    out = []
    for (row, source, step), found in runs.items():
        for i in sorted(found):
            if i - 1 in found:
                continue
            j = i
            while j + 1 in found:
                j += 1
            out.append((docs[row][0], i, j - i + size, docs[source][0], i - step, row == source and step == 0))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)


def noise(rng, n):
    return [f"n{rng.randrange(10**9)}" for _ in range(n)]


def embedded(seed):
    """A passage of 52 words inside long lines of different length, and one over line breaks."""
    rng = random.Random(seed)
    inside, across = noise(rng, 52), noise(rng, 54)
    return [
        (5, " ".join(noise(rng, 30) + inside + noise(rng, 31))),
        (3, "x y\n" + " ".join(noise(rng, 9) + [w.upper() for w in inside] + noise(rng, 50)) + "\nz"),
        (8, " ".join(across[:15]) + "\n" + " ".join(across[15:])),
        (9, " ".join(noise(rng, 4) + across[:33]) + ".\n\n" + ", ".join(across[33:] + noise(rng, 70))),
        (2, " ".join(noise(rng, 20) + inside[:49] + noise(rng, 20))),
        (1, None),
        (None, "\n".join(inside)),
    ]


def test_embedded_passages_are_found(spark):
    docs = embedded(1)
    df = frame(spark, docs)
    got = result(P.repeated_passages(df))
    assert got == brute(docs)
    assert {(r[0], r[2], r[3], r[5]) for r in got} == {
        (3, 52, 3, True), (5, 52, 3, False), (None, 52, 3, False), (8, 54, 8, True), (9, 54, 8, False)
    }
    # Lines as units find none of them.
    assert paragraph_dedup.repeated_paragraphs(df).count() == 0
    assert P.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    """Few words, repeated words, one passage in most documents, passages that overlap in any order."""
    monkeypatch.setattr(paragraph_dedup, "CHUNK", 900)
    rng = random.Random(seed)
    pool = [noise(rng, rng.randrange(60, 180)) for _ in range(6)] + [["a"] * 70, ["b", "c"] * 40]
    docs = [(1, None), (1, ""), (None, " ".join(pool[0])), (None, " ".join(pool[1]))]
    for d in range(120):
        found = []
        for _ in range(rng.randrange(0, 4)):
            base = pool[0] if rng.random() < 0.5 else rng.choice(pool)
            lo = rng.randrange(0, 20)
            found += noise(rng, rng.randrange(0, 30)) + base[lo : rng.randrange(lo + 30, len(base) + 1)]
        if d % 10 == 9:
            docs.append((d, docs[rng.randrange(len(docs))][1]))
        docs.append((d, "".join(w + rng.choice([" ", " ", ", ", "\n"]) for w in found)))
    rng.shuffle(docs)
    got, want = result(P.repeated_passages(frame(spark, docs))), brute(docs)
    assert got == want and len(want) > 50


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = result(queries.QUERIES["op9_passage_dedup"](spark, SF))
    assert got == brute(docs) and len(got) > 20
