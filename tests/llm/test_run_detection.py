import hashlib
import random
import zlib

import numpy as np
import pytest

from tradewind.llm import run_detection as R


def brute(words, least=6, times=4):
    """Every maximal stretch with its smallest period, by trying all of them."""
    n, found = len(words), []
    for lo in range(n):
        for hi in range(n, lo + least - 1, -1):
            part = words[lo:hi]
            q = next(q for q in range(1, hi - lo + 1) if part[q:] == part[: hi - lo - q])
            if hi - lo < max(least, times * q):
                continue
            if lo and words[lo - 1] == words[lo - 1 + q] or hi < n and words[hi] == words[hi - q]:
                continue
            found.append((lo, hi - lo, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def samples():
    rng = random.Random(5)
    for _ in range(250):
        size, kinds = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 6])
        words = [rng.randrange(kinds) for _ in range(size)]
        if rng.random() < 0.8:
            unit = [rng.randrange(kinds + 1) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, size)
            words[at:at] = (unit * 7)[: rng.randint(1, 6 * len(unit))]
        yield words


@pytest.mark.parametrize("direct", [0, 1, 48])
def test_runs_equal_brute_force(direct):
    hit = 0
    for words in samples():
        want = brute(words)
        hit += bool(want)
        assert R.runs(np.array(words, np.int64), 6, 4, direct) == want, words
    assert hit > 100


def test_segments_hold_every_run_and_no_rare_word():
    for words in samples():
        codes = np.array(words, np.int64)
        parts = R.segments(codes, 4, 6)
        for lo, hi in parts:
            assert np.unique(codes[lo:hi], return_counts=True)[1].min() >= 4 and hi - lo >= 6
        for start, length, _ in brute(words):
            assert any(lo <= start and start + length <= hi for lo, hi in parts)


def test_long_periods_in_a_long_text():
    rng = np.random.default_rng(3)
    unit, inner = rng.integers(0, 50, 9000), rng.integers(0, 50, 130)
    codes = np.concatenate([rng.integers(50, 5000, 700), np.tile(unit, 5)[:44000], [9001], np.tile(inner, 9), [9002], [0] * 20000])
    found = R.runs(codes, 6, 4)
    assert {(700, 44000, 9000), (44701, 1170, 130), (45872, 20000, 1)} <= set(found)


TEXTS = [
    (1, "a b a b a b a b c"),
    (2, "x y x y\tx y x y\n\n x y x y"),
    (3, None),
    (4, ""),
    (5, "one two three"),
    (5, "one two three"),
    (None, "z z z z z z z"),
    (10, "a a a a a a b b b b b b a a a a a a b b b b b b " * 4),
    (11, "long " * 30000 + "end"),
    *[(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 70))) for i in range(20, 120)],
]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words) if len(words) < 1000 else [(0, 30000, 1)]
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def report(spark, rows):
    docs = spark.createDataFrame([(i, t, "u", 0) for i, t in rows], "doc_id long, text string, runs string, h int")
    return R.run_report(R.periodic_runs(R.repeated_tails(docs)))


def test_query_equals_brute_force(spark):
    found = sorted((tuple(r) for r in report(spark, TEXTS).collect()), key=repr)
    assert found == sorted((expected(*row) for row in TEXTS), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in TEXTS) >= 5


def test_empty_table(spark):
    assert report(spark, []).collect() == []
