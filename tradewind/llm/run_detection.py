"""Periodic run detection: words that repeat with a period, and the text with each run told once.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
``min_exponent`` periods and ``min_length`` words that no neighbouring word extends. Each of
its words stands in it at least ``min_exponent`` times. So a segment is split at every word
that occurs in it less often, again and again until nothing splits; no run crosses a split.
Only segments that survive are scanned lag by lag. Lags up to ``DIRECT`` compare the whole
segment with itself; longer ones are proposed by exact names of blocks (a block of two
periods meets itself again one period later) and extended word by word, so that a document of
any length costs n log n and not n squared.

Defined cases: null and empty texts have no words and no runs, the collapsed text is empty;
null ids, repeated rows and extra columns are passed over, one row comes out for each row that
goes in; the whole text counts. A document is worked on within one row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Lags that are compared over the whole segment.
DIRECT = 48
#: Bytes of text that one batch of results holds at most, unless a single row is longer.
BATCH_BYTES = 8 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def segments(codes: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """Stretches in which each word occurs ``least`` times or more, found by splitting at rarer ones."""
    done = []
    at, codes = np.arange(len(codes)), np.asarray(codes, np.int64)
    part = np.zeros(len(codes), np.int64)
    while len(at):
        _, name, count = np.unique(part * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
        often = count[name] >= least
        split = np.bincount(part[~often], minlength=part[-1] + 1) > 0
        whole = ~split[part]
        for p in np.flatnonzero(~split):
            lo, hi = np.searchsorted(part, [p, p + 1])
            done.append((int(at[lo]), int(at[hi - 1]) + 1))
        left = often & ~whole
        at, codes = at[left], codes[left]
        part = np.cumsum(np.diff(at, prepend=at[:1]) > 1)
        if len(at):
            long = np.bincount(part)[part] >= shortest
            at, codes = at[long], codes[long]
            part = np.unique(part[long], return_inverse=True)[1]
    return sorted(s for s in done if s[1] - s[0] >= shortest)


def _extended(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The widest stretch round ``at`` in which words ``lag`` apart are equal."""
    lo, hi, n = at, at, len(codes) - lag
    step = lag
    while hi < n:
        stop = min(hi + step, n)
        off = np.flatnonzero(codes[hi:stop] != codes[hi + lag : stop + lag])
        if len(off):
            hi += int(off[0])
            break
        hi, step = stop, step * 2
    step = lag
    while lo > 0:
        stop = max(lo - step, 0)
        off = np.flatnonzero(codes[stop:lo] != codes[stop + lag : lo + lag])
        if len(off):
            lo = stop + int(off[-1]) + 1
            break
        lo, step = stop, step * 2
    return lo, hi + lag


def _direct(codes: np.ndarray, lags: range, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    seen = set()
    for lag in lags:
        need = max(min_length, min_exponent * lag)
        same = codes[lag:] == codes[:-lag]
        if np.count_nonzero(same) < need - lag:
            continue
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        for lo, hi in zip(edge[::2].tolist(), (edge[1::2] + lag).tolist()):
            # A stretch with a smaller period was found at that period, with the same ends.
            if hi - lo >= need and (lo, hi) not in seen:
                seen.add((lo, hi))
                yield lo, hi - lo, lag


class _Blocks:
    """Exact integer names of all blocks of a size: equal names, equal words."""

    def __init__(self, codes: np.ndarray):
        self.power = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]

    @staticmethod
    def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)

    def names(self, size: int) -> np.ndarray:
        k = size.bit_length() - 1
        while len(self.power) <= k:
            last, half = self.power[-1], 1 << (len(self.power) - 1)
            self.power.append(self._pairs(last[:-half], last[half:]))
        last, rest = self.power[k], size - (1 << k)
        return self._pairs(last[: len(last) - rest], last[rest:]) if rest else last


def _proposed(codes: np.ndarray, first: int, min_length: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """Runs with a period of ``first`` or more, for exponents of 4 or more.

    Periods are taken in ranges low..high with high <= 1.25 low. A run of four periods holds,
    behind one of its first low / 2 words, a block of 2 * high words and the same block one
    period on, and no equal block between: its period would be a smaller one.
    """
    n, blocks, low = len(codes), _Blocks(codes), first
    found: dict[int, list[tuple[int, int]]] = {}
    while low <= n // min_exponent:
        high = min(max(low, low * 5 // 4), n // min_exponent)
        names = blocks.names(2 * high)
        order = np.argsort(names, kind="stable")
        again = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        gap = np.zeros(len(names), np.int64)
        gap[order[again]] = order[again + 1] - order[again]
        anchors = np.arange(0, len(names), max(1, low // 2))
        anchors = anchors[(gap[anchors] >= low) & (gap[anchors] <= high)]
        for at, lag in zip(anchors.tolist(), gap[anchors].tolist()):
            spans = found.setdefault(lag, [])
            if spans and spans[-1][0] <= at < spans[-1][1] - lag:
                continue
            lo, hi = _extended(codes, at, lag)
            spans.append((lo, hi))
            if hi - lo >= max(min_length, min_exponent * lag):
                yield lo, hi - lo, lag
        low = high + 1


def runs(codes: np.ndarray, min_length: int, min_exponent: int, direct: int = DIRECT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start, then period."""
    found = []
    for lo, hi in segments(codes, min_exponent, min_length):
        part = codes[lo:hi]
        last = len(part) // min_exponent
        for start, length, lag in _direct(part, range(1, min(last, direct) + 1), min_length, min_exponent):
            found.append((lo + start, length, lag))
        if last > direct:
            for start, length, lag in _proposed(part, direct + 1, min_length, min_exponent):
                found.append((lo + start, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _coded(words: list[bytes]) -> np.ndarray:
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def _found(
    batches: Iterator[pa.RecordBatch], min_length: int, min_exponent: int, direct: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, at = batch.column("text").cast(pa.binary()), 0
        while at < len(column):
            first, size, all_runs, texts = at, 0, [], []
            while at < len(column) and (at == first or size < BATCH_BYTES):
                # bytes.split parts at the blanks of ASCII alone: space and 9 to 13.
                words = (column[at].as_py() or b"").split()
                found = runs(_coded(words), min_length, min_exponent, direct) if len(words) >= min_length else []
                if found:
                    ends = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in found:
                        ends[start + period] += 1
                        ends[start + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(ends)[:-1] == 0)]
                texts.append(b" ".join(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                size += len(texts[-1])
                at += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, at - first),
                    pa.array(all_runs, _ARROW_RUNS),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "runs", "text"],
            )


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, direct: int = DIRECT
) -> DataFrame:
    """``doc_id, runs, text``: every run by start, then period, and the words outside repetitions.

    Words are stretches without the blanks of ASCII, numbered from 0. A word is left out of
    ``text`` if a run contains it behind that run's first period; the rest is joined by one space.
    """
    if min_exponent < 4:
        raise ValueError("blocks propose every period only from four periods on")
    rows = documents(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: _found(batches, min_length, min_exponent, direct),
        f"doc_id {kind}, runs array<{RUN}>, text string",
    )


def longest(runs_column: str) -> Column:
    """The run of greatest length, of those the one that starts first, of those the least period."""
    return F.array_max(
        F.transform(
            runs_column,
            lambda r: F.struct(
                r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less")
            ),
        )
    )


def run_report(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what :func:`periodic_runs` returns."""
    best = F.col("best")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", longest("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["before"]).alias("start"),
        best["length"].alias("length"),
        (-best["less"]).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents of which those with crc32(doc_id) divisible by 10 repeat a stretch to their end.

    With h the checksum and g = floor(h / 10), each word i from a = g % n on becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as empty text.
    """
    rows = documents(docs, "doc_id", "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    planted = rows.withColumn("h", h).withColumn(
        "words", F.expr(r"CASE WHEN h % 10 = 0 THEN filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '') END")
    )
    planted = (
        planted.withColumn("n", F.expr("nullif(size(words), 0)"))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("a", F.expr("cast(g % n as int)"))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    )
    return planted.select(
        "doc_id",
        F.expr(
            "CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(concat(slice(words, 1, a), "
            "transform(sequence(0, n - a - 1), i -> words[a + i % p])), ' ') ELSE text END"
        ).alias("text"),
    )
