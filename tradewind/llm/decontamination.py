"""Benchmark decontamination by greedy string tiling.

A seed is a run of ``SEED_WORDS`` words of a benchmark item (or a whole shorter item). One
pass over the documents keeps, of each, only the stretches that consist of seeds: no tile can
lie elsewhere. Documents and items that share a seed meet in a Spark join, and each pair is
tiled: the longest common runs that don't overlap are marked, again and again, with running
Karp-Rabin hashes, down to the seed's length. An item is leaked if the tiles cover at least
``COVERAGE`` of its words, in whatever order its passages stand in the document.

The pass holds the seeds of a block of items in memory. A block has about ``BLOCK_SEEDS``
seeds; a larger benchmark takes more passes, not more memory, with the same result. Of an
item with n words, any cover of the needed size contains at least ``COVERAGE`` n / seed
length seeds, so its most common seeds, one fewer than that, are left out of the join: it
loses nothing and template phrases don't pair everything with everything.

Defined results: words are compared without case and punctuation; items without words are
never found; repeated items and rows are found one by one; null texts count as empty; null
ids stay null; extra columns are ignored, or kept when filtering; empty tables give an empty
result, or all documents when filtering.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, text_of, unused, with_row_id, written
from .wordhash import LOWER, runs, words

SEED_WORDS = 5
COVERAGE = 0.8
#: Seeds that a pass over the documents holds.
BLOCK_SEEDS = 2_000_000
#: Bits of the table that sorts out most words before the search.
FILTER_BITS = 22
#: Bytes of text that a task looks at together.
CHUNK = 1 << 21

MODULUS, FACTOR = (1 << 61) - 1, 1_000_003


def _lowered(column: str):
    # A separator behind each text keeps the words of neighbours apart.
    return F.concat(F.lower(text_of(column)), F.lit("\n")).cast("binary")


def _item_words(batches: Iterator[pa.RecordBatch], seed_words: int) -> Iterator[pa.RecordBatch]:
    """Words of each item, and the hashes of its seeds."""
    for batch in batches:
        tokens, seeds = [], []
        for text in batch.column("text"):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            starts, ends, hashes = words(data)
            raw = LOWER[data].tobytes()
            tokens.append([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends)])
            seeds.append(np.unique(runs(hashes, min(seed_words, max(len(hashes), 1)))).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item_row"),
                batch.column("item_id"),
                pa.array(tokens, pa.list_(pa.string())),
                pa.array(seeds, pa.list_(pa.int64())),
            ],
            names=["item_row", "item_id", "item", "seeds"],
        )


class _Seeds:
    """Membership of seed hashes: a bit table first, a binary search for what passes it."""

    def __init__(self, hashes: np.ndarray, sizes: list[int]):
        self.hashes, self.sizes = np.sort(hashes.view(np.uint64)), sizes
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def starts(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the runs that are seeds."""
        maybe = np.flatnonzero(self.table[self._slot(hashes)])
        if not len(self.hashes):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def _stretches(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Of each document the stretches of words that consist of seeds; documents without are left out."""
    # Plain arrays are sent: an object of this module could be read only where the module is.
    seeds = _Seeds(*held.value)
    for batch in batches:
        column = batch.column("text")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        everything = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        rows, at, tokens = [], [], []
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            last = min(last, len(column))
            part = everything[offsets[first] : offsets[last]]
            starts, ends, hashes = words(part)
            doc = np.searchsorted(offsets[first : last + 1] - offsets[first], starts, "right") - 1
            change = np.zeros(len(starts) + 1, np.int32)
            for n in seeds.sizes:
                found = seeds.starts(runs(hashes, n))
                found = found[doc[found] == doc[found + n - 1]]
                np.add.at(change, found, 1)
                np.add.at(change, found + n, -1)
            covered = np.cumsum(change)[:-1] > 0
            if covered.any():
                begin = covered & ~np.concatenate([[False], covered[:-1] & (doc[1:] == doc[:-1])])
                lows = np.flatnonzero(begin)
                # A stretch ends where the next one begins or the cover does.
                stops = np.flatnonzero(np.concatenate([begin[1:] | ~covered[1:], [True]]) & covered) + 1
                first_word = np.searchsorted(doc, np.arange(last - first))
                raw = LOWER[part].tobytes()
                for lo, hi in zip(lows, stops):
                    rows.append(first + int(doc[lo]))
                    at.append(int(lo - first_word[doc[lo]]))
                    tokens.append([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[lo:hi], ends[lo:hi])])
            first = last
        take = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row_id").take(take),
                batch.column("doc_id").take(take),
                pa.array(at, pa.int32()),
                pa.array(tokens, pa.list_(pa.string())),
            ],
            names=["row_id", "doc_id", "at", "tokens"],
        )


def _hashes(tokens: list[int]) -> list[int]:
    """Prefix hashes for running Karp-Rabin comparisons."""
    out = [0]
    for t in tokens:
        out.append((out[-1] * FACTOR + t + 2) % MODULUS)
    return out


def tiles(item: list, text: list, minimum: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in text, length), longest first, none overlapping.

    Elements that are None match nothing.
    """
    names = {t: i for i, t in enumerate(set(item))}
    p = [names[t] for t in item]
    t = [names.get(x, -1) for x in text]
    p_hash, t_hash = _hashes(p), _hashes(t)
    p_free, t_free = [True] * len(p), [x >= 0 for x in t]
    found = []

    def free_starts(free: list[bool], size: int) -> Iterator[int]:
        run = 0
        for i, ok in enumerate(free):
            run = run + 1 if ok else 0
            if run >= size:
                yield i - size + 1

    size = min(len(p), len(t))
    while size >= minimum:
        power = pow(FACTOR, size, MODULUS)
        table = defaultdict(list)
        for j in free_starts(t_free, size):
            table[(t_hash[j + size] - t_hash[j] * power) % MODULUS].append(j)
        matches = []
        for i in free_starts(p_free, size):
            best = None
            for j in table.get((p_hash[i + size] - p_hash[i] * power) % MODULUS, ()):
                k = 0
                while i + k < len(p) and j + k < len(t) and p_free[i + k] and t_free[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k >= size and (best is None or k > best[0]):
                    best = (k, i, j)
                    if i + k == len(p) or not p_free[i + k]:
                        break
            if best:
                matches.append(best)
        again = False
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            # Tiles marked meanwhile may have taken a part: what is left may still be a tile.
            while k >= size and not (p_free[i] and t_free[j]):
                k, i, j, again = k - 1, i + 1, j + 1, True
            whole = 0
            while whole < k and p_free[i + whole] and t_free[j + whole]:
                whole += 1
            again |= whole < k
            if whole >= size:
                for x in range(whole):
                    p_free[i + x] = t_free[j + x] = False
                found.append((i, j, whole))
        if matches and again:
            continue  # another place may fit at this length
        size = size // 2 if size > 2 * minimum else minimum if size > minimum else 0
    return found


def _tiled(batches: Iterator[pa.RecordBatch], seed_words: int, coverage: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        keep, shares, found = [], [], []
        for row, (item, stretches) in enumerate(zip(batch.column("item"), batch.column("stretches"))):
            item, text, place = item.as_py(), [], []
            for stretch in stretches.as_py():
                text += [None, *stretch["tokens"]]
                place += [-1, *range(stretch["at"], stretch["at"] + len(stretch["tokens"]))]
            marked = tiles(item, text, min(seed_words, len(item)))
            share = sum(k for _, _, k in marked) / len(item)
            if share >= coverage:
                keep.append(row)
                shares.append(share)
                found.append([{"item_at": i, "doc_at": place[j], "size": k} for i, j, k in sorted(marked)])
        take = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in ("row_id", "doc_id", "item_id")), pa.array(shares, pa.float64()), pa.array(found, kind)],
            names=["row_id", "doc_id", "item_id", "coverage", "tiles"],
        )


def _leaks_of_block(docs: DataFrame, items: DataFrame, seed_words: int, coverage: float) -> DataFrame:
    spark = docs.sparkSession
    kinds = {"doc": docs.schema["doc_id"].dataType.simpleString(), "item": items.schema["item_id"].dataType.simpleString()}
    # The size of a block is bounded, see BLOCK_SEEDS.
    hashes = items.select(F.explode("seeds").alias("h")).distinct().toArrow().column("h").to_numpy()
    sizes = [r.n for r in items.select(F.least(F.size("item"), F.lit(seed_words)).alias("n")).distinct().collect()]
    held = spark.sparkContext.broadcast((np.asarray(hashes, np.int64), sorted(sizes)))
    stretches = written(
        docs.mapInArrow(
            lambda batches: _stretches(batches, held), f"row_id long, doc_id {kinds['doc']}, at int, tokens array<string>"
        ),
        "stretches",
    )

    def seeds_of(tokens: str, size: Column) -> Column:
        last = F.size(tokens) - size
        at = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), last + 1))
        return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, size), " "))

    own_size = F.least(F.size("item"), F.lit(seed_words))
    each = (
        items.select("item_row", F.size("item").alias("n"), own_size.alias("size"), F.explode(seeds_of("item", own_size)).alias("seed"))
        .groupBy("item_row", "n", "size", "seed")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    common = each.groupBy("seed").agg(F.count(F.lit(1)).alias("in_items"))
    order = Window.partitionBy("item_row").orderBy(F.desc("in_items"), "seed")
    spare = F.ceil(F.lit(coverage) * F.col("n") / F.col("size") - F.lit(1e-9)) - 1
    kept = (
        each.join(common, "seed")
        .withColumn("upto", F.sum("times").over(order))
        .filter(F.col("upto") > spare)
        .select("item_row", "seed")
    )
    found = spark.createDataFrame([], "row_id long, seed string")
    for size in sorted(sizes):
        part = stretches.select("row_id", F.explode(seeds_of("tokens", F.lit(size))).alias("seed")).distinct()
        found = found.unionByName(part)
    pairs = found.join(kept, "seed").select("row_id", "item_row").distinct()
    texts = stretches.groupBy("row_id", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("stretches")
    )
    joined = pairs.join(texts, "row_id").join(items.select("item_row", "item_id", "item"), "item_row")
    return joined.select("row_id", "doc_id", "item_id", "item", "stretches").mapInArrow(
        lambda batches: _tiled(batches, seed_words, coverage),
        f"row_id long, doc_id {kinds['doc']}, item_id {kinds['item']}, coverage double, "
        "tiles array<struct<item_at:int,doc_at:int,size:int>>",
    )


def _leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int, coverage: float) -> DataFrame:
    """``row_id, doc_id, item_id, coverage, tiles`` for documents with a ``row_id``."""
    texts = docs.select("row_id", "doc_id", _lowered("text").alias("text"))
    rows = with_row_id(documents(benchmark, "item_id", "text"), "item_row")
    kind = rows.schema["item_id"].dataType.simpleString()
    items = written(
        rows.select("item_row", "item_id", _lowered("text").alias("text"))
        .mapInArrow(
            lambda batches: _item_words(batches, seed_words),
            f"item_row long, item_id {kind}, item array<string>, seeds array<bigint>",
        )
        .filter(F.size("item") > 0),
        "items",
    )
    total = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SEEDS))
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block)
        leaks = _leaks_of_block(texts, part, seed_words, coverage)
        found = leaks if found is None else found.unionByName(leaks)
    return found


def leaked_items(
    docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, coverage: float = COVERAGE
) -> DataFrame:
    """One row per document and item that it leaks: ``doc_id, item_id, coverage, tiles``."""
    rows = with_row_id(documents(docs, "doc_id", "text"))
    return _leaks(rows, benchmark, seed_words, coverage).drop("row_id")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, coverage: float = COVERAGE
) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    key = unused(docs, "leak_row")
    table = written(with_row_id(docs, key), "docs")
    rows = table.select(F.col(key).alias("row_id"), "doc_id", "text")
    gone = _leaks(rows, benchmark, seed_words, coverage).select(F.col("row_id").alias(key)).distinct()
    return table.join(gone, key, "left_anti").select(*docs.columns)
