"""SimHash near-duplicates by a Gray-ordered hierarchical index.

A fingerprint holds one bit per position: set if more than half of the shingle hashes have
it set. Fingerprints that differ in at most ``max_bits`` bits are linked; documents get the
smallest id of their connected component.

The index is a forest of nodes with a mask and the bit pattern its members share under it.
Of ``max_bits + 1`` disjoint masks at least one has no difference between two linked
fingerprints, so each mask is the root of a tree and the equi-grouping on (mask, pattern)
loses no link. A node with too many members is split by ``max_bits + 1`` masks of its free
bits in the same way, again and again: distinct fingerprints run out of bits before they run
out of room, so no node is ever too large for a task, however hot. In a leaf node, members
stand in Gray order, so that neighbours share most bits; runs of them form inner nodes with
the masked pattern they have in common. Pairs of inner nodes are pruned from the top: the
differences under the shared masks add up level by level, and a pair beyond ``max_bits`` is
dropped with everything below it. A leaf emits one link per member at most.

Defined results: null text is empty text; a text with no word has fingerprint zero and is
linked like any other; a null ``doc_id`` is never a component's id unless no other is there;
repeated rows are kept. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import documents, unused, with_row_id, written

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Members of a leaf node; larger nodes are split by further masks.
LEAF = 1024
#: Members of an inner node of the lowest level, and children of each further level.
FAN = 16
#: Shingles whose bits are counted at a time.
CHUNK = 65_536


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a whole text (UTF-8) as an unsigned integer."""
    # Of bytes, lower() touches A-Z only and split() cuts at [\x20\x09-\x0D] only.
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends, at = [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    last = len(tokens) - words + 1
    for lo in range(0, last, CHUNK):
        hi = min(lo + CHUNK, last)
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[lo:hi], ends[lo + words - 1 : hi + words - 1])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    set_bits = counts * 2 > last
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("doc_id"), pa.array(values.view(np.int64))],
            names=["row_id", "doc_id", "fp"],
        )


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``row_id, doc_id, fp`` (the unsigned fingerprint as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("row_id", "doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        lambda batches: _fingerprints(batches, words), f"row_id long, doc_id {kind}, fp long"
    )


def masks_of(free: int, parts: int) -> list[int]:
    """The free bits in ``parts`` disjoint masks of nearly equal size."""
    bits = [b for b in range(BITS) if free >> b & 1]
    return [
        sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _gray_rank(bits: Column) -> Column:
    """The position of a bit pattern in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def _expanded(nodes: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each member of a node once under each child mask of the node's mask."""
    children = None
    for mask, child_masks in masks.items():
        child = F.array(*[F.lit(_signed(m)) for m in child_masks])
        test = F.col("mask") == F.lit(_signed(mask))
        children = F.when(test, child) if children is None else children.when(test, child)
    return nodes.select("fp", F.explode(children).alias("mask")).withColumn(
        "pattern", F.col("fp").bitwiseAND(F.col("mask"))
    )


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mask and pattern of the inner nodes, lowest level first; members are in Gray order."""
    ones, zeros = fps, ~fps
    levels = []
    while len(ones) > 1:
        at = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        levels.append((ones | zeros, ones))
    return levels


def _children(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children (x <= y) of the given pairs of nodes, and their parent pair."""
    i, j = np.divmod(np.arange(FAN * FAN), FAN)
    x = (a[:, None] * FAN + i).ravel()
    y = (b[:, None] * FAN + j).ravel()
    parent = np.repeat(np.arange(len(a)), FAN * FAN)
    keep = (x <= y) & (y < count)
    return x[keep], y[keep], parent[keep]


def close_pairs(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (x < y) of members within ``max_bits``, by descent through the inner nodes."""
    levels = _levels(fps)
    if not levels:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top_mask, _ = levels[-1]
    a = b = np.zeros(1, np.int64)
    known = top_mask[a]
    differ = np.zeros(1, np.uint8)
    steps = [*reversed(levels[:-1]), (np.full(len(fps), np.uint64(2**BITS - 1)), fps)]
    for mask, pattern in steps:
        x, y, parent = _children(a, b, len(mask))
        shared = mask[x] & mask[y]
        fresh = shared & ~known[parent]
        # Bits the parents shared are counted already; only those that come to be fixed here add.
        differ = differ[parent] + np.bitwise_count((pattern[x] ^ pattern[y]) & fresh)
        keep = differ <= max_bits
        a, b, known, differ = x[keep], y[keep], shared[keep], differ[keep]
    apart = a != b
    return a[apart], b[apart]


def _roots(size: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches over the pairs."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _pairs_in_leaves(leaf: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of close members of the same leaf; ``leaf`` holds ascending leaf numbers."""
    starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    sizes = np.diff(np.r_[starts, len(leaf)])
    xs, ys = [], []
    # A leaf of one inner node: its members are compared at once, for all such leaves together.
    small = np.flatnonzero(np.repeat(sizes, sizes) <= FAN)
    for step in range(1, FAN):
        x, y = small[:-step], small[step:]
        near = (leaf[x] == leaf[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= max_bits)
        xs.append(x[near])
        ys.append(y[near])
    for start, size in zip(starts[sizes > FAN], sizes[sizes > FAN]):
        x, y = close_pairs(fps[start : start + size], max_bits)
        xs.append(x + start)
        ys.append(y + start)
    return np.concatenate(xs), np.concatenate(ys)


def _leaf_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each leaf; the rows of a leaf stand together, in Gray order."""

    def links(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        leaf = np.cumsum(np.r_[0, np.any(key[1:] != key[:-1], axis=1)])
        root = _roots(len(fps), *_pairs_in_leaves(leaf, fps, max_bits))
        child = np.flatnonzero(root != np.arange(len(fps)))
        ends = [pa.array(fps[at].view(np.int64)) for at in (child, root[child])]
        return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

    rest_key, rest_fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        key = np.stack([np.asarray(batch.column("mask")), np.asarray(batch.column("pattern"))], axis=1)
        key = np.concatenate([rest_key, key])
        fps = np.concatenate([rest_fp, np.asarray(batch.column("fp")).view(np.uint64)])
        if not len(fps):
            continue
        # The last leaf may go on in the next batch.
        other = np.flatnonzero(np.any(key != key[-1], axis=1))
        start = other[-1] + 1 if len(other) else 0
        if start:
            yield links(key[:start], fps[:start])
        rest_key, rest_fp = key[start:], fps[start:]
    if len(rest_fp):
        yield links(rest_key, rest_fp)


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """Links ``u, v`` that connect exactly the fingerprints which linked pairs connect.

    ``distinct`` has one row per fingerprint in column ``fp``.
    """
    spark = distinct.sparkSession
    everything = (1 << BITS) - 1
    nodes = _expanded(distinct.select("fp", F.lit(0).cast("long").alias("mask")), {0: masks_of(everything, max_bits + 1)})
    found = spark.createDataFrame([], "u long, v long")
    while True:
        key = ["mask", "pattern"]
        sizes = written(nodes.groupBy(*key).count().filter("count > 1"), "sizes")
        members = written(nodes.join(sizes, key), "nodes")
        free_bits = F.col("fp").bitwiseAND(F.bitwise_not(F.col("mask")))
        leaves = (
            members.filter(F.col("count") <= leaf)
            .repartition(*key)
            .withColumn("rank", _gray_rank(free_bits))
            .sortWithinPartitions(*key, "rank")
            .select("mask", "pattern", "fp")
        )
        found = found.unionByName(leaves.mapInArrow(lambda b: _leaf_links(b, max_bits), "u long, v long"))
        big = members.filter(F.col("count") > leaf)
        # One row per mask of the level: (max_bits + 1) ** depth at most.
        big_masks = [r.mask % (1 << BITS) for r in big.select("mask").distinct().collect()]
        if not big_masks:
            return found
        split = {m: [m | c for c in masks_of(everything & ~m, max_bits + 1)] for m in big_masks}
        nodes = _expanded(big.select("fp", "mask"), split).distinct()


def _row_components(rows: DataFrame, max_bits: int, leaf: int) -> DataFrame:
    """``row_id, doc_id, fp, root, component_id`` from the table of fingerprints."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = written(fingerprint_links(distinct.select("fp"), max_bits, leaf), "links")
    roots = components(links, "u", "v")
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = written(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    return rows.join(of_fp, "fp")


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, leaf: int = LEAF
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    rows = written(fingerprints(with_row_id(documents(docs, "doc_id", "text")), words), "fps")
    return _row_components(rows, max_bits, leaf).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, leaf: int = LEAF
) -> DataFrame:
    """The documents with the smallest id of their component, one of each, with all columns.

    Of equal ids the row read first stays; documents without an id stay only where their
    component has no other.
    """
    key = unused(docs, "neardup_row")
    table = written(with_row_id(docs, key), "docs")
    rows = written(fingerprints(table.select(F.col(key).alias("row_id"), "doc_id", "text"), words), "fps")
    found = _row_components(rows, max_bits, leaf)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))
    stay = found.groupBy("root").agg(first.alias("best")).select(F.col("best.row_id").alias(key))
    return table.join(stay, key, "left_semi").select(*docs.columns)
