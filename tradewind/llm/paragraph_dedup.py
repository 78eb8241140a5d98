"""Repeated paragraphs across documents: MinHash banding, exact verification, components.

A paragraph is a line with at least ``min_words`` words. Paragraphs with the same words are
one class, so copies cost one row per task. Each class has a MinHash signature over its
shingles of ``SHINGLE_WORDS`` words, cut into bands that are tuned for recall at the
similarity threshold. Classes that collide in a band are compared by their exact Jaccard
similarity, and the links' connected components are the groups of repeats: the first
paragraph stays, the others are removals.

A band's bucket may hold any number of classes, so pairs are never spelled out: in each
round every bucket compares a few pivots with all its members, drops the pivots, and is done
when all members left are in one component. Members that are connected already need no
comparison, so a group of close copies costs one row per member; buckets that stay apart get
``GROWTH`` times the pivots in each round, until every pair that matters has been compared. Within
buckets of more than ``SMALL`` classes, pairs that can't be similar are left out by two exact
bounds on their intersection: shingles that no other class of such buckets has are in none,
and of the first pivot's shingles (64 of them, as bits) those that either of the two lacks
aren't either. So few of the many loose copies of one text are ever compared. No bucket is
capped.

Passages that stand inside longer lines, or run over line breaks, are paragraphs of their own:
:func:`repeated_pieces` cuts each text at points that its words choose. Of every ``PIECE_STARTS``
pieces of ``PIECE_WORDS`` words that begin one word after the other, the one with the least hash
is a paragraph. The choice depends on the words alone, so any run of ``PIECE_STARTS`` +
``PIECE_WORDS`` - 1 words (50) holds a piece that is chosen wherever the run stands. Pieces have
one band, their words; 96 bits of hashes decide that they are equal. Neighbours in step with the
same first place are joined to the passage that they cover, so a group of any number of copies
costs a row per copy and piece.

Defined results: words are compared without case and punctuation; shorter paragraphs are
never repeats; repeats within one document only are not reported; null texts count as empty;
the first paragraph is that of the smallest id (nulls last), then of the row read first, then
of the earliest line; extra columns are ignored, or kept when removing; empty tables give
empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import documents, text_of, unused, with_row_id, written
from .wordhash import BASE, STEP, mixed, runs, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Words below which a line is no paragraph.
MIN_WORDS = 20
#: Share of the pairs at the threshold that must meet in a band, and hashes per band.
RECALL, BAND_ROWS = 0.995, 4
#: Classes in a bucket up to which all pairs are compared.
SMALL = 8
#: How many times the pivots of a bucket grow from round to round.
GROWTH = 1024
#: Shingles of a pivot that the others' bit patterns tell about.
BITS = 64
#: Words of a piece that a text is cut into, and neighbouring pieces of which one is chosen.
PIECE_WORDS, PIECE_STARTS = 25, 26
#: Bytes of text that a task looks at together.
CHUNK = 1 << 21


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes such that a pair at the threshold meets with at least ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 2**63, (2, count), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return numbers[0], numbers[1]


def _paragraphs(part: np.ndarray, offsets: np.ndarray, least: int):
    """Paragraphs of the documents that begin at ``offsets`` of the bytes ``part``.

    Returns, per paragraph: document, line, first word, number of words; and all words.
    """
    starts, ends, hashes = words(part)
    breaks = np.flatnonzero(part == 10)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, starts, ends, hashes
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    count = np.diff(np.concatenate([first, [len(line)]]))
    keep = count >= least
    first, count = first[keep], count[keep]
    doc = np.searchsorted(offsets, starts[first], "right") - 1
    # Lines of a document count from its first byte; each text ends with a line break.
    before = np.searchsorted(breaks, offsets[doc])
    return doc, line[first] - before, first, count, starts, ends, hashes


def _class_hashes(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each paragraph's sequence of words."""
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    skip = np.cumsum(count) - count
    place = np.arange(count.sum()) - np.repeat(skip, count)
    own = hashes[place + np.repeat(first, count)]
    out = []
    with np.errstate(over="ignore"):
        for base, seed in ((BASE, np.uint64(0)), (STEP, np.uint64(0x5851F42D4C957F2D))):
            # Each word is mixed with its place: sums of products would agree on some long sequences.
            keys = np.cumprod(np.full(count.max(), base, np.uint64))
            total = np.add.reduceat(mixed((own ^ seed) + keys[place]), skip)
            out.append(mixed(total + count.astype(np.uint64)))
    return out[0], out[1]


def _bands(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, one row per paragraph."""
    keys = np.empty((len(first), bands), np.uint64)
    if not len(first):
        return keys
    shingles = runs(hashes, SHINGLE_WORDS)
    size = count - SHINGLE_WORDS + 1
    skip = np.cumsum(size) - size
    own = shingles[np.arange(size.sum()) - np.repeat(skip, size) + np.repeat(first, size)]
    flips, factors = _permutations(bands * rows)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(first), np.uint64(band + 1))
            for k in range(band * rows, (band + 1) * rows):
                key = key * BASE + mixed(np.minimum.reduceat((own ^ flips[k]) * factors[k], skip))
            keys[:, band] = mixed(key)
    return keys


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents of a column in parts of about ``CHUNK`` bytes: first, last, bytes, offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, everything[offsets[first] : offsets[last]], offsets[first:last] - offsets[first]
        first = last


def _units(batches: Iterator[pa.RecordBatch], least: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, part, offsets in _chunks(batch.column("text")):
            doc, line, first, count, _, _, hashes = _paragraphs(part, offsets, least)
            c1, c2 = _class_hashes(hashes, first, count)
            keys = _bands(hashes, first, count, bands, rows)
            take = pa.array(doc + lo, pa.int64())
            cuts = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(take),
                    batch.column("doc_id").take(take),
                    pa.array(line.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(c1.view(np.int64)),
                    pa.array(c2.view(np.int64)),
                    pa.ListArray.from_arrays(cuts, pa.array(keys.ravel().view(np.int64))),
                ],
                names=["row_id", "doc_id", "line", "n_words", "c1", "c2", "bands"],
            )


def _extreme(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of every ``size`` neighbours."""
    span = 1
    while 2 * span <= size:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return pick(values[:-rest], values[rest:]) if rest else values


def _chosen(hashes: np.ndarray, doc: np.ndarray, size: int, starts: int) -> np.ndarray:
    """First words of the chosen pieces; ``doc`` tells the document of each word."""
    length = size + starts - 1
    if len(hashes) < length:
        return np.empty(0, np.int64)
    own = runs(hashes, size)
    least = _extreme(own, starts, np.minimum)
    # A stretch that runs over two documents chooses nothing.
    inside = doc[: len(least)] == doc[length - 1 :]
    least = np.where(inside, least, np.uint64(0))
    padding = np.zeros(starts - 1, np.uint64)
    greatest = _extreme(np.concatenate([padding, least, padding]), starts, np.maximum)
    return np.flatnonzero((greatest == own) & (own != 0))


def _pieces(batches: Iterator[pa.RecordBatch], size: int, starts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, part, offsets in _chunks(batch.column("text")):
            begins, _, hashes = words(part)
            doc = np.searchsorted(offsets, begins, "right") - 1
            first = _chosen(hashes, doc, size, starts)
            c1, c2 = _class_hashes(hashes, first, np.full(len(first), size))
            before = np.searchsorted(begins, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id").take(pa.array(doc[first] + lo, pa.int64())),
                    pa.array((first - before[doc[first]]).astype(np.int32)),
                    pa.array(c1.view(np.int64)),
                    pa.array((c2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                ],
                names=["row_id", "word", "c1", "c2"],
            )


def _contents(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The words of each paragraph, joined by blanks, under its class."""
    for batch in batches:
        for _, _, part, offsets in _chunks(batch.column("text")):
            _, _, first, count, starts, ends, hashes = _paragraphs(part, offsets, least)
            c1, c2 = _class_hashes(hashes, first, count)
            raw = part.tobytes()
            # Without the bytes between words, classes are compared by their words alone.
            texts = [raw[starts[f] : ends[f + n - 1]] for f, n in zip(first, count)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(texts, pa.binary())],
                names=["c1", "c2", "content"],
            )


def shingles(content: bytes) -> set[tuple[bytes, ...]]:
    """The distinct runs of words of a paragraph."""
    data = np.frombuffer(content, np.uint8)
    starts, ends, _ = words(data)
    raw = content.lower()
    found = [raw[s:e] for s, e in zip(starts, ends)]
    return set(zip(*(found[k:] for k in range(SHINGLE_WORDS))))


def jaccard(a: set, b: set) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common) if a or b else 1.0


def _bits(own: set, pivot: list) -> int:
    """Which of the pivot's first shingles a paragraph has, as a signed 64-bit number."""
    value = sum(1 << i for i, shingle in enumerate(pivot[:BITS]) if shingle in own)
    return value - (1 << 64) if value >> 63 else value


def _compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Each pair's verdict, the size of its intersection, and either side's bits as seen by the other."""
    for batch in batches:
        columns, last = ([], [], [], []), (None, None, None)
        for u, a, b in zip(batch.column("u"), batch.column("a"), batch.column("b")):
            if last[0] != u.as_py():
                own = shingles(a.as_py())
                last = (u.as_py(), own, sorted(own))
            other = shingles(b.as_py())
            values = (
                jaccard(last[1], other) >= similarity,
                len(last[1] & other),
                _bits(last[1], sorted(other)),
                _bits(other, last[2]),
            )
            for column, value in zip(columns, values):
                column.append(value)
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("u", "v", "ru", "rv")), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["u", "v", "ru", "rv", "similar", "common", "u_bits", "v_bits"],
        )


def _shingle_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for row, content in enumerate(batch.column("content")):
            _, _, hashes = words(np.frombuffer(content.as_buffer(), np.uint8))
            own = np.unique(runs(hashes, SHINGLE_WORDS))
            rows.append(np.full(len(own), row, np.int32))
            found.append(own)
        take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32))
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("cid").take(take), pa.array(h.view(np.int64))], names=["cid", "h"])


def _sizes(contents: DataFrame) -> DataFrame:
    """``cid, size, alone``: shingles of a class, and how many of them no other class here has.

    Two shingles with the same hash only ever look shared.
    """
    pieces = contents.mapInArrow(_shingle_hashes, "cid long, h long")
    by_hash = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid"))
    alone = by_hash.filter("n = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
    sizes = pieces.groupBy("cid").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(alone, "cid", "left").select("cid", "size", F.coalesce("alone", F.lit(0)).alias("alone"))


def _links(members: DataFrame, contents: DataFrame, bands: DataFrame, similarity: float) -> DataFrame:
    """Links that connect exactly what all similar pairs within the buckets connect.

    ``members`` has ``key, cid, n``, the size of the bucket; ``contents`` has ``cid, content``,
    ``bands`` has ``cid, bands``, all its keys.
    """
    spark = members.sparkSession
    links = spark.createDataFrame([], "u long, v long")
    compared = links
    members = members.withColumn("root", F.col("cid")).withColumn("crowded", F.col("n") > SMALL).drop("n")
    sizes = _sizes(contents.join(members.filter("crowded").select("cid").distinct(), "cid", "left_semi"))
    members = members.join(sizes, "cid", "left")
    # A class whose shared shingles are too few for any partner: the partner is at least as large as they are.
    hopeless = F.col("crowded") & (F.col("size") - F.col("alone") < similarity * F.col("size") - 1e-9)
    members = members.filter(~F.coalesce(hopeless, F.lit(False)))
    # What the first pivot tells: its size, the member's bits, and its other shingles that are shared.
    unknown = F.lit(None).cast("long")
    no_bands = F.lit(None).cast("array<bigint>")
    members = members.withColumns({"first_size": unknown, "bits": unknown, "rest": unknown, "bands": no_bands})
    carried = ("cid", "root", "size", "alone", "first_size", "bits", "rest", "bands")
    pivots_per_bucket = 1
    while True:
        # A bucket whose members are all connected is done.
        span = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        members = written(members.drop("low").join(span.select("key", "low"), "key"), "members")
        if members.isEmpty():
            return links
        salt = F.when(F.col("crowded"), F.pmod(F.xxhash64("cid"), F.lit(pivots_per_bucket))).otherwise(F.col("cid"))
        # The first pivot has the fewest shingles of its own: it is close to most of its bucket.
        # Later ones come from what it left out.
        choice = members if pivots_per_bucket == 1 else members.filter("root <> low")
        pivots = written(
            choice.groupBy("key", salt.alias("salt"))
            .agg(F.min(F.struct("alone", *[c for c in carried if c != "alone"])).alias("p"))
            .select("key", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in carried]),
            "pivots",
        )
        # J >= t needs an intersection of t / (1 + t) of both sizes together.
        together = F.least(F.col("size") - F.col("alone"), F.col("pivot_size") - F.col("pivot_alone"))
        needed = similarity / (1 + similarity) * (F.col("size") + F.col("pivot_size")) - 1e-9
        missed = F.least("first_size", F.lit(BITS)) - F.bit_count(F.col("bits").bitwiseAND(F.col("pivot_bits")))
        within = F.col("first_size") - missed + F.least("rest", "pivot_rest")
        # After the first round a pair that shares several buckets is taken in the least of them.
        first_shared = F.array_min(F.array_intersect("bands", "pivot_bands")) == F.col("key")
        met = members.join(
            pivots.withColumnRenamed("key", "pivot_key"),
            (F.col("key") == F.col("pivot_key"))
            & F.coalesce(first_shared, F.lit(True))
            & (F.col("root") != F.col("pivot_root"))
            & (~F.col("crowded") | ((together >= needed) & F.coalesce(within >= needed, F.lit(True)))),
        )
        ends = [(F.col("cid"), F.col("root")), (F.col("pivot_cid"), F.col("pivot_root"))]
        low, high = (f(*[F.struct(c.alias("cid"), r.alias("root")) for c, r in ends]) for f in (F.least, F.greatest))
        pairs = met.select(low.alias("low"), high.alias("high")).distinct().select(
            F.col("low.cid").alias("u"), F.col("high.cid").alias("v"), F.col("low.root").alias("ru"), F.col("high.root").alias("rv")
        )
        pairs = written(pairs.join(compared, ["u", "v"], "left_anti"), "pairs")
        compared = compared.unionByName(pairs.select("u", "v"))
        sides = pairs.join(contents.select(F.col("cid").alias("v"), F.col("content").alias("b")), "v").join(
            contents.select(F.col("cid").alias("u"), F.col("content").alias("a")), "u"
        )
        verdicts = written(
            sides.select("u", "v", "ru", "rv", "a", "b").mapInArrow(
                lambda b: _compared(b, similarity),
                "u long, v long, ru long, rv long, similar boolean, common long, u_bits long, v_bits long",
            ),
            "verdicts",
        )
        found = verdicts.filter("similar").select("u", "v", "ru", "rv")
        links = links.unionByName(found.select("u", "v"))
        done = pivots.select("key", F.col("pivot_cid").alias("cid"))
        members = members.join(done, ["key", "cid"], "left_anti")
        if pivots_per_bucket == 1:
            seen = verdicts.select(F.col("u").alias("cid"), F.col("v").alias("pivot_cid"), "common", F.col("u_bits").alias("bits"))
            seen = seen.unionByName(
                verdicts.select(F.col("v").alias("cid"), F.col("u").alias("pivot_cid"), "common", F.col("v_bits").alias("bits"))
            )
            rest = F.greatest(F.col("size") - F.col("common") - F.col("alone"), F.lit(0))
            members = (
                members.drop("first_size", "bits", "rest", "bands")
                .join(bands, "cid")
                .join(pivots.filter(F.col("pivot_size").isNotNull()).select("key", "pivot_cid", F.col("pivot_size").alias("first_size")), "key", "left")
                .join(seen, ["cid", "pivot_cid"], "left")
                .withColumn("rest", rest)
                .drop("pivot_cid", "common")
            )
        members = written(members, "members")
        if members.isEmpty():
            return links
        if not found.isEmpty():
            roots = components(found, "ru", "rv").select(F.col("node").alias("root"), F.col("root").alias("new_root"))
            members = members.join(roots, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        pivots_per_bucket *= GROWTH


def _clusters(docs: DataFrame, min_words: int, similarity: float, recall: float) -> DataFrame:
    """``row_id, doc_id, line, n_words, component, component_size, kept`` of repeated paragraphs."""
    least = max(min_words, SHINGLE_WORDS)
    bands = bands_for(similarity, recall, BAND_ROWS)
    lowered = F.concat(F.lower(text_of()), F.lit("\n")).cast("binary")
    texts = docs.select("row_id", "doc_id", lowered.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    units = written(
        texts.mapInArrow(
            lambda batches: _units(batches, least, bands, BAND_ROWS),
            f"row_id long, doc_id {kind}, line int, n_words int, c1 long, c2 long, bands array<bigint>",
        ),
        "units",
    )
    classes = units.groupBy("c1", "c2").agg(F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("cid", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(buckets.join(shared, "key").select("key", "cid", "n"), "members")
    wanted = classes.select("c1", "c2", "cid").join(members.select("cid"), "cid", "left_semi")
    contents = texts.select("text").mapInArrow(
        lambda batches: _contents(batches, least), "c1 long, c2 long, content binary"
    )
    # min: which copy's punctuation it is makes no difference, but all must see the same one.
    contents = written(
        contents.join(wanted, ["c1", "c2"]).groupBy("cid").agg(F.min("content").alias("content")), "contents"
    )
    links = _links(members, contents, classes.select("cid", "bands"), similarity)
    roots = components(links, "u", "v").withColumnRenamed("node", "cid")
    placed = classes.select("c1", "c2", "cid").join(roots, "cid", "left").select(
        "c1", "c2", F.coalesce("root", "cid").alias("component")
    )
    placed = written(placed, "placed")
    rows = units.drop("bands").join(placed, ["c1", "c2"]).drop("c1", "c2")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id", "line"))
    groups = (
        rows.groupBy("component")
        .agg(
            first.alias("first"),
            F.count(F.lit(1)).alias("component_size"),
            F.min("row_id").alias("low"),
            F.max("row_id").alias("high"),
        )
        .filter("low < high")
        .select("component", "first", "component_size")
    )
    groups = written(groups, "groups")
    kept = (F.col("row_id") == F.col("first.row_id")) & (F.col("line") == F.col("first.line"))
    return rows.join(groups, "component").select(
        "row_id", "doc_id", "line", "n_words", "component", "first", "component_size", kept.alias("kept")
    )


def repeated_paragraphs(
    docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """One row per paragraph that repeats across documents.

    ``doc_id, line, n_words, first_doc, first_line, group_size, kept``; (``first_doc``,
    ``first_line``) names the group by the paragraph that stays.
    """
    found = _clusters(with_row_id(documents(docs, "doc_id", "text")), min_words, similarity, recall)
    return found.select(
        "doc_id",
        "line",
        "n_words",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.line").alias("first_line"),
        F.col("component_size").alias("group_size"),
        "kept",
    )


def repeated_pieces(docs: DataFrame, size: int = PIECE_WORDS, starts: int = PIECE_STARTS) -> DataFrame:
    """One row per passage of ``size`` words or more that stands in several documents.

    ``doc_id, first_word, n_words, first_doc, source_word, group_size, kept``: words count from
    0 in the document, (``first_doc``, ``source_word``) is the first place of the passage, which
    stays; ``group_size`` counts the places of its most frequent piece. Every run of
    ``size + starts - 1`` words that stands in several documents is met; of shorter ones some.
    """
    rows = written(with_row_id(documents(docs, "doc_id", "text")), "docs")
    lowered = F.concat(F.lower(text_of()), F.lit("\n")).cast("binary")
    pieces = written(
        rows.select("row_id", lowered.alias("text")).mapInArrow(
            lambda batches: _pieces(batches, size, starts), "row_id long, word int, c1 long, c2 int"
        ),
        "pieces",
    )
    several = pieces.groupBy("c1").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high")).filter("low < high")
    shared = written(
        pieces.join(several.select(F.col("c1").alias("c1")), "c1").join(
            rows.select("row_id", F.col("doc_id").isNull().alias("no_id"), "doc_id"), "row_id"
        ),
        "shared",
    )
    at = F.struct("no_id", "doc_id", "row_id", "word")
    groups = (
        shared.groupBy("c1", "c2")
        .agg(
            F.min(at).alias("first"),
            F.count(F.lit(1)).alias("places"),
            F.min("row_id").alias("low"),
            F.max("row_id").alias("high"),
        )
        .filter("low < high")
        .select("c1", "c2", "first", "places")
    )
    # Pieces in step with their first places, and not more than a choice apart, are one passage.
    step = F.col("word") - F.col("first.word")
    along = Window.partitionBy("row_id", "first.row_id", "step").orderBy("word")
    gap = F.col("word") > F.lag("word", 1, -1 - starts).over(along) + starts
    found = (
        shared.join(groups, ["c1", "c2"])
        .withColumn("step", step)
        .withColumn("gap", gap.cast("int"))
        .withColumn("run", F.sum("gap").over(along))
    )
    passages = found.groupBy("row_id", "doc_id", F.col("first.row_id").alias("source"), "step", "run").agg(
        F.min("word").alias("first_word"),
        (F.max("word") - F.min("word") + size).alias("n_words"),
        F.min("first").alias("first"),
        F.max("places").alias("group_size"),
    )
    return passages.select(
        "doc_id",
        "first_word",
        "n_words",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.word").alias("source_word"),
        "group_size",
        ((F.col("row_id") == F.col("source")) & (F.col("step") == 0)).alias("kept"),
    )


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated lines and repeated pieces in one table.

    Rows of lines have ``line, first_line``, rows of pieces ``first_word, source_word``.
    """
    lines = repeated_paragraphs(docs)
    return lines.unionByName(repeated_pieces(docs), allowMissingColumns=True)


def remove_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """The documents without the lines that repeat an earlier one, with all their columns."""
    key, gone = unused(docs, "repeat_row"), unused(docs, "repeat_lines")
    table = written(with_row_id(docs, key), "docs")
    rows = table.select(F.col(key).alias("row_id"), "doc_id", "text")
    lines = (
        _clusters(rows, min_words, similarity, recall)
        .filter("not kept")
        .groupBy(F.col("row_id").alias(key))
        .agg(F.collect_set("line").alias(gone))
    )
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return table.join(lines, key, "left").withColumn("text", text).select(*docs.columns)
