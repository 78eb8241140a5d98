"""Repeated passages across documents, wherever they stand: inside longer lines or over line breaks.

A passage is a run of at least ``PASSAGE_WORDS`` words, whatever the lines. It is found by its
windows of that many words. Each window has an anchor, the least hash of the runs of
``ANCHOR_WORDS`` words in it; equal windows have equal anchors, so only windows whose anchor
stands in several texts are looked at. Neighbours with one anchor are a group, a row. Where all
groups of an anchor are equal they repeat as a whole; for other anchors, at the ends of
passages, one group of each kind is taken apart and its windows are looked up one by one. Each
window is named by its first place, and windows that follow each other both here and there are
joined to one passage of maximal length. Equal texts are one text until the end, and no pairs
of documents are made: a passage of any number of copies costs a row per copy and group.

Defined results: words are compared without case and punctuation, windows by 128 bits of
hashes; repeats within one document only are not reported; null texts count as empty; the
first place is in the document of the smallest id (nulls last), then of the row read first,
then at the earliest word; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paragraph_dedup import _chunks
from .shared import documents, text_of, with_row_id, written
from .wordhash import runs, words

PASSAGE_WORDS = 50
ANCHOR_WORDS = 25
#: Windows in a group at most: fewer than words in a window, so its two ends tell it.
GROUP_WINDOWS = 32


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _windows(part: np.ndarray, offsets: np.ndarray, size: int, anchor: int):
    """Windows of the documents that begin at ``offsets``: document, first word, anchor; and all words."""
    starts, _, hashes = words(part)
    if len(hashes) < size:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), starts, hashes
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
    return doc[first], first, _least(runs(hashes, anchor), size - anchor + 1)[first], starts, hashes


def _changes(doc: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Where windows begin whose document or anchor is not that of the window before."""
    return np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchors[1:] != anchors[:-1])]))


def _anchors(batches: Iterator[pa.RecordBatch], size: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, _, part, offsets in _chunks(batch.column("text")):
            doc, _, found, _, _ = _windows(part, offsets, size, anchor)
            if len(doc):
                new = _changes(doc, found)
                rows = batch.column("t").take(pa.array(doc[new] + lo, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array(found[new].view(np.int64))], names=["t", "a"])


def _groups(batches: Iterator[pa.RecordBatch], size: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Groups of windows whose anchor is among those of ``anchors``."""
    for batch in batches:
        for lo, hi, part, offsets in _chunks(batch.column("text")):
            doc, first, found, starts, hashes = _windows(part, offsets, size, anchor)
            if not len(doc):
                continue
            new = _changes(doc, found)
            count = np.diff(np.append(new, len(doc)))
            parts = -(-count // GROUP_WINDOWS)
            turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            new = np.repeat(new, parts) + turn * GROUP_WINDOWS
            count = np.minimum(np.repeat(count, parts) - turn * GROUP_WINDOWS, GROUP_WINDOWS)
            wanted = batch.column("anchors").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
            keep = np.isin(found[new], wanted.view(np.uint64))
            new, count = new[keep], count[keep]
            cuts = np.concatenate([[0], np.cumsum(count)])
            place = np.arange(cuts[-1]) - np.repeat(cuts[:-1], count) + np.repeat(new, count)
            own = pa.array(runs(hashes, size)[first[place]].view(np.int64))
            before = np.searchsorted(starts, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("t").take(pa.array(doc[new] + lo, pa.int64())),
                    pa.array((first[new] - before[doc[new]]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(found[new].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), own),
                ],
                names=["t", "place", "n", "a", "w"],
            )


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``t, text`` with a key of the text, and ``row_id, doc_id, t``; no two texts share a key."""
    text, seed = text_of(), 0
    while True:
        key = F.xxhash64(F.lit(seed), text)
        rows = written(
            with_row_id(documents(docs, "doc_id", "text")).select("row_id", "doc_id", key.alias("t"), F.md5(text).alias("check")),
            "rows",
        )
        if rows.groupBy("t").agg(F.min("check").alias("u"), F.max("check").alias("v")).filter("u < v").isEmpty():
            lowered = F.concat(F.lower(text), F.lit("\n")).cast("binary")
            return docs.select(key.alias("t"), lowered.alias("text")), rows.drop("check")
        seed += 1


def _spans(groups: DataFrame, firsts: DataFrame) -> DataFrame:
    """``t, place, n, first``: windows that repeat, in step with their first place."""
    kind = ["a", "n", "c1", "c2"]
    narrow = groups.withColumns({"c1": F.col("w")[0], "c2": F.element_at("w", -1)})
    # A window that stands twice in its group may have its first place before that of the group.
    narrow = narrow.withColumn("twice", F.size(F.array_distinct("w")) < F.col("n")).drop("w")
    placed = narrow.join(firsts, "t").select(
        *kind, "twice", "several", "t", F.struct("no_id", "doc_id", "row_id", "place", "t").alias("first")
    )
    many = F.max(F.col("several")).alias("several")
    kinds = written(
        placed.groupBy(*kind).agg(
            F.min("first").alias("first"), F.min("t").alias("low"), F.max("t").alias("high"), many, F.max("twice").alias("twice")
        ),
        "kinds",
    )
    repeats = (F.col("low") < F.col("high")) | F.col("several")
    mixed = kinds.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("more"), F.max("twice").alias("any")).filter("more or any")
    whole = kinds.join(mixed, "a", "left_anti").filter(repeats).select(*kind, F.lit(0).alias("j"), F.col("n").alias("m"), "first")
    taken = kinds.join(mixed.select("a"), "a").withColumns({"t": F.col("first.t"), "place": F.col("first.place")})
    each = written(
        taken.join(groups.select("t", "place", "w"), ["t", "place"]).select(
            *kind, "first", "low", "high", "several", F.posexplode("w").alias("j", "w")
        ),
        "each",
    )
    at = F.struct("first.no_id", "first.doc_id", "first.row_id", (F.col("first.place") + F.col("j")).alias("place"), "first.t")
    known = (
        each.groupBy("a", "w")
        .agg(F.min(at).alias("source"), F.min("low").alias("low"), F.max("high").alias("high"), many)
        .filter(repeats)
        .select("a", "w", "source")
    )
    single = each.select(*kind, "j", "w").join(known, ["a", "w"]).select(*kind, "j", F.lit(1).alias("m"), F.col("source").alias("first"))
    # The windows of one kind of group in step with their first places, in runs.
    step = F.col("first.place") - F.col("j")
    along = Window.partitionBy(*kind, "first.row_id", "step").orderBy("j")
    single = (
        single.withColumn("step", step)
        .withColumn("run", F.col("j") - F.row_number().over(along))
        .groupBy(*kind, "first.row_id", "step", "run")
        .agg(F.min("j").alias("j"), F.sum("m").cast("int").alias("m"), F.min("first").alias("first"))
        .select(*kind, "j", "m", "first")
    )
    found = written(whole.unionByName(single), "found")
    return narrow.select("t", "place", *kind).join(found, kind).select("t", (F.col("place") + F.col("j")).alias("place"), "m", "first")


def repeated_passages(docs: DataFrame, size: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """One row per passage that repeats across documents.

    ``doc_id, first_word, n_words, source_doc, source_word, kept``: words count from 0 in the
    document; (``source_doc``, ``source_word``) is the first place of the passage, which stays.
    """
    if not 1 <= anchor <= size or size <= GROUP_WINDOWS:
        raise ValueError(f"passages need more than {GROUP_WINDOWS} words, and anchors at most as many as they")
    texts, rows = _texts(docs)
    firsts = written(
        rows.groupBy("t")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("f"), (F.count(F.lit(1)) > 1).alias("several"))
        .select("t", "f.*", "several"),
        "firsts",
    )
    anchors = written(texts.mapInArrow(lambda b: _anchors(b, size, anchor), "t long, a long").distinct(), "anchors")
    shared = anchors.groupBy("a").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low < high").select("a")
    wanted = anchors.join(shared, "a").unionByName(anchors.select("a", "t").join(firsts.filter("several").select("t"), "t"))
    wanted = wanted.groupBy("t").agg(F.collect_set("a").alias("anchors"))
    groups = written(
        texts.join(wanted, "t")
        .mapInArrow(lambda b: _groups(b, size, anchor), "t long, place int, n int, a long, w array<bigint>")
        .dropDuplicates(["t", "place"]),
        "groups",
    )
    # Spans in step with their first places, and without a gap, are one passage.
    spans = _spans(groups, firsts).withColumn("step", F.col("place") - F.col("first.place"))
    along = Window.partitionBy("t", "first.row_id", "step").orderBy("place")
    gap = F.col("place") > F.lag(F.col("place") + F.col("m"), 1, 0).over(along)
    passages = (
        spans.withColumn("gap", gap.cast("int"))
        .withColumn("run", F.sum("gap").over(along))
        .groupBy("t", F.col("first.row_id").alias("source_row"), "step", "run")
        .agg(
            F.min("place").alias("first_word"),
            (F.sum("m") + F.lit(size - 1)).cast("int").alias("n_words"),
            F.min("first").alias("first"),
        )
    )
    return rows.join(passages, "t").select(
        "doc_id",
        "first_word",
        "n_words",
        F.col("first.doc_id").alias("source_doc"),
        F.col("first.place").alias("source_word"),
        # A repeat in its own source document stays too, if it stands at the first place.
        ((F.col("row_id") == F.col("source_row")) & (F.col("step") == 0)).alias("kept"),
    )
