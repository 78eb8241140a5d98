"""Ranked lexical search by pipelined term partitioning.

Every term of the queries has an owner, and owners stand in a line of stages: rare terms belong
to the first, terms of most documents to the last. A bundle of queries enters the line with
nothing, and each stage is one cogroup of bundles with the posting lists that its owner holds:
the owner adds what its terms contribute, in whole numbers, to the bundle's sparse accumulators
(document, score) and hands the bundle on. Rare terms go first, so bundles stay small until the
last stages. Behind the last stage each bundle keeps its best documents, and those are merged.

Bundles and posting lists are cut by blocks of ``BLOCK_DOCS`` documents, so no list and no
bundle grows with the corpus and a term of all documents is dealt over all tasks. Queries are
taken in rounds of about ``ROUND_TERMS`` terms, which bounds what is broadcast; a single query
with more terms is a round by itself. Nothing is pruned: all documents with a positive score
compete.

Documents are rows: repeated rows rank one by one. Within equal scores ids ascend, null ids come
last. Null and empty texts have no terms and are found by nothing; queries without terms, an
empty benchmark and an empty corpus give no rows. Repeated queries are ranked one by one. Extra
columns are passed over.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, with_row_id, written

TOP = 50
#: Documents of one block; pairs of query and term of one round.
BLOCK_DOCS, ROUND_TERMS = 4096, 65_536
#: A term belongs to the first stage whose share of the documents it does not exceed.
STAGE_SHARES = (1 / 16, 1 / 4, 1.0)

#: Bytes that are no part of a term become blanks, A-Z become a-z, all else stays.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or b"").translate(_FOLD).split()


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_row"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))],
            names=["item_row", "item_id", "terms"],
        )


def _id_order(doc_id) -> tuple:
    return doc_id is None, doc_id if doc_id is not None else 0


class _Block:
    """Documents of one block, and their postings by term, as they come."""

    def __init__(self):
        self.rows, self.sizes, self.postings = [], [], []

    def add(self, row, doc_id, size: int, counts: dict[int, int]) -> None:
        self.rows.append((_id_order(doc_id), row, doc_id))
        self.sizes.append(size)
        self.postings.append(counts)

    def table(self, block: int, kind: pa.DataType) -> pa.RecordBatch:
        """One row that tells ids and sizes, and one row for each term; places follow the ids."""
        order = sorted(range(len(self.rows)), key=lambda i: self.rows[i][:2])
        lists: dict[int, tuple[list[int], list[int]]] = {}
        for place, i in enumerate(order):
            for term, times in self.postings[i].items():
                docs, counts = lists.setdefault(term, ([], []))
                docs.append(place)
                counts.append(times)
        none = [None] * len(lists)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (len(lists) + 1), pa.int64()),
                pa.array([None, *lists], pa.int32()),
                pa.array([len(order), *(len(d) for d, _ in lists.values())], pa.int32()),
                pa.array([b"", *(np.array(d, np.uint16).tobytes() for d, _ in lists.values())], pa.binary()),
                pa.array([b"", *(np.array(c, np.uint32).tobytes() for _, c in lists.values())], pa.binary()),
                pa.array([[self.rows[i][2] for i in order], *none], pa.list_(kind)),
                pa.array([[self.sizes[i] for i in order], *none], pa.list_(pa.int64())),
            ],
            names=["block", "term", "n_docs", "docs", "times", "doc_ids", "sizes"],
        )


def _index(batches: Iterator[pa.RecordBatch], held: Broadcast, block_docs: int) -> Iterator[pa.RecordBatch]:
    names: dict[bytes, int] = {t: i for i, t in enumerate(held.value)}
    wanted, block, number = names.__contains__, _Block(), TaskContext.get().partitionId() << 32
    kind = pa.int64()
    for batch in batches:
        kind = batch.column("doc_id").type
        for i, (doc_id, text) in enumerate(zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()))):
            words = terms_of(text.as_py())
            counts = Counter(filter(wanted, words))
            block.add(len(block.rows), doc_id.as_py(), len(words), {names[t]: n for t, n in counts.items()})
            if len(block.rows) == block_docs:
                yield block.table(number, kind)
                block, number = _Block(), number + 1
    if block.rows:
        yield block.table(number, kind)


def _unpacked(bundle: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {
        item: (np.frombuffer(docs, np.uint16), np.frombuffer(scores, np.int64))
        for item, docs, scores in zip(*(bundle.column(c).to_pylist() for c in ("item", "docs", "scores")))
        if item >= 0
    }


def _add_owner(bundle: pa.Table, lists: pa.Table, held: Broadcast) -> pa.Table:
    """One stage: the bundle of one block with the contributions of the owner's terms added."""
    users, documents_, terms_ = held.value
    if not bundle.num_rows:
        return bundle.select(["block", "item", "docs", "scores", "sizes"])
    frame = bundle.to_pylist()
    header = next(row for row in frame if row["item"] < 0)
    sizes = header["sizes"]
    # 64-bit numbers by the contract; Python's are exact where a product would be longer.
    weight_of_size = np.array([50 + 50 * n * documents_ // terms_ for n in sizes], np.int64)
    totals: dict[int, np.ndarray] = {}
    for item, (docs, scores) in _unpacked(bundle).items():
        totals[item] = np.zeros(len(sizes), np.int64)
        totals[item][docs] = scores
    for term, docs, times in zip(*(lists.column(c).to_pylist() for c in ("term", "docs", "times"))):
        docs, times = np.frombuffer(docs, np.uint16), np.frombuffer(times, np.uint32).astype(np.int64)
        share = 1_000_000_000 * times // (1000 * times + 20 * weight_of_size[docs])
        items, weight = users[term]
        share *= weight
        for item in items:
            if item not in totals:
                totals[item] = np.zeros(len(sizes), np.int64)
            totals[item][docs] += share
    rows = [{**header, "docs": b"", "scores": b""}]
    for item in sorted(totals):
        docs = np.flatnonzero(totals[item] > 0)
        if len(docs):
            scores = totals[item][docs]
            rows.append(
                {"block": header["block"], "item": item, "docs": docs.astype(np.uint16).tobytes(), "scores": scores.tobytes(), "sizes": None}
            )
    return pa.Table.from_pylist(rows, schema=_BUNDLE)


_BUNDLE = pa.schema(
    [("block", pa.int64()), ("item", pa.int64()), ("docs", pa.binary()), ("scores", pa.binary()), ("sizes", pa.list_(pa.int64()))]
)
_BUNDLE_SQL = "block long, item long, docs binary, scores binary, sizes array<bigint>"


def _best(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each bundle; places follow the ids, so the first of equal ones count."""
    for batch in batches:
        out = {"block": [], "item": [], "place": [], "score": []}
        for block, item, docs, scores in zip(*(batch.column(c).to_pylist() for c in ("block", "item", "docs", "scores"))):
            docs, scores = np.frombuffer(docs, np.uint16), np.frombuffer(scores, np.int64)
            best = np.lexsort((docs, -scores))[:top]
            out["block"] += [block] * len(best)
            out["item"] += [item] * len(best)
            out["place"] += docs[best].tolist()
            out["score"] += scores[best].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def _round(docs: DataFrame, queries: DataFrame, top: int, block_docs: int, stage_shares: tuple[float, ...]) -> DataFrame:
    """``item, doc_id, rank, score`` for the queries of one round, which are bounded."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    pairs = queries.select("item_row", F.explode("terms").alias("term")).toArrow()
    terms = sorted(set(pairs.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(terms)}
    items_of: list[list[int]] = [[] for _ in terms]
    for item, term in zip(pairs.column("item_row").to_pylist(), pairs.column("term").to_pylist()):
        items_of[number[term]].append(item)

    kind = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = context.broadcast(terms)
    index = written(
        docs.mapInArrow(
            lambda batches: _index(batches, vocabulary, block_docs),
            f"block long, term int, n_docs int, docs binary, times binary, doc_ids array<{kind}>, sizes array<bigint>",
        ),
        "index",
    )
    vocabulary.destroy()
    heads = index.filter("term IS NULL")
    counts = heads.select(F.explode("sizes").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = counts[0], counts[1] or 0
    # One row for each term of the round.
    found = {r.term: r.df for r in index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
    users, stage_of = {}, []
    for term, df in found.items():
        weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        users[term] = (items_of[term], weight)
        stage_of.append((term, next(s for s, share in enumerate(stage_shares) if df <= share * n_docs)))
    if not users:
        return spark.createDataFrame([], f"item long, doc_id {kind}, rank int, score long")

    owned = spark.createDataFrame(stage_of, "term int, stage int")
    held = context.broadcast((users, n_docs, n_terms))
    bundles = heads.select(
        F.col("block").alias("block"), F.lit(-1).cast("long").alias("item"), F.lit(b"").alias("docs"), F.lit(b"").alias("scores"), "sizes"
    )
    for stage in sorted({s for _, s in stage_of}):
        mine = owned.filter(F.col("stage") == stage).select("term")
        lists = index.filter("term IS NOT NULL").join(F.broadcast(mine), "term").select(F.col("block").alias("block"), "term", "docs", "times")
        bundles = (
            bundles.groupBy("block")
            .cogroup(lists.groupBy("block"))
            .applyInArrow(lambda bundle, postings: _add_owner(bundle, postings, held), _BUNDLE_SQL)
        )
    best = bundles.filter("item >= 0").mapInArrow(lambda b: _best(b, top), "block long, item long, place long, score long")
    named = best.join(heads.select(F.col("block").alias("block"), "doc_ids"), "block").select(
        "item", F.element_at("doc_ids", (F.col("place") + 1).cast("int")).alias("doc_id"), "block", "place", "score"
    )
    # The filter on the rank keeps the first rows of each task before they are shuffled.
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item", "doc_id", "rank", "score")


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    block_docs: int = BLOCK_DOCS,
    round_terms: int = ROUND_TERMS,
    stage_shares: tuple[float, ...] = STAGE_SHARES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the documents that score highest for each query.

    ``docs`` has ``doc_id, text``, ``queries`` has ``item_id, text``; ``stage_shares`` ascend and
    end with 1, ``block_docs`` is at most 65,536.
    """
    texts = documents(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    rows = with_row_id(documents(queries, "item_id", "text"), "item_row").withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["item_id"].dataType.simpleString()
    items = written(rows.mapInArrow(_query_terms, f"item_row long, item_id {kind}, terms array<binary>"), "queries")
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    rounds = max(1, math.ceil(total / round_terms))
    found = None
    for r in range(rounds):
        part = items.filter(F.pmod(F.xxhash64("item_row"), F.lit(rounds)) == r)
        ranked = _round(texts, part, top, block_docs, stage_shares)
        found = ranked if found is None else found.unionByName(ranked)
    named = found.join(items.select(F.col("item_row").alias("item"), "item_id"), "item")
    return named.select("item_id", "rank", "doc_id", "score")
