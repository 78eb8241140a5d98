"""Shards of equally many documents by balanced label propagation.

Documents with equal texts are linked. Linked documents start spread evenly; in each round
every group looks at the shards of its members and the smaller parts ask to move to the
shard with most of them. Requests between two shards are granted as swaps, or as far as a
shard has room, so no shard ever exceeds its quota. Documents without links fill up what is
left. Shard sizes differ by one row at most (law ``rows``).

Members of a group within a shard are alike, so the state is a table of (group, shard,
count): a group of any size is at most one row per shard, and its links, a clique, are never
spelled out. Requests are granted by running totals in hash blocks; the driver sees only the
sums per pair of shards. Members are numbered within their group in blocks and take the
places that the final counts name, so a hot group is spread over all tasks.

Defined results: a null text has size 1, checksum 0 and no links; empty texts are linked to
each other; equality is that of SHA-256 digests; rows with repeated or null ids are placed
one by one; extra columns are ignored; an empty table gives an empty result; shards may stay
empty if there are fewer rows than shards.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks_for, documents, running_total, with_row_id, written

SHARDS = 16
#: Share of its quota that a shard must have free to be a target while others have room.
ROOM = 0.01


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def grants(wants: np.ndarray, free: np.ndarray) -> np.ndarray:
    """How many of the wanted moves from row to column keep every shard within its quota."""
    given = np.minimum(wants, wants.T)
    left, free = wants - given, free.copy()
    moved = True
    while moved:
        moved = False
        for source, target in zip(*np.nonzero(left)):
            take = min(left[source, target], free[target])
            if take > 0:
                given[source, target] += take
                left[source, target] -= take
                free[target] -= take
                free[source] += take
                moved = True
    return given


def _spread(groups: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Members of all groups dealt to the shards in turn."""
    dealt = running_total(groups, [], ["g"], F.col("n"), "before", blocks)
    each = dealt.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in range(shards)])))
    turn = F.pmod(F.col("shard") - F.col("before"), F.lit(shards))
    members = F.expr(f"n div {shards}") + (turn < F.col("n") % shards).cast("long")
    return each.select("g", "shard", members.alias("c")).filter("c > 0")


def _requests(state: DataFrame, open_shards: list[int]) -> DataFrame:
    """Moves that groups ask for: ``g, shard, target, c``."""
    best = (
        state.filter(F.col("shard").isin(open_shards))
        .groupBy("g")
        .agg(F.max(F.struct("c", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("best"))
    )
    return (
        state.join(best, "g")
        .filter((F.col("shard") != F.col("best.shard")) & (F.col("c") <= F.col("best.c")))
        .select("g", "shard", F.col("best.shard").alias("target"), "c")
    )


def propagate(
    groups: DataFrame, members: int, quota: list[int], rounds: int | None = None
) -> tuple[DataFrame, list[int]]:
    """Members of each group by shard (``g, shard, c``), and of each shard.

    Goes on until nothing is granted, or for so many ``rounds``. It ends: every move adds to
    the sum of squares of a group's counts, since it goes to the group's largest part.
    """
    spark, shards = groups.sparkSession, len(quota)
    blocks = blocks_for(members)
    state = written(_spread(groups, shards, blocks), "state")
    for done in count():
        sizes = np.zeros(shards, np.int64)
        for r in state.groupBy("shard").agg(F.sum("c").alias("c")).collect():
            sizes[r.shard] = r.c
        if done == rounds:
            break
        free = np.array(quota) - sizes
        open_shards = [s for s in range(shards) if free[s] > ROOM * quota[s]] or list(range(shards))
        requests = written(_requests(state, open_shards), "requests")
        wants = np.zeros((shards, shards), np.int64)
        for r in requests.groupBy("shard", "target").agg(F.sum("c").alias("c")).collect():
            wants[r.shard, r.target] = r.c
        given = grants(wants, free)
        if not given.any():
            break
        # One row per pair of shards.
        quota_of = spark.createDataFrame(
            [(int(s), int(t), int(given[s, t])) for s, t in zip(*np.nonzero(given))], "shard int, target int, given long"
        )
        ordered = running_total(requests, ["shard", "target"], ["g"], F.col("c"), "before", blocks)
        moves = ordered.join(F.broadcast(quota_of), ["shard", "target"]).select(
            "g", "shard", "target", F.least("c", F.col("given") - F.col("before")).alias("c")
        ).filter("c > 0")
        change = moves.select("g", "shard", (-F.col("c")).alias("c")).unionByName(
            moves.select("g", F.col("target").alias("shard"), "c")
        )
        state = written(
            state.unionByName(change).groupBy("g", "shard").agg(F.sum("c").alias("c")).filter("c > 0"), "state"
        )
    return state, [int(s) for s in sizes]


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.col("text").cast("string")
    rows = written(
        with_row_id(documents(docs, "doc_id", "text")).select(
            "row_id",
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"),
        ),
        "rows",
    )
    total = rows.count()
    quota, blocks = quotas(total, shards), blocks_for(total)
    groups = written(
        rows.filter("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups"
    )
    members = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    state, sizes = propagate(groups, members, quota, rounds)

    # Places of each group: at most one span of member numbers per shard.
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("shard"))
    spans = written(
        state.select("g", "shard", (upto - F.col("c")).alias("lo"), upto.alias("hi"))
        .groupBy("g")
        .agg(F.collect_list(F.struct("shard", "lo", "hi")).alias("spans")),
        "spans",
    )
    joined = written(rows.join(spans, "g", "left"), "joined")
    linked = running_total(joined.filter("spans is not null"), ["g"], ["row_id"], F.lit(1), "member", blocks)
    place = F.filter("spans", lambda s: (s.lo <= F.col("member")) & (F.col("member") < s.hi))
    columns = ["row_id", "doc_id", "size", "text_crc32"]
    linked = linked.select(*columns, F.get(place, F.lit(0)).shard.alias("shard"))
    # Documents without links go where room is left, in turn.
    singles = joined.filter("spans is null").select(*columns)
    singles = running_total(singles, [], ["row_id"], F.lit(1), "place", blocks)
    room = F.array(*[F.lit(int(b)).cast("long") for b in np.cumsum(np.array(quota) - np.array(sizes))])
    singles = singles.select(*columns, F.size(F.filter(room, lambda b: b <= F.col("place"))).alias("shard"))
    placed = written(linked.unionByName(singles), "placed")
    return running_total(placed, ["shard"], ["row_id"], F.lit(1), "slot", blocks).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
