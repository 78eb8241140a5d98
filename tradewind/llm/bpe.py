"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text is split into pieces by the vocabulary's pattern, and each piece is encoded by itself:
a fold starts from its bytes and merges, step by step, the adjacent pair of the lowest rank.
The fold is one higher-order expression over the bytes of a word. It looks pairs up in a
literal rank map, a table of one row: an array of buckets, each a short string of (left, right, merged) entries,
with one character per token.

Most pieces repeat all the time, so the distinct words of a bounded sample are folded once
and the most frequent of them serve as a dictionary. It has at most ``DICTIONARY`` words of
``DICTIONARY_BYTES`` bytes, whatever the size of the corpus, and spares work only: a piece
that it lacks is folded where its document is read, once for each ``SLICE`` documents. Nothing
is shuffled but the words of the sample. Pieces beyond ``LONG`` bytes are merged with a heap, as a fold takes
time quadratic in the length. Decoding concatenates the binary pieces of the ids.

Defined results: null and empty texts have no ids and decode to nothing; rows with repeated
or null ids are encoded one by one; extra columns are ignored; an empty table gives an empty
result; ids outside the vocabulary raise an error when decoded.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, written

#: Words of the dictionary, their length, and the documents whose words are counted for it.
DICTIONARY, DICTIONARY_BYTES, SAMPLE_ROWS = 1 << 19, 64, 50_000
#: Bytes of a piece beyond which it is merged with a heap.
LONG = 400
#: Documents that a task works on at a time.
SLICE = 250

#: Buckets of the rank map; a pair's bucket is its checksum.
BUCKETS = 1 << 15
#: Marks the start of a bucket's entry; stands for "no such pair" and sorts after all tokens.
START, NONE = "\x01", "\U0010ffff"
#: Characters of tokens begin here and leave the surrogates out.
FIRST, SURROGATES, GAP = 256, 0xD800, 0x800


def _character(token: int) -> str:
    point = token + FIRST
    return chr(point if point < SURROGATES else point + GAP)


def _tokens(folded: str) -> np.ndarray:
    points = np.frombuffer(folded.encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.where(points < SURROGATES, points, points - GAP) - FIRST


def _ascii_pattern(pattern: str) -> str | None:
    """The pattern with letters and digits spelled out, if it has no other property."""
    out, inside = [], False
    for token in re.findall(r"\\[pP]\{[^}]*\}|\\.|.", pattern, re.DOTALL):
        spelled = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(token)
        if spelled is None and token[:2] in (r"\p", r"\P"):
            return None
        inside = token == "[" or (inside and token != "]")
        out.append(token if spelled is None else spelled if inside else f"[{spelled}]")
    return "".join(out)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, which are their token ids too, and the pattern of pieces."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: base64 of the bytes, a blank, the rank; read on the driver."""
        with open(path, "rb") as lines:
            entries = (line.split() for line in lines)
            return cls({base64.b64decode(e[0]): int(e[1]) for e in entries if e}, pattern)

    def splitter(self) -> Callable[[str], list[str]]:
        """A function from a text to its pieces."""
        # The pattern's white space is Unicode's property, which this module's \s is not.
        unicode_space = self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        everywhere = regex.compile(unicode_space).findall
        plain = _ascii_pattern(self.pattern)
        if plain is None:
            return everywhere
        # Texts of ASCII characters alone have a simpler and faster form of the same pattern.
        in_ascii = re.compile(plain, re.ASCII).findall
        return lambda text: in_ascii(text) if text.isascii() else everywhere(text)

    def merges(self) -> Iterator[tuple[int, int, int]]:
        """Left token, right token and the token that they merge to."""
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    yield left, right, rank


def _buckets(vocabulary: Vocabulary) -> str:
    """The rank map: a JSON array of buckets."""
    buckets = [f"..{NONE}"] * BUCKETS
    for left, right, merged in vocabulary.merges():
        a, b, c = _character(left), _character(right), _character(merged)
        buckets[zlib.crc32((a + b).encode()) % BUCKETS] += START + a + b + c
    return json.dumps(buckets, ensure_ascii=False)


def rank_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """The rank map as a table of one row, ``ranks, one``: about a megabyte.

    Plans name it and hold none of it, however often the driver keeps their text.
    """
    text = spark.createDataFrame([(_buckets(vocabulary),)], "text string")
    ranks = text.select(F.from_json("text", "array<string>").alias("ranks"), F.lit(1).alias("one"))
    return written(ranks.coalesce(1), "ranks")


def fold_merges(vocabulary: Vocabulary, rank_map: Column | None = None):
    """A function from a word column to its tokens, one character each.

    ``rank_map`` is a column of the array of :func:`rank_table`; else the map is a literal.
    """
    if rank_map is None:
        rank_map = F.from_json(F.lit(_buckets(vocabulary)), "array<string>")
    latin = "".join(map(chr, range(256)))
    first = "".join(_character(vocabulary.ranks[bytes([b])]) for b in range(256))
    empty, one, rest = F.lit(""), F.lit(1), F.lit(1 << 30)

    def bound(value: Column, use) -> Column:
        """``use(value)`` with the value computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def merged(ranks: Column, a: Column, b: Column) -> Column:
        slot = (F.crc32(F.concat(a, b).cast("binary")) % BUCKETS).cast("int")
        # Found at p: the token stands at p + 3. Not found (0): the third character is NONE.
        return bound(
            F.get(ranks, slot),
            lambda bucket: F.substring(bucket, F.position(F.concat(F.lit(START), a, b), bucket) + 3, one),
        )

    def step(ranks: Column, state: Column) -> Column:
        """The state has the tokens and the merged token of each adjacent pair."""
        tokens, pairs = F.get(state, F.lit(0)), F.get(state, F.lit(1))

        def merge(least: Column) -> Column:
            def at(p: Column) -> Column:
                before = F.when(p > 1, merged(ranks, F.substring(tokens, p - 1, one), least)).otherwise(empty)
                after = bound(
                    F.substring(tokens, p + 2, one),
                    lambda c: F.when(c == "", empty).otherwise(merged(ranks, least, c)),
                )
                return F.array(
                    F.concat(F.substring(tokens, one, p - 1), least, F.substring(tokens, p + 2, rest)),
                    F.concat(F.substring(pairs, one, p - 2), before, after, F.substring(pairs, p + 2, rest)),
                )

            done = F.array(tokens, empty)
            return F.when(least == NONE, done).otherwise(bound(F.position(least, pairs), at))

        # Characters sort by rank: the least pair is the next to merge, the first of equals.
        return F.when(pairs == "", state).otherwise(bound(F.array_min(F.split(pairs, "")), merge))

    def folded(ranks: Column, tokens: Column) -> Column:
        size = F.char_length(tokens)
        pairs = F.transform(
            F.sequence(one, size - 1),
            lambda i: merged(ranks, F.substring(tokens, i, one), F.substring(tokens, i + 1, one)),
        )
        start = F.array(tokens, F.array_join(pairs, ""))
        last = F.aggregate(
            F.sequence(one, size - 1), start, lambda state, _: step(ranks, state), lambda s: F.get(s, F.lit(0))
        )
        return F.when(size < 2, tokens).otherwise(last)

    def fold(word: Column) -> Column:
        single = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), latin, first)
        # The map is looked up once per expression, not once per pair.
        return bound(rank_map, lambda ranks: bound(single, lambda tokens: folded(ranks, tokens)))

    return fold


def merge_with_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece, in time n log n."""
    size = len(piece)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    alive = [True] * size

    def rank(at: int) -> int | None:
        after = end[at]
        return ranks.get(piece[at : end[after]]) if after < size else None

    heap = [(r, at, at + 2) for at in range(size - 1) if (r := rank(at)) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, stop = heapq.heappop(heap)
        after = end[at]
        # Left over from before one of the two was merged.
        if not alive[at] or after >= size or end[after] != stop:
            continue
        alive[after], end[at] = False, stop
        if stop < size:
            before[stop] = at
        for left in (before[at], at):
            if left >= 0 and (r := rank(left)) is not None:
                heapq.heappush(heap, (r, left, end[end[left]]))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    find = vocabulary.splitter()
    for batch in batches:
        counts = Counter()
        for text in batch.column("text"):
            counts.update(find(text.as_py() or ""))
        words = [w for w in counts if len(w.encode()) <= DICTIONARY_BYTES]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"]
        )


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Ids of folded words as 32-bit integers; a word that is a token is that token."""
    for batch in batches:
        words = batch.column("words").flatten()
        codes = []
        for word, tokens in zip(words, batch.column("tokens").flatten()):
            whole = vocabulary.ranks.get(word.as_py().encode("utf-8"))
            codes.append(_tokens(tokens.as_py()).astype("<i4").tobytes() if whole is None else whole.to_bytes(4, "little"))
        yield pa.RecordBatch.from_arrays([words, pa.array(codes, pa.binary())], names=["word", "code"])


def _folded_lists(lists: DataFrame, column: str, name: str, vocabulary: Vocabulary, ranks: DataFrame) -> DataFrame:
    """The rows with ``name``, the tokens of each word of an array column.

    Each row meets the one row of the rank map; rows hold many words, so it is read rarely.
    """
    fold = fold_merges(vocabulary, F.col("ranks"))
    met = lists.withColumn("one", F.lit(1)).join(F.broadcast(ranks), "one")
    return met.select(*[F.col(c) for c in lists.columns], F.transform(column, fold).alias(name))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, ranks: DataFrame) -> pa.Table:
    """The dictionary: the most frequent words of the sample and their packed ids."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    share = SAMPLE_ROWS / max(texts.count(), SAMPLE_ROWS)
    # The hash as a number from 0 to 1: any share of any number of documents can be told.
    sample = texts.filter(F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5) <= F.lit(share))
    words = (
        sample.mapInArrow(lambda batches: _counted(batches, vocabulary), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(DICTIONARY)
    )
    # Lists of about a thousand words, dealt over all tasks.
    lists = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(1, DICTIONARY >> 10))).alias("list"))
    lists = lists.agg(F.collect_list("word").alias("words")).select("words")
    folded = _folded_lists(lists, "words", "tokens", vocabulary, ranks)
    return folded.mapInArrow(lambda batches: _packed(batches, vocabulary), "word string, code binary").toArrow()


def _looked_up(
    batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, dictionary
) -> Iterator[pa.RecordBatch]:
    """A row per slice of documents: their ids as 32-bit integers, and the words to be folded.

    In the ids -1-k stands for the slice's k-th such word.
    """
    find = vocabulary.splitter()
    # A worker builds the hash table once and keeps it with the broadcast for its next tasks.
    if not hasattr(dictionary, "table"):
        dictionary.table = {w: c for part in dictionary.value for w, c in zip(*(a.to_pylist() for a in part))}
    known = dictionary.table.get

    def packed(pieces: list[str], rare: dict[str, int]) -> bytes:
        codes = [known(p) for p in pieces]
        if None in codes:
            for at, code in enumerate(codes):
                if code is None:
                    raw = pieces[at].encode("utf-8")
                    # A piece that is a token is that token, whether merges lead to it or not.
                    if (whole := vocabulary.ranks.get(raw)) is not None:
                        codes[at] = whole.to_bytes(4, "little")
                    elif len(raw) > LONG:
                        codes[at] = np.array(merge_with_heap(raw, vocabulary.ranks), "<i4").tobytes()
                    else:
                        mark = -1 - rare.setdefault(pieces[at], len(rare))
                        codes[at] = mark.to_bytes(4, "little", signed=True)
        return b"".join(codes)

    for batch in _sliced(batches):
        rare: dict[str, int] = {}
        ids = [packed(find(text.as_py() or ""), rare) for text in batch.column("text")]
        cuts = pa.array([0, batch.num_rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(cuts, batch.column("doc_id")),
                pa.ListArray.from_arrays(cuts, pa.array(ids, pa.binary())),
                pa.array([list(rare)], pa.list_(pa.string())),
            ],
            names=["doc_ids", "packed", "rare"],
        )


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each document, folded words put in; a batch per slice."""
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch.column("folded")[row].as_py()
            tokens = _tokens("".join(words))
            ends = np.cumsum([0, *map(len, words)]).tolist()
            arrays = []
            for packed in batch.column("packed")[row].values:
                ids = np.frombuffer(packed.as_buffer(), "<i4")
                holes = np.flatnonzero(ids < 0).tolist()
                if holes:
                    parts, at = [], 0
                    for hole in holes:
                        word = -1 - ids[hole]
                        parts += [ids[at:hole], tokens[ends[word] : ends[word + 1]]]
                        at = hole + 1
                    ids = np.concatenate([*parts, ids[at:]])
                arrays.append(ids)
            lengths = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_ids")[row].values, pa.ListArray.from_arrays(pa.array(lengths), pa.array(values))],
                names=["doc_id", "ids"],
            )


def _folded(docs: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, str]:
    """``doc_ids, packed, rare, folded`` per slice: ids with gaps, and the tokens that belong there; the type of ids."""
    rows = documents(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    ranks = rank_table(docs.sparkSession, vocabulary)
    table = frequent_words(rows, vocabulary, ranks)
    # Sent as Arrow arrays: the driver never holds the words as objects.
    parts = [(b.column("word"), b.column("code")) for b in table.to_batches()]
    dictionary = docs.sparkSession.sparkContext.broadcast(parts)
    kind = rows.schema["doc_id"].dataType.simpleString()
    looked_up = rows.mapInArrow(
        lambda batches: _looked_up(batches, vocabulary, dictionary),
        f"doc_ids array<{kind}>, packed array<binary>, rare array<string>",
    )
    return _folded_lists(looked_up, "rare", "folded", vocabulary, ranks).drop("rare"), kind


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text."""
    folded, kind = _folded(docs, vocabulary)
    return folded.mapInArrow(_assembled, f"doc_id {kind}, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    table = [b""] * (max(vocabulary.ranks.values()) + 1)
    for piece, rank in vocabulary.ranks.items():
        table[rank] = piece
    pieces = pa.array(table, pa.binary())
    for batch in _sliced(batches):
        ids = batch.column("ids")
        starts = np.asarray(ids.offsets)
        flat = ids.values[starts[0] : starts[-1]] if len(ids) else ids.values[:0]
        taken = pieces.take(flat)
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(flat) + 1]
        data = taken.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        at = ends[starts - starts[0]]
        texts = [data[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])]
        packed = [flat[lo:hi] for lo, hi in zip(starts[:-1] - starts[0], starts[1:] - starts[0])]
        raw = [np.asarray(p).astype("<u4").tobytes() for p in packed]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.binary()), pa.array(raw, pa.binary())],
            names=[*batch.schema.names, "decoded", "packed"],
        )


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with ``decoded``, the bytes of the ids, and ``packed``, the ids as 32-bit integers."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda batches: _decoded(batches, vocabulary), f"{columns}, decoded binary, packed binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids, decoded, packed``: ``decode(encode(docs))`` with one Python worker less."""
    folded, kind = _folded(docs, vocabulary)
    return folded.mapInArrow(
        lambda batches: _decoded(_assembled(batches), vocabulary),
        f"doc_id {kind}, ids array<int>, decoded binary, packed binary",
    )
