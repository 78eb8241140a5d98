"""Chat formatting: roles by a hidden Markov model, turns in one canonical form.

A conversation is a sequence of lines. Each line is in a state: it begins a turn of a role or
goes on in one. A line is seen through its speaker marker ("User:", "### Assistant", ...) and
a few features of its wording; the model's frequencies are counted over all rows with a known
role. Viterbi's best path gives each line its role, and the turns are rendered as
``<|role|>`` headers with their text below.

Rows that name a known role are taken at their word: the whole row is one turn of that role.
Rows without one are transcripts whose lines may change speakers anywhere.

Conversations are sorted by ranges and cut into blocks of ``BLOCK_ROWS`` rows. The best path
through a conversation of many blocks is found on a tree: each block becomes a matrix of best
scores from state to state, ``FAN`` matrices at a time are multiplied (max, plus) up to the
root, and the states between blocks are read off on the way down. So no task ever holds more
than a block of rows or ``FAN`` matrices, however long one conversation is.

Defined results: a row without a role may go on with the turn before it (``continues``);
null texts are one empty line; rows are ordered by turn (nulls last), then by a hash of their
text, then by role; repeated rows are kept; rows with a null ``conv_id`` are one conversation;
of paths with equal scores one is taken; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, written

ROLES = ("system", "user", "assistant", "tool")
#: Names that a role column or a marker may use.
ALIASES = {
    "system": "system", "sys": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "prompter": "user", "customer": "user", "question": "user", "q": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant",
    "chatbot": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool",
}
_NAMES = "|".join(sorted(ALIASES, key=len, reverse=True))
#: A marker at the start of a line: "User:", "**Bot**:", "### Human", "<|user|>", "[AI]", "Q1." ...
MARKER = re.compile(
    rf"^\s*(?:(?:#+\s*|\*\*\s*)(?P<a>{_NAMES})\s*(?:\*\*)?\s*:?(?=\s|$)\s*"
    rf"|<\|(?:im_start\|>)?\s*(?P<b>{_NAMES})\s*(?:\|>)?\s*"
    rf"|\[(?P<c>{_NAMES})\]\s*:?\s*"
    rf"|(?P<d>{_NAMES})\s*\d*\s*(?:\([^)]{{0,40}}\))?\s*:\s*)",
    re.IGNORECASE,
)
#: Wordings at the start of a line that tell speakers apart.
CUES = (
    re.compile(r"\s*(you are|your task|system|act as|always|never|follow)\b", re.IGNORECASE),
    re.compile(r"\s*(please|how|what|why|when|where|who|which|can|could|would|is|are|do|does|i|my|help|tell|write|give|hi|hello|thanks)\b", re.IGNORECASE),
    re.compile(r"\s*(sure|certainly|of course|here|yes|no|to|first|the|this|as an|great|absolutely|you can|it)\b", re.IGNORECASE),
)
FEATURES = (len(CUES) + 1) * 2 * 4 * 2

#: Chances that a turn's first line has its own marker or another's, and that a later line has any.
OWN_MARKER, OTHER_MARKER, INNER_MARKER = 0.9, 0.02, 0.01
#: Added to every count.
SMOOTHING = 0.5
BLOCK_ROWS = 256
#: Children of a tree node: 2 ** SHIFT.
SHIFT = 6
FAN = 1 << SHIFT

STATES = 2 * len(ROLES)  # 2 r: begins a turn of role r; 2 r + 1: goes on in it
START = STATES  # before the first line
NEVER = -1e18


def role_of(name: str | None) -> int | None:
    known = ALIASES.get((name or "").strip().lower().strip("<|>[]#*: "))
    return None if known is None else ROLES.index(known)


def marker_of(line: str) -> tuple[int | None, str]:
    """The role that a line's marker names, and the line without the marker."""
    found = MARKER.match(line)
    if not found:
        return None, line
    return role_of(next(g for g in found.groups() if g)), line[found.end() :]


def feature_of(line: str) -> int:
    """A number below ``FEATURES`` for the wording of a line."""
    cue = next((i for i, c in enumerate(CUES) if c.match(line)), len(CUES))
    words = len(line.split())
    size = 0 if not words else 1 if words < 6 else 2 if words < 25 else 3
    asks = line.rstrip().endswith("?")
    listed = line.lstrip()[:1] in "-*+`|0123456789{<>=" and bool(words)
    return ((cue * 2 + asks) * 4 + size) * 2 + listed


#: Markers that transcripts are written with; so many of 8 turns go without.
SPELLINGS = {
    "system": ("System: ", "### Instructions: ", "<|im_start|>system ", "[SYSTEM] ", "**Context**: ", "sys: "),
    "user": ("User: ", "### Human: ", "<|im_start|>user ", "[USER] ", "**Customer**: ", "Q: "),
    "assistant": ("Assistant: ", "### AI: ", "<|im_start|>assistant ", "[BOT] ", "**Model**: ", "A: "),
    "tool": ("Tool: ", "### Function: ", "<|im_start|>tool ", "[TOOL] ", "**Observation**: ", "function: "),
}
UNMARKED = 2


class Model:
    """Log chances of the start, of steps between states, and of what is seen in a state."""

    def __init__(self, counts: Counter):
        roles = len(ROLES)

        def rates(kind: str, keys, size: int) -> np.ndarray:
            table = np.array([[counts[(kind, k, x)] for x in range(size)] for k in keys], float) + SMOOTHING
            return table / table.sum(axis=1, keepdims=True)

        start = rates("start", [0], roles)[0]
        follow = rates("follow", range(roles), roles)
        # Chance that a line is the last of its turn.
        ends = rates("end", range(roles), 2)[:, 1]
        seen = rates("feature", range(STATES), FEATURES)
        step = np.full((STATES + 1, STATES), 0.0)
        for r in range(roles):
            for state in (2 * r, 2 * r + 1):
                step[state, 2 * r + 1] = 1 - ends[r]
                step[state, ::2] = ends[r] * follow[r]
        step[START, ::2] = start
        marks = np.empty((STATES, roles + 1))
        for r in range(roles):
            marks[2 * r, :roles] = OTHER_MARKER / (roles - 1)
            marks[2 * r, r] = OWN_MARKER
            marks[2 * r, roles] = 1 - OWN_MARKER - OTHER_MARKER
            marks[2 * r + 1, :roles] = INNER_MARKER / roles
            marks[2 * r + 1, roles] = 1 - INNER_MARKER
        with np.errstate(divide="ignore"):
            self.step = np.maximum(np.log(step), NEVER)
        self.marks, self.seen = np.log(marks), np.log(seen)

    def evidence(self, role: int | None, text: str) -> np.ndarray:
        """Log chances of each line of a row in each state."""
        lines = text.split("\n")
        if role is not None:
            out = np.full((len(lines), STATES), NEVER)
            out[0, 2 * role] = 0.0
            out[1:, 2 * role + 1] = 0.0
            return out
        out = np.empty((len(lines), STATES))
        for at, line in enumerate(lines):
            mark, rest = marker_of(line)
            out[at] = self.marks[:, len(ROLES) if mark is None else mark] + self.seen[:, feature_of(rest)]
        return out


def best_scores(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines to each state of the last line."""
    scores = model.step + seen[0]
    for line in seen[1:]:
        scores = (scores[:, :, None] + model.step[None, :STATES]).max(axis=1) + line
    return np.maximum(scores, 2 * NEVER)


def best_path(model: Model, seen: np.ndarray, entry: int, exit_: int | None) -> list[int]:
    """Viterbi: the states of the lines, between a state before them and one of the last line."""
    score = model.step[entry] + seen[0]
    back = []
    for line in seen[1:]:
        ways = score[:, None] + model.step[:STATES]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + line
    path = [int(score.argmax()) if exit_ is None else exit_]
    for ways in reversed(back):
        path.append(int(ways[path[-1]]))
    return path[::-1]


def render(role: int, lines: list[str], continues: bool) -> str:
    """A turn's header and text; control marks within the text are escaped."""
    text = "\n".join(lines).replace("<|", "<\\|")
    return f"{text}\n" if continues else f"<|{ROLES[role]}|>\n{text}\n"


# Blocks


def _blocks(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation that stand together, at most ``BLOCK_ROWS`` of them.

    ``place`` orders the blocks of a partition: its number in the high bits, a counter below.
    """
    held, count, last = [], 0, None

    def row() -> pa.RecordBatch:
        nonlocal count
        first = held[0]
        turns, roles, texts = zip(*((h["turn"], h["role"], h["text"]) for h in held))
        made = {
            "conv_id": [first["conv_id"]], "place": [(first["part"] << 24) + count],
            "turns": [turns], "roles": [roles], "texts": [texts],
        }
        count += 1
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in kinds], schema=kinds)

    for batch in batches:
        for each in batch.to_pylist():
            conv = each["conv_id"]
            if held and (conv != last or len(held) >= BLOCK_ROWS):
                yield row()
            last = conv
            held.append(each)
    if held:
        yield row()


def blocks_of(conversations: DataFrame) -> DataFrame:
    """``conv, conv_id, place, turns, roles, texts``: conversations in blocks, in order."""
    rows = documents(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.xxhash64("text"), F.col("role")]
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    id_kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    empty = conversations.sparkSession.createDataFrame(
        [], f"conv_id {id_kind}, place bigint, turns array<{turn_kind}>, roles array<string>, texts array<string>"
    )
    kinds = empty.toArrow().schema
    blocks = in_order.mapInArrow(lambda batches: _blocks(batches, kinds), empty.schema)
    # A key without nulls for joins and groups.
    conv = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    return written(blocks.withColumn("conv", conv), "blocks")


# The model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for batch in batches:
        for names, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
            before = None
            for at, (name, text) in enumerate(zip(names, texts)):
                role = role_of(name)
                if role is not None:
                    lines = text.split("\n")
                    counts["end", role, 1] += 1
                    counts["end", role, 0] += len(lines) - 1
                    for n, line in enumerate(lines):
                        counts["feature", 2 * role + (n > 0), feature_of(marker_of(line)[1])] += 1
                    if at == 0:
                        counts["start", 0, role] += 1
                    elif before is not None:
                        counts["follow", before, role] += 1
                before = role
    kinds, keys, values = zip(*counts) if counts else ((), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(keys, pa.int32()), pa.array(values, pa.int32()), pa.array(counts.values(), pa.int64())],
        names=["kind", "k", "v", "n"],
    )


def fit(blocks: DataFrame) -> Model:
    """The model from all rows with a known role; the driver gets one row per frequency."""
    counts = (
        blocks.select("roles", "texts")
        .mapInArrow(_counted, "kind string, k int, v int, n long")
        .groupBy("kind", "k", "v")
        .agg(F.sum("n").alias("n"))
    )
    return Model(Counter({(r.kind, r.k, r.v): r.n for r in counts.collect()}))


# States between blocks


def _seen(model: Model, roles, texts) -> np.ndarray:
    return np.concatenate([model.evidence(role_of(r), t) for r, t in zip(roles, texts)])


def _matrices(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            best_scores(model, _seen(model, r, t)).ravel()
            for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("place"), pa.array(found, pa.list_(pa.float64()))], names=["conv", "place", "m"]
        )


def _shaped(m) -> np.ndarray:
    return np.asarray(m).reshape(STATES + 1, STATES)


def _product(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("place")
    total = _shaped(group["m"].iloc[0])
    for m in group["m"].iloc[1:]:
        total = np.maximum((total[:, :, None] + _shaped(m)[None, :STATES]).max(axis=1), 2 * NEVER)
    return pd.DataFrame({"conv": [group["conv"].iloc[0]], "place": [group["parent"].iloc[0]], "m": [total.ravel()]})


def _descent(group: pd.DataFrame) -> pd.DataFrame:
    """States between the children of a node whose own states are known."""
    group = group.sort_values("place")
    score, back = None, []
    for m in map(_shaped, group["m"]):
        if score is None:
            score = m[group["entry"].iloc[0]]
            continue
        ways = score[:, None] + m[:STATES]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    exits = [int(group["exit"].iloc[0])]
    for ways in reversed(back):
        exits.append(int(ways[exits[-1]]))
    exits = exits[::-1]
    return pd.DataFrame(
        {"conv": group["conv"], "place": group["place"], "entry": [int(group["entry"].iloc[0]), *exits[:-1]], "exit": exits}
    )


def states_between(blocks: DataFrame, model: Model) -> DataFrame:
    """``conv, place, entry, exit`` for the blocks of conversations that have several."""
    several = blocks.groupBy("conv").count().filter("count > 1").select("conv")
    level = written(
        blocks.join(several, "conv", "left_semi")
        .select("conv", "place", "roles", "texts")
        .mapInArrow(lambda batches: _matrices(batches, model), "conv string, place long, m array<double>"),
        "matrices",
    )
    parent = F.shiftright("place", SHIFT)
    levels = [level]
    while not level.groupBy("conv").count().filter("count > 1").isEmpty():
        level = written(
            level.withColumn("parent", parent).groupBy("conv", "parent").applyInPandas(_product, level.schema), "matrices"
        )
        levels.append(level)
    first = F.slice("m", START * STATES + 1, STATES)
    best = F.array_position(first, F.array_max(first)).cast("int") - 1
    states = levels[-1].select("conv", "place", F.lit(START).alias("entry"), best.alias("exit"))
    for level in reversed(levels[:-1]):
        known = states.select("conv", F.col("place").alias("parent"), "entry", "exit")
        states = (
            level.withColumn("parent", parent)
            .join(known, ["conv", "parent"])
            .groupBy("conv", "parent")
            .applyInPandas(_descent, "conv string, place long, entry int, exit int")
        )
    return written(states, "states")


# Turns


def _turns(batches: Iterator[pa.RecordBatch], model: Model, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments of each row: lines of one turn that stand in it."""
    for batch in batches:
        out = {f.name: [] for f in kinds}
        for block in batch.to_pylist():
            seen = _seen(model, block["roles"], block["texts"])
            entry = START if block["entry"] is None else block["entry"]
            path, at = best_path(model, seen, entry, block["exit"]), 0
            for turn, name, text in zip(block["turns"], block["roles"], block["texts"]):
                lines, known = text.split("\n"), role_of(name) is not None
                states = path[at : at + len(lines)]
                at += len(lines)
                cuts = [0, *(i for i in range(1, len(lines)) if states[i] % 2 == 0), len(lines)]
                for segment, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    role, continues = states[lo] // 2, states[lo] % 2 == 1
                    own = lines[lo:hi]
                    if not known and not continues:
                        own = [marker_of(own[0])[1], *own[1:]]
                    values = (block["conv_id"], turn, segment, ROLES[role], continues, render(role, own, continues))
                    for column, value in zip(out.values(), values):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)


def _formatted(blocks: DataFrame, model: Model) -> DataFrame:
    known = blocks.join(states_between(blocks, model), ["conv", "place"], "left").drop("conv", "place")
    id_kind = blocks.schema["conv_id"].dataType.simpleString()
    turn_kind = blocks.schema["turns"].dataType.elementType.simpleString()
    empty = blocks.sparkSession.createDataFrame(
        [], f"conv_id {id_kind}, turn {turn_kind}, segment int, role string, continues boolean, text string"
    )
    kinds = empty.toArrow().schema
    return known.mapInArrow(lambda batches: _turns(batches, model, kinds), empty.schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, role, continues, text``.

    One row per turn and row of the table; the texts of a conversation, put together in order,
    are its canonical rendering.
    """
    blocks = blocks_of(conversations)
    return _formatted(blocks, fit(blocks))


def parse_transcripts(transcripts: DataFrame, conversations: DataFrame) -> DataFrame:
    """The same for raw transcripts (``conv_id, text``); the model is counted over ``conversations``."""
    rows = documents(transcripts, "conv_id", "text").select(
        "conv_id", F.lit(0).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text"
    )
    return _formatted(blocks_of(rows), fit(blocks_of(conversations)))


# Transcripts whose roles are known


def transcripts_of(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw transcripts of conversations, and where their turns stand in them.

    The first frame has the blocks with their turns put together to one text each, without
    roles; turns begin with a marker in one of several spellings or, for a share of them, none.
    The second has ``place, line, conv, conv_id, turn, given_role, marked``: the first line of each
    turn in the text of its block.
    """
    known = F.create_map(*[F.lit(x) for name, role in ALIASES.items() for x in (name, role)])
    spelled = F.create_map(*[x for role, marks in SPELLINGS.items() for x in (F.lit(role), F.array(*map(F.lit, marks)))])
    each = blocks.select("conv", "conv_id", "place", F.posexplode(F.arrays_zip("turns", "roles", "texts")).alias("at", "row"))
    each = each.select(
        "conv", "conv_id", "place", "at",
        F.col("row.turns").alias("turn"), F.col("row.roles").alias("name"), F.col("row.texts").alias("text"),
    )
    given = F.try_element_at(known, F.regexp_replace(F.lower("name"), r"^[\s<|>\[\]#*:]+|[\s<|>\[\]#*:]+$", ""))
    pick = F.pmod(F.xxhash64("conv", "turn", "at", "text"), F.lit(8)).cast("int")
    each = each.withColumn("given_role", given).withColumn(
        "mark", F.coalesce(F.get(F.try_element_at(spelled, F.col("given_role")), pick - UNMARKED), F.lit(""))
    )
    before = Window.partitionBy("place").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.size(F.split("text", "\n", -1))
    turns = each.select(
        "place", F.coalesce(F.sum(lines).over(before), F.lit(0)).cast("int").alias("line"),
        "conv", "conv_id", "turn", "given_role", (F.col("mark") != "").alias("marked"), "at", "mark", "text",
    )
    turns = written(turns, "turns")
    texts = turns.groupBy("conv", "place").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("at", F.concat("mark", "text").alias("x")))).alias("all")
    )
    raw = texts.select(
        "conv", "conv_id", "place", F.array("place").alias("turns"), F.array(F.lit(None).cast("string")).alias("roles"),
        F.array(F.array_join("all.x", "\n")).alias("texts"),
    )
    return written(raw, "transcripts"), turns.drop("at", "mark", "text")


def recovered_roles(conversations: DataFrame, held_out: Column) -> DataFrame:
    """Each turn's role as it is read from raw transcripts of all conversations.

    ``conv_id, turn, held_out, marked, given_role, role, begins``: the role that the table
    gives and the one that the best path recovers without it, and whether a turn begins there.
    The model is counted over the conversations that aren't held out; ``held_out`` is a
    condition on ``conv_id``.
    """
    apart = F.coalesce(held_out, F.lit(False))
    blocks = blocks_of(conversations)
    raw, turns = transcripts_of(blocks)
    found = _formatted(raw, fit(blocks.filter(~apart))).withColumnRenamed("turn", "place")
    # Lines of a segment: its line breaks, without that of its header.
    count = F.size(F.split("text", "\n", -1)) - 1 - (~F.col("continues")).cast("int")
    upto = F.sum("n").over(Window.partitionBy("place").orderBy("segment"))
    segments = found.select("place", "segment", "role", "continues", count.alias("n")).withColumn("lo", upto - F.col("n"))
    lines = segments.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select(
        "place", (F.col("lo") + F.col("k")).cast("int").alias("line"), "role", ((F.col("k") == 0) & ~F.col("continues")).alias("begins")
    )
    return turns.join(lines, ["place", "line"]).select(
        "conv_id", "turn", apart.alias("held_out"), "marked", "given_role", "role", "begins"
    )
