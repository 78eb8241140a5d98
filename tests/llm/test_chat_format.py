import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import chat_format as C
from tradewind.llm import queries

SF = "/root/testdata/sf0.001"


def model(seed=0):
    rng = random.Random(seed)
    counts = Counter()
    for r in range(4):
        counts["start", 0, r] = rng.randrange(1, 20)
        for x in (0, 1):
            counts["end", r, x] = rng.randrange(5, 20)
        for q in range(4):
            counts["follow", r, q] = rng.randrange(1, 20)
    for s in range(8):
        for f in range(C.FEATURES):
            counts["feature", s, f] = rng.randrange(0, 5)
    return C.Model(counts)


def path_score(m, seen, path, entry):
    total, before = 0.0, entry
    for line, state in zip(seen, path):
        total += m.step[before, state] + line[state]
        before = state
    return total


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    m = model()
    for n in (1, 2, 4):
        for entry, exit_ in ((C.START, None), (3, None), (0, 5), (C.START, 2)):
            seen = np.log(rng.random((n, C.STATES)))
            paths = [p for p in itertools.product(range(C.STATES), repeat=n) if exit_ is None or p[-1] == exit_]
            best = max(path_score(m, seen, p, entry) for p in paths)
            found = C.best_path(m, seen, entry, exit_)
            assert exit_ is None or found[-1] == exit_
            assert path_score(m, seen, found, entry) == pytest.approx(best)
            row = C.best_scores(m, seen)[entry]
            assert (row.max() if exit_ is None else row[exit_]) == pytest.approx(best)


ROWS = [
    (1, 0, "system", "You are a helper.\nAnswer briefly."),
    (1, 1, "Human", "What is this?\nAssistant: not a marker here <|user|>"),
    (1, 2, " AI ", "It is a thing."),
    (1, None, "user", "Last?"),
    (2, 0, None, "User: Hi there?\nBot: Hello.\nHow are you?\nuser: fine, and you?\n### Assistant\nGood."),
    (2, 1, "nobody", "Q: what now?\nA: nothing."),
    (None, 0, "user", "a"),
    (None, 1, "assistant", None),
    (3, 0, "user", ""),
    (3, 0, "user", ""),
    (4, 0, "user", "x " * 200_000),
]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    return df.withColumn("conv", F.lit("z")).withColumn("entry", F.lit(5))


def test_edge_rows(spark):
    got = defaultdict(list)
    for r in C.format_conversations(frame(spark)).collect():
        got[r.conv_id, r.turn].append(r)
    texts = {k: [r.text for r in sorted(v, key=lambda r: r.segment)] for k, v in got.items()}
    roles = {k: [r.role for r in sorted(v, key=lambda r: r.segment)] for k, v in got.items()}
    assert texts[1, 0] == ["<|system|>\nYou are a helper.\nAnswer briefly.\n"]
    assert texts[1, 1] == ["<|user|>\nWhat is this?\nAssistant: not a marker here <\\|user|>\n"]
    assert roles[1, 2] == ["assistant"] and roles[1, None] == ["user"]
    assert roles[2, 0] == ["user", "assistant", "user", "assistant"]
    assert texts[2, 0][1] == "<|assistant|>\nHello.\nHow are you?\n"
    assert texts[2, 0][3] == "<|assistant|>\n\nGood.\n"
    assert roles[2, 1] == ["user", "assistant"] and texts[2, 1][0] == "<|user|>\nwhat now?\n"
    assert texts[None, 1] == ["<|assistant|>\n\n"] and texts[3, 0] == ["<|user|>\n\n"] * 2
    assert C.format_conversations(frame(spark, [])).count() == 0
    assert C.format_conversations(frame(spark, [(1, 0, None, "hello there")])).count() == 1


def test_blocks_of_a_long_conversation_change_nothing(spark, monkeypatch):
    """A third of all rows in one conversation, a third of them without a role."""
    rng = random.Random(2)
    rows = []
    for t in range(300):
        role = ("user", "assistant")[t % 2]
        text = rng.choice(["What is it?", "Sure, here it is.", "please tell me more", "The end of it all"])
        rows.append((7, t, role if t % 3 else None, text))
        rows += [(100 + t, 0, "user", "What?"), (100 + t, 1, None, "Sure, this.")]
    df = frame(spark, rows)
    read = lambda: sorted(tuple(r) for r in C.format_conversations(df).collect())
    whole = read()
    monkeypatch.setattr(C, "BLOCK_ROWS", 3)
    monkeypatch.setattr(C, "SHIFT", 2)
    cut = read()
    assert whole == cut
    assert {r[1] for r in whole if r[0] == 7} == set(range(300))


def test_hidden_roles_are_recovered(spark):
    """Turns without their role are recovered from wording and from their neighbours."""
    rng = random.Random(5)
    asks = ["How does {} work?", "Please explain {}", "what about {}?", "can you write {} for me?"]
    says = ["Sure, here is {}.", "Certainly. The {} is simple", "Of course: {}", "Here you go, {}"]
    words = ["rain", "a tree", "sorting", "the code", "bread"]
    rows, truth = [], {}
    for c in range(150):
        for t in range(6):
            role = ("user", "assistant")[t % 2]
            text = rng.choice(asks if t % 2 == 0 else says).format(rng.choice(words))
            truth[c, t] = role
            rows.append((c, t, None if rng.random() < 0.25 else role, text))
    hidden = {(r[0], r[1]) for r in rows if r[2] is None}
    found = {(r.conv_id, r.turn): r.role for r in C.format_conversations(frame(spark, rows)).collect()}
    assert sum(found[k] == truth[k] for k in hidden) >= 0.95 * len(hidden)
    assert all(found[k] == truth[k] for k in truth if k not in hidden)


def test_raw_transcripts(spark):
    texts = [
        (1, "System: You are kind.\nUser: Hi?\nAI: Hello!\nUser: ok: fine"),
        (2, "**Human**: one\ntwo\n**Assistant**: three"),
        (3, "<|im_start|>user\nhey?\n<|im_start|>assistant\nyes"),
        (4, None),
    ]
    raw = spark.createDataFrame(texts, "conv_id long, text string").withColumn("role", F.lit(1))
    got = defaultdict(list)
    for r in C.parse_transcripts(raw, frame(spark)).orderBy("conv_id", "segment").collect():
        got[r.conv_id].append((r.role, r.text.split("\n", 1)[1]))
    assert got[1] == [("system", "You are kind.\n"), ("user", "Hi?\n"), ("assistant", "Hello!\n"), ("user", "ok: fine\n")]
    assert got[2] == [("user", "one\ntwo\n"), ("assistant", "three\n")]
    assert got[3] == [("user", "\nhey?\n"), ("assistant", "\nyes\n")]
    assert len(got[4]) == 1


def test_query(spark):
    found = queries.QUERIES["op10_chat_format"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert sorted((r.conv_id, r.turn, r.role) for r in found) == sorted((r.conv_id, r.turn, r.role) for r in rows)


def wordings(seed):
    """Conversations whose speakers differ by wording, one of them long; and the true roles."""
    rng = random.Random(seed)
    asks = ["How does {} work?", "Please explain {}\nwhat about {}?", "can you write {} for me?"]
    says = ["Sure, here is {}.", "Certainly. The {} is simple", "Of course: {}"]
    rows = []
    for c in range(120):
        for t in range(200 if c == 7 else 6):
            text = rng.choice(asks if t % 2 == 0 else says).replace("{}", rng.choice(["rain", "a tree", "bread"]))
            rows.append((c, t, ("Human", " AI ")[t % 2] if c % 5 else ("user", "assistant")[t % 2], text))
    return rows, {(r[0], r[1]): ("user", "assistant")[r[1] % 2] for r in rows}


def test_roles_are_recovered_from_raw_transcripts(spark, monkeypatch):
    rows, truth = wordings(4)
    monkeypatch.setattr(C, "BLOCK_ROWS", 16)
    monkeypatch.setattr(C, "SHIFT", 2)
    found = C.recovered_roles(frame(spark, rows), F.col("conv_id") % 4 == 0).collect()
    assert sorted((r.conv_id, r.turn) for r in found) == sorted(truth)
    assert all(r.given_role == truth[r.conv_id, r.turn] for r in found)
    bare = [r for r in found if not r.marked]
    assert 0.15 * len(found) < len(bare) < 0.35 * len(found)
    for part in (bare, [r for r in found if r.marked], [r for r in bare if r.held_out]):
        assert sum(r.role == truth[r.conv_id, r.turn] and r.begins for r in part) >= 0.9 * len(part) > 0


def test_transcripts_hold_every_line_and_no_role(spark):
    raw, turns = C.transcripts_of(C.blocks_of(frame(spark)))
    assert all(r.roles == [None] and len(r.texts) == 1 for r in raw.collect())
    lines = {r.place: r.texts[0].split("\n") for r in raw.collect()}
    texts = Counter(t or "" for *_, t in ROWS)
    for r in turns.collect():
        line = lines[r.place][r.line]
        line = C.marker_of(line)[1] if r.marked else line
        assert any(t.split("\n")[0] in (line, line.lstrip()) for t in texts)
    assert turns.count() == len(ROWS)
    assert C.recovered_roles(frame(spark, []), F.lit(False)).count() == 0


def test_roles_query(spark):
    found = queries.QUERIES["op10_transcript_roles"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert sorted((r.conv_id, r.turn, r.given_role) for r in found) == sorted((r.conv_id, r.turn, r.role) for r in rows)
    marked = [r for r in found if r.marked]
    assert 0 < len(marked) < len(found)
    assert sum(r.role == r.given_role for r in marked) >= 0.98 * len(marked)
