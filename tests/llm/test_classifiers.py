"""The two multiple-instance classifiers: gradients, edge cases and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import labelled as L
from tradewind.llm import quality as Q
from tradewind.llm import queries
from tradewind.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def corpus(n=400):
    """Documents with toxic words or shouting, and labels for most of them."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 15))) for _ in range(rng.randrange(1, 30))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(lines))
            lines[at] += " " + rng.choice(["vileperson", "Nastyfool", "vilest"]) + " " + rng.choice(words)
        text = ". ".join(lines)
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text, "x"))
        if i % 7:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string").cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


EDGE = [(1, None), (2, ""), (3, " \n.!?"), (4, "ok " * 300_000), (5, "İİİ. ﬁ. x"), (None, "a"), (1, None)]


def test_toxicity_learns_words_and_finds_the_sentence(spark, frames):
    docs, labels = frames
    usable = L.hash_remainder(F.col("doc_id"), 4) != 2
    model = T.fit(docs, labels, usable)
    found = {r.doc_id: r for r in T.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = {r.doc_id for r in docs.filter(~usable).select("doc_id").collect()} & set(truth)
    right = sum((found[i].score >= 0.3) == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in held:
        for s in found[i].offending:
            assert "vile" in texts[i][s.start : s.end].lower() or "nasty" in texts[i][s.start : s.end].lower()


def test_toxicity_gradient_step_raises_the_likelihood():
    bags = [[[1, 2], [3]], [[2]], [[3, 4]], [[1]], [[4]], [[5, 3]]]
    labels = np.array([1, 0, 0, 1, 0, 0])
    flat = [f for b in bags for s in b for f in s]
    sizes = [len(s) for b in bags for s in b]
    model = T.fit_bags(np.array(flat, np.int32), np.array(sizes), np.array([len(b) for b in bags]), labels)
    score = lambda bag: 1 - np.prod([1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[f] for f in s)))) for s in bag])
    assert all((score(b) >= 0.3) == y for b, y in zip(bags, labels))


@pytest.mark.parametrize("module,label", [(T, "toxic"), (Q, "quality")])
def test_edge_texts_and_labels(spark, frames, module, label):
    docs, labels = frames
    edge = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("label", F.lit(1))
    model = module.fit(docs, labels, F.lit(True))
    got = module.score(edge, model).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in EDGE)
    assert all(0 <= r.score <= 1 for r in got)
    assert module.score(edge.limit(0), model).count() == 0
    # No labels, labels of one kind, unusable labels, contradicting labels of one document.
    none = labels.limit(0)
    assert {round(r.score, 2) for r in module.score(docs.limit(3).coalesce(1), module.fit(docs, none, F.lit(True))).collect()} <= {
        0.5,
        *[round(1 - 0.5**k, 2) for k in range(40)],
    }
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 7, 7), (None, 1, 1), (3, None, None)], labels.schema)
    rows = L.training_rows(docs, odd, label, F.lit(True), 10).collect()
    assert [(r.doc_id, r.label) for r in rows] == [(1, 1)]


def test_quality_gradient_is_exact():
    rng = np.random.default_rng(0)
    x, starts = rng.normal(size=(12, Q.WIDTH)), np.array([0, 3, 4, 9])
    y = np.array([1.0, 0.0, 0.0, 1.0])
    value = np.array([0.2, 0.3, 0.3, 0.2])
    model = Q.fit_bags(x, starts, y, steps=3)
    loss = lambda: -(value * np.log(np.where(y == 1, model.scores(x, starts)[0], 1 - model.scores(x, starts)[0]))).sum()
    exact = Q._gradient(model.parts, model.forward(x, starts), y, value)
    for name, part in model.parts.items():
        flat, at = part.reshape(-1), 0
        kept = flat[at]
        flat[at] = kept + 1e-5
        up = loss()
        flat[at] = kept - 1e-5
        down = loss()
        flat[at] = kept
        assert (up - down) / 2e-5 == pytest.approx(exact[name].reshape(-1)[at], abs=1e-6), name


def test_quality_held_out_accuracy_and_filter(spark, frames, monkeypatch):
    docs, labels = frames
    usable = L.hash_remainder(F.col("doc_id"), 5) != 0
    model = Q.fit(docs, labels, usable)
    monkeypatch.setattr(Q, "CHUNK", 7)
    found = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = {r.doc_id for r in docs.filter(~usable).select("doc_id").collect()} & set(truth)
    assert sum((found[i] >= 0.3) == truth[i] for i in held) >= 0.95 * len(held)
    kept = Q.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s >= 0.3}


@pytest.mark.parametrize(
    "name,label,fold,least", [("op1_toxicity", "toxic", 2, 0.85), ("op8_quality", "quality", 0, 0.98)]
)
def test_held_out_accuracy_of_the_queries(spark, name, label, fold, least):
    found = queries.QUERIES[name](spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == 1000
    rows = found.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)


def test_training_rows_hold_their_bound_when_ids_repeat(spark):
    from pyspark.sql import functions as F

    from tradewind.llm import labelled

    docs = spark.range(20_000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    for limit in (10, 1500):
        rows = labelled.training_rows(docs, labels, "toxic", F.lit(True), limit)
        assert rows.count() == limit
        assert sorted(rows.collect()) == sorted(labelled.training_rows(docs.repartition(7), labels, "toxic", F.lit(True), limit).collect())
