"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of equally many words. Each passage is encoded by how its
characters and words are made up; gated attention weighs the encodings, and the weighted
mean of them decides about the document. All weights are learned from document labels.

The fit uses at most ``TRAIN_ROWS`` labelled documents; executors encode their passages,
the driver holds those numbers only. Every document is scored over its whole text.

Defined results: null and empty texts are one passage without words; without labels of both
kinds every document gets the labels' share (one half without any); rows with repeated or
null ids are scored one by one; extra columns are ignored when scoring and kept when
filtering; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .shared import documents

TRAIN_ROWS = 3000
PASSAGE_WORDS = 100
HIDDEN, ATTENTION = 16, 8
STEPS, RATE, DECAY = 400, 0.02, 1e-4
#: Score from which a document is kept.
THRESHOLD = 0.3
#: Passages that a task scores at a time.
CHUNK = 20_000

#: Characters whose share of a passage is a feature.
CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b"!?",
    b"|",
    b".,;:",
    b"#$%&*@^~+=<>_\\/",
    b"()[]{}\"'`-",
    bytes(range(128, 256)),
)
WIDTH = len(CLASSES) + 6


def encode(text: str | None) -> np.ndarray:
    """One row of features per passage; the empty text has one row."""
    tokens = (text or "").split()
    rows = []
    for at in range(0, max(len(tokens), 1), PASSAGE_WORDS):
        words = tokens[at : at + PASSAGE_WORDS]
        joined = " ".join(words).encode("utf-8", "replace")
        size, count = max(len(joined), 1), max(len(words), 1)
        shares = [1 - len(joined.translate(None, c)) / size if joined else 0.0 for c in CLASSES]
        pairs = max(count - 1, 1)
        rows.append(
            [
                *shares,
                len(set(words)) / count,
                len(set(zip(words, words[1:]))) / pairs,
                len(joined) / count / 10,
                max(map(len, words), default=0) / 50,
                math.log1p(len(words)) / 5,
                math.log1p(len(tokens)) / 10,
            ]
        )
    return np.array(rows, np.float64)


@dataclass(frozen=True)
class Model:
    """Standardisation, encoder, gated attention and the final layer."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for passages ``x`` of documents that begin at ``starts``."""
        p = self.parts
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["encoder"] + p["encoder_bias"])
        shape = np.tanh(h @ p["shape"])
        gate = _logistic(h @ p["gate"])
        a = (shape * gate) @ p["attend"]
        of_doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        e = np.exp(a - np.maximum.reduceat(a, starts)[of_doc])
        attention = e / np.add.reduceat(e, starts)[of_doc]
        bag = np.add.reduceat(attention[:, None] * h, starts)
        score = _logistic(bag @ p["final"] + p["final_bias"])
        return locals()

    def scores(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.forward(x, starts)
        return out["score"], out["attention"]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _gradient(p: dict[str, np.ndarray], f: dict[str, np.ndarray], y: np.ndarray, value: np.ndarray) -> dict:
    """Gradient of the weighted log loss with respect to every part."""
    d_final = (f["score"] - y) * value
    d_bag = d_final[:, None] * p["final"]
    of_doc, starts, h, attention = f["of_doc"], f["starts"], f["h"], f["attention"]
    d_h = attention[:, None] * d_bag[of_doc]
    # Through the softmax of each document.
    d_attention = (h * d_bag[of_doc]).sum(axis=1)
    mean = np.add.reduceat(attention * d_attention, starts)
    d_a = attention * (d_attention - mean[of_doc])
    d_mix = d_a[:, None] * p["attend"]
    d_shape = d_mix * f["gate"] * (1 - f["shape"] ** 2)
    d_gate = d_mix * f["shape"] * f["gate"] * (1 - f["gate"])
    d_h = d_h + d_shape @ p["shape"].T + d_gate @ p["gate"].T
    d_in = d_h * (1 - h**2)
    return {
        "encoder": f["x"].T @ d_in,
        "encoder_bias": d_in.sum(axis=0),
        "shape": h.T @ d_shape,
        "gate": h.T @ d_gate,
        "attend": (f["shape"] * f["gate"]).T @ d_a,
        "final": f["bag"].T @ d_final,
        "final_bias": d_final.sum(keepdims=True),
    }


def fit_bags(x: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    rng = np.random.default_rng(0)
    parts = {
        "encoder": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)),
        "encoder_bias": np.zeros(HIDDEN),
        "shape": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "attend": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "final": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "final_bias": np.zeros(1),
    }
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        parts["final"][:] = 0
        parts["final_bias"][:] = math.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(np.zeros(WIDTH), np.ones(WIDTH), parts)
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-2, parts)
    good = labels == 1
    value = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    for step in range(1, steps + 1):
        for k, g in _gradient(parts, model.forward(x, starts), labels, value).items():
            g = g + DECAY * parts[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g**2 - second[k])
            parts[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [encode(t.as_py()).ravel() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bags, pa.list_(pa.float64())), batch.column("label")], names=["bag", "label"]
        )


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = TRAIN_ROWS) -> Model:
    """A model from ``labels.quality`` of the documents whose ids satisfy ``usable``."""
    rows = training_rows(docs, labels, "quality", usable, limit).select("text", "label")
    found = rows.mapInArrow(_encoded, "bag array<double>, label int").toArrow()
    bags = [np.asarray(b.values).reshape(-1, WIDTH) for b in found.column("bag")]
    starts = np.cumsum([0, *[len(b) for b in bags]])[:-1]
    x = np.concatenate(bags) if bags else np.empty((0, WIDTH))
    return fit_bags(x, starts, found.column("label").to_numpy())


def _batch_scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each document and the passage that had most attention."""
    scores, tops = np.empty(len(texts)), np.empty(len(texts), np.int32)
    held, lo, size = [], 0, 0

    def flush(hi: int) -> None:
        starts = np.cumsum([0, *[len(h) for h in held]])[:-1]
        scores[lo:hi], attention = model.scores(np.concatenate(held), starts)
        tops[lo:hi] = [int(np.argmax(a)) for a in np.split(attention, starts[1:])]

    for at, text in enumerate(texts):
        held.append(encode(text.as_py()))
        size += len(held[-1])
        if size >= CHUNK:
            flush(at + 1)
            held, lo, size = [], at + 1, 0
    if held:
        flush(len(texts))
    return scores, tops


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, tops = _batch_scores(batch.column("text"), model)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores), pa.array(tops)], names=["doc_id", "score", "passage"]
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passage``: the number of the passage with most attention, from 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = documents(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scored(batches, model), f"doc_id {kind}, score double, passage int")


def _kept(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, _ = _batch_scores(batch.column("text").cast(pa.string()), model)
        yield batch.filter(pa.array(scores >= threshold))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns; no shuffle."""
    return docs.mapInArrow(lambda batches: _kept(batches, model, threshold), docs.schema)
