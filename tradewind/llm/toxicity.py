"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of its own, a logistic
function of its words and word beginnings; the document's is their noisy-or: it is toxic
unless every sentence is clean. The weights are learned from document labels alone, by the
gradient of the noisy-or likelihood, and then tell which sentences are to blame.

The fit uses at most ``TRAIN_ROWS`` labelled documents; executors turn them into feature
numbers, the driver holds those only. Every document is scored over its whole text.

Defined results: null and empty texts have no sentence and get the probability of a single
empty sentence; without labels of both kinds all sentences get the labels' share (one half
without any); rows with repeated or null ids are scored one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .shared import documents

#: Labelled documents that the fit uses at most.
TRAIN_ROWS = 4000
#: Numbers of features; a feature's number is its hash.
FEATURES = 1 << 18
#: Beginnings of a word that are features beside the whole word.
PREFIXES = (3, 4, 5)
#: Steps of the fit, their size, and the evidence (in documents) below which a weight is zero.
STEPS, RATE, EVIDENCE = 400, 1.0, 0.3
#: Steps after which features without weight are dropped from the fit.
PRUNED = (30, 60, 120, 240)
#: How much more common than elsewhere a feature is in toxic documents, at least, to be learned.
LIFT = 1.5
#: Log odds of a sentence without any evidence, before the fit.
BIAS = -10.0
#: Probability from which a sentence or a document counts as toxic.
THRESHOLD = 0.3
#: Distinct words whose weight a task remembers.
MEMORY = 400_000

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = re.compile(r"^\W+|\W+$")


def word_features(token: str) -> list[int]:
    """Feature numbers of a lower-case token; punctuation at its ends doesn't count."""
    word = EDGES.sub("", token)
    if not word:
        return []
    found = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(f.encode("utf-8", "replace")) % FEATURES for f in found]


class _Memory(dict):
    """Values of distinct tokens, computed once; forgets all when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, token):
        if len(self) >= MEMORY:
            self.clear()
        self[token] = value = self.make(token)
        return value


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text.lower())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_bags(features: np.ndarray, per_sentence: np.ndarray, per_doc: np.ndarray, labels: np.ndarray) -> Model:
    """Weights of the features.

    ``features`` holds the numbers of all sentences in a row, ``per_sentence`` how many each
    sentence has, ``per_doc`` how many sentences each document has.
    """
    weights, share = np.zeros(FEATURES, np.float32), float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(weights, math.log((share + 1e-3) / (1 - share + 1e-3)))
    of_doc = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
    of_sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    # A weight is learned for what at least two toxic documents share and others have less often.
    seen_in = np.unique(of_doc[of_sentence] * np.int64(FEATURES) + features)
    toxic = labels[seen_in // FEATURES] == 1
    inside = np.bincount(seen_in[toxic] % FEATURES, minlength=FEATURES)
    outside = np.bincount(seen_in[~toxic] % FEATURES, minlength=FEATURES)
    del seen_in, toxic
    learned = (inside >= 2) & (inside * (labels == 0).sum() > LIFT * outside * (labels == 1).sum())
    used = learned[features]
    names, features = np.unique(features[used], return_inverse=True)
    of_sentence = of_sentence[used]
    positive, n = labels == 1, len(labels)
    w, bias = np.zeros(len(names)), BIAS
    seen, seen_bias = np.full(len(names), 1e-12), 1e-12
    for step in range(STEPS):
        if step in PRUNED:
            keep = w > 0
            held = keep[features]
            features, of_sentence = (np.cumsum(keep) - 1)[features[held]], of_sentence[held]
            names, seen, w = names[keep], seen[keep], w[keep]
        z = bias + np.bincount(of_sentence, w[features], minlength=len(per_sentence))
        p = _logistic(z)
        clean = np.bincount(of_doc, np.log1p(-p), minlength=n)
        pull = np.where(positive, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0) / n
        slope = pull[of_doc] * p
        up = np.bincount(features, slope[of_sentence], minlength=len(names))
        seen += up**2
        rate = RATE / np.sqrt(seen)
        # Words only ever speak for toxicity; those with little evidence of their own get nothing.
        w = np.maximum(w + rate * (up - EVIDENCE / n), 0.0)
        seen_bias += slope.sum() ** 2
        bias += RATE * slope.sum() / math.sqrt(seen_bias)
    weights[names] = w
    return Model(weights, float(bias))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of each document as feature numbers; a document without any has an empty one."""
    known = _Memory(word_features)
    kind = pa.list_(pa.list_(pa.int32()))
    for batch in batches:
        bags = [
            [[f for token in s.split() for f in known[token]] for s in sentences(text.as_py() or "")] or [[]]
            for text in batch.column("text")
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bags, kind), batch.column("label")], names=["bag", "label"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = TRAIN_ROWS) -> Model:
    """A model from ``labels.toxic`` of the documents whose ids satisfy ``usable``."""
    rows = training_rows(docs, labels, "toxic", usable, limit).select("text", "label")
    found = rows.mapInArrow(_bags, "bag array<array<int>>, label int").toArrow()
    bags = found.column("bag").combine_chunks()
    if isinstance(bags, pa.ChunkedArray):
        bags = pa.concat_arrays(bags.chunks) if bags.num_chunks else pa.array([], bags.type)
    per_doc, inner = np.diff(bags.offsets), bags.flatten()
    return fit_bags(np.asarray(inner.flatten()), np.diff(inner.offsets), per_doc, found.column("label").to_numpy())


def _scored(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    weights = model.weights.tolist()
    known = _Memory(lambda token: sum(weights[f] for f in word_features(token)))
    weight = known.__getitem__
    least = math.log(threshold / (1 - threshold))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        scores, spans = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            z = [model.bias + sum(map(weight, s.split())) for s in sentences(text)]
            p = _logistic(np.array(z or [model.bias]))
            scores.append(float(-np.expm1(np.log1p(-p).sum())))
            hits = []
            if z and max(z) >= least:
                # Lower-casing can change lengths: places are those of the original text.
                for at, found in enumerate(SENTENCE.finditer(text)):
                    if at < len(z) and z[at] >= least:
                        hits.append({"start": found.start(), "end": found.end(), "score": float(p[at])})
            spans.append(hits)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)],
            names=["doc_id", "score", "offending"],
        )


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, offending``: the spans (code points) and scores of toxic sentences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, offending array<struct<start:int,end:int,score:double>>"
    rows = documents(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _scored(batches, model, threshold), schema)
