"""The pipeline stage by stage against brute force, and as a whole."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as C
from test_decontamination import brute as leaked
from test_exact_dedup import brute as exact
from test_simhash_neardup import brute_components, slow_fingerprint
from tradewind.llm import quality, queries

SF = "/root/testdata/sf0.001"
EDGE = [
    (9001, None, None, None, None),
    (9002, "", "en", "src0", 0),
    (9002, "", "en", "src0", 0),
    (None, "one two three four", None, "src0", None),
    (None, "one two three four", None, "src1", None),
    (9003, "x " * 50_000, "en", "src0", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return rows + EDGE


def frame(spark, rows):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    return spark.createDataFrame(rows, schema).coalesce(1)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage(spark, docs):
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "simhash_neardup", "decontamination", "byte_bpe"]

    model = queries.quality_model(frame(spark, docs), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = [model.scores(quality.encode(d[1]), np.array([0]))[0][0] for d in docs]
    good = [d for d, s in zip(docs, scores) if s >= 0.3]
    assert as_rows(stages["quality"](spark, frame(spark, docs), SF)) == sorted(good, key=str)

    # The later stages get all rows: nulls, repeats and copies reach each of them.
    kept = [d for d, e in zip(docs, _in_order(docs)) if e]
    assert as_rows(stages["exact_dedup"](spark, frame(spark, docs), SF)) == sorted(kept, key=str)

    fps = [slow_fingerprint(d[1]) for d in docs]
    groups = brute_components(list(range(len(docs))), fps, 3)
    best = {}
    for at, g in enumerate(groups):
        key = (docs[at][0] is None, docs[at][0] or 0, at)
        best[g] = min(best.get(g, key), key)
    stay = sorted((docs[k[2]] for k in best.values()), key=str)
    assert as_rows(stages["simhash_neardup"](spark, frame(spark, docs), SF)) == stay

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    short = [d for d in docs if len(d[1] or "") < 1500]
    gone = {d for d, _ in leaked([(str(i), d[1]) for i, d in enumerate(short)], items)}
    clean = [d for i, d in enumerate(short) if str(i) not in gone]
    assert as_rows(stages["decontamination"](spark, frame(spark, short), SF)) == sorted(clean, key=str)
    assert gone

    library = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=queries.production_vocabulary().ranks, special_tokens={}
    )
    want = sorted(
        ((d[0], hashlib.sha256(np.array(library.encode_ordinary(d[1] or ""), "<u4").tobytes()).hexdigest()) for d in docs), key=str
    )
    got = stages["byte_bpe"](spark, frame(spark, docs), SF)
    assert sorted(((r.doc_id, r.ids_sha256) for r in got.collect()), key=str) == want


def _in_order(docs):
    """Whether the row stays, for each row, by the brute-force groups."""
    import re
    from collections import defaultdict

    groups = defaultdict(list)
    for at, d in enumerate(docs):
        norm = re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")
        groups[norm].append((-len(d[1] or ""), d[0] is None, d[0] or 0, at))
    stay = {min(g)[3] for g in groups.values()}
    assert len(stay) == sum(e[3] for e in exact([(d[0], d[1]) for d in docs]))
    return [at in stay for at in range(len(docs))]


def test_columns_and_whole_run(spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in C.STAGES:
        before = step.count()
        step = spark.createDataFrame(stage(spark, step, SF).collect(), stage(spark, step, SF).schema)
        assert step.count() <= before
        if name != "byte_bpe":
            assert step.columns == columns
    whole = C.run(spark, SF)
    assert as_rows(whole.select("doc_id", "ids_sha256")) == as_rows(step.select("doc_id", "ids_sha256"))
    assert 0 < whole.count() < docs.count()


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0
