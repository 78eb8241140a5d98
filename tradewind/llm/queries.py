"""Registered queries of the operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, labelled, quality, toxicity
from .chat_format import format_conversations, recovered_roles
from .decontamination import leaked_items
from .exact_dedup import exact_duplicates
from .html_extraction import main_texts
from .paragraph_dedup import repeats
from .passage_dedup import repeated_passages
from .ranked_search import ranked_search
from .run_detection import periodic_runs, repeated_tails, run_report
from .sharding import shard_documents
from .simhash_neardup import near_duplicates
from .url_filters import judge_urls, rules_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Production rules: verdict, host, path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op2_exact_dedup",
    r"""
    WITH norm AS (
        SELECT doc_id, length(coalesce(text, '')) AS n_points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER best AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER best = 1 AS kept,
           sha256(norm) AS text_sha256
    FROM norm
    WINDOW best AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_simhash_neardup")
def simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op4_url_filters",
    r"""
    WITH rules(verdict, rule_host, rule_path) AS (
        VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
    ), parts AS (
        SELECT row_number() OVER () AS row_id, page_id,
               CASE WHEN contains(url, '://')
                    THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    ELSE '' END AS host,
               CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)
                    ELSE '' END AS path
        FROM pages
    ), fits AS (
        SELECT row_id, rule_host || rule_path AS rule, verdict,
               row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC,
                                  length(rule_host) DESC, verdict DESC) AS place
        FROM parts JOIN rules
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (row_id)
    """,
)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


@query("op1_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = labelled.hash_remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "offending"
    )


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels, labelled.hash_remainder(F.col("doc_id"), 5) != 0)


@query("op8_quality")
def good_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    held_out = labelled.hash_remainder(F.col("doc_id"), 5) == 0
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "passage"
    )


def production_vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), production_vocabulary())
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_paragraph_dedup")
def paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


@query("op9_passage_dedup")
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand inside longer lines or over line breaks."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op10_chat_format",
    r"""
    SELECT conv_id, turn, 0 AS segment, role, false AS continues,
           '<|' || role || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || chr(10) AS text
    FROM conversations
    """,
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


@query("op10_transcript_roles")
def transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from raw transcripts of all conversations; the model sees three quarters of them."""
    return recovered_roles(table(spark, sf_dir, "conversations"), labelled.hash_remainder(F.col("conv_id"), 4) == 0)


@query("op12_periodic_runs")
def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(repeated_tails(table(spark, sf_dir, "documents"))))


@query(
    "op11_ranked_search",
    r"""
    WITH words AS (
        SELECT row_number() OVER () AS row_id, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), sizes AS (
        SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM words
    ), items AS (
        SELECT item_id,
               unnest(list_distinct(regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
        FROM benchmark
    ), postings AS (
        SELECT row_id, doc_id, len(terms) AS n, term, count(*) AS tf
        FROM (SELECT row_id, doc_id, terms, unnest(terms) AS term FROM words)
        WHERE term IN (SELECT term FROM items)
        GROUP BY ALL
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM postings, sizes GROUP BY term
    ), scores AS (
        SELECT item_id, row_id, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
        FROM items JOIN postings USING (term) JOIN weights USING (term), sizes
        GROUP BY item_id, row_id, doc_id
    )
    SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
    QUALIFY row_number() OVER best <= 50
    """,
)
def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
