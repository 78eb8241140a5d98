"""Product label normalisation by substring rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.money import exact_sum
from ..functions.text import norm_label
from ..schema import table_schema

Rule = tuple[int, str, str, str | None, str | None]

#: Lengths of grams: a part is filed under stretches of the greatest length that it holds.
GRAMS = (1, 2, 3, 6, 12, 24)


def merge_rules_table(spark: SparkSession, rules: Sequence[Rule] = V.MERGE_RULES) -> DataFrame:
    rows = [(i, *rule, None) for i, rule in enumerate(rules, start=1)]
    return spark.createDataFrame(rows, table_schema("product_merge_rules"))


def replace_merge_rules(
    spark: SparkSession, path: str, rules: Sequence[Rule] | DataFrame = V.MERGE_RULES
) -> DataFrame:
    """Overwrite the whole rule table with a list of rules or a frame of the table's columns."""
    table = rules if isinstance(rules, DataFrame) else merge_rules_table(spark, rules)
    table.write.mode("overwrite").parquet(path)
    return spark.read.schema(table_schema("product_merge_rules")).parquet(path)


def _pattern_length(m1: str, m2: str | None, m3: str | None) -> int:
    return len(m1) + len(m2 or "") + len(m3 or "")


def ranked(rules: Sequence[Rule]) -> list[Rule]:
    """Best rule first: priority, total pattern length, latest."""
    keyed = [(r[0], _pattern_length(r[2], r[3], r[4]), i, r) for i, r in enumerate(rules)]
    return [r for _, _, _, r in sorted(keyed, key=lambda k: k[:3], reverse=True)]


def canonical_name(label: Column, rules: Sequence[Rule] = V.MERGE_RULES) -> Column:
    """Canonical name of a normalised label by the best matching rule, else NULL.

    The rules in rank order are one first-match expression: no join, no pairs.
    """
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for _, canonical, *parts in ranked(rules):
        test = F.lit(True)
        for part in parts:
            if part is not None:
                test = test & label.contains(part)
        out = out.when(test, F.lit(canonical))
    return out


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct stretches of the given lengths, of texts at least as long."""

    def of_size(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*[of_size(n) for n in sizes])))


def _gram_index(labels: DataFrame, rules: DataFrame, col: str) -> DataFrame:
    """Each rule filed under the one of its grams that the fewest labels hold.

    All parts of a rule count, as a label must hold each of them. A part has grams of the
    greatest length in ``GRAMS`` that it reaches, since a longer gram is never held by more
    labels than a shorter one in it; a rule of empty parts is filed under '', which every label
    holds. Grams grow with labels and rules and by more than file sizes tell, so the joins here
    are never broadcast.
    """

    def part_grams(part: str) -> Column:
        text = F.coalesce(F.col(part), F.lit(""))
        found = F.when(F.length(text) < GRAMS[0], F.array().cast("array<string>"))
        for size, longer in zip(GRAMS, GRAMS[1:]):
            found = found.when(F.length(text) < longer, _grams(text, [size]))
        return found.otherwise(_grams(text, GRAMS[-1:]))

    grams = F.array_distinct(F.flatten(F.array(*[part_grams(p) for p in ("m1", "m2", "m3")])))
    none = F.size(grams) == 0
    per_rule = rules.select("*", F.explode(F.when(none, F.array(F.lit(""))).otherwise(grams)).alias("gram"))
    # Equal grams are summed before they are shuffled.
    held = labels.select(F.explode(_grams(F.col(col), GRAMS)).alias("gram"))
    counts = (
        held.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n_labels"))
        .join(per_rule.select("gram").distinct().hint("merge"), "gram", "left_semi")
    )
    rarity = F.struct(F.coalesce("n_labels", F.lit(0)).alias("n"), F.col("gram"))
    with_counts = per_rule.select("id", "gram").join(counts.hint("merge"), "gram", "left")
    filed = with_counts.groupBy("id").agg(F.min(rarity).alias("r"))
    return rules.join(filed.select("id", F.col("r.gram").alias("gram")).hint("merge"), "id")


def rule_candidates(labels: DataFrame, rules: DataFrame, col: str = "norm_label") -> DataFrame:
    """Labels with the rules that may match them: each rule meets only labels that hold its
    rarest gram, so rules with a common beginning do not meet each other's labels.

    The join is an equi join on the gram; adaptive execution splits a gram that many labels
    hold. A rule whose parts are all empty meets every label. Ids are the key of the rule table.
    """
    distinct = labels.select(F.col(col)).filter(F.col(col).isNotNull()).distinct()
    every = F.concat(F.array(F.lit("")), _grams(F.col(col), GRAMS))
    held = distinct.select(col, F.explode(every).alias("gram"))
    # By the size of the label file alone, all grams of all labels might be broadcast.
    return held.hint("merge").join(_gram_index(distinct, rules, col), "gram")


def canonical_by_table(labels: DataFrame, rules: DataFrame, col: str = "norm_label") -> DataFrame:
    """The same result from a rule table of any size: (label, canonical).

    Candidates come from an index of rules by their rarest gram, see ``rule_candidates``.
    A rule with an empty part 1 tests its other parts, as in ``canonical_name``.
    """
    label = F.col(col)

    def has(part: str) -> Column:
        return F.col(part).isNull() | label.contains(F.col(part))

    rank = F.struct(
        "priority",
        F.length("m1") + F.length(F.coalesce("m2", F.lit(""))) + F.length(F.coalesce("m3", F.lit(""))),
        "id",
    )
    best = (
        rule_candidates(labels, rules, col)
        .filter(label.contains(F.col("m1")) & has("m2") & has("m3"))
        .groupBy(col)
        .agg(F.max_by("canonical_name", rank).alias("canonical"))
    )
    return labels.select(col).distinct().join(best, col, "left")


def tag_labels(
    df: DataFrame, raw: str, rules: Sequence[Rule] | DataFrame = V.MERGE_RULES
) -> DataFrame:
    """Add ``canonical`` to a frame with a raw label column.

    A list of rules becomes one expression, a rule table a join; the result is the same.
    """
    normal = df.withColumn("norm_label", norm_label(F.col(raw)))
    if isinstance(rules, DataFrame):
        return normal.join(canonical_by_table(normal, rules), "norm_label", "left").drop("norm_label")
    return normal.withColumn("canonical", canonical_name(F.col("norm_label"), rules)).drop("norm_label")


def raw_label_sums(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity, amount and lines per raw label, summed per product id first."""
    text_col = F.col("description") if "description" in lines.columns else F.lit(None).cast("string")
    by_id = lines.groupBy("product_id", text_col.alias("description")).agg(
        exact_sum(F.col("quantity")).alias("quantity"),
        exact_sum(F.coalesce(F.col("line_total"), F.lit(0.0))).alias("amount"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    label = F.trim(F.coalesce("product_name", "description", F.lit("")))
    return (
        by_id.join(products.select("product_id", "product_name"), "product_id", "left")
        .groupBy(label.alias("raw_display"))
        .agg(F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount"), F.sum("n_lines").alias("n_lines"))
    )


def _qty(col: str = "quantity") -> Column:
    return F.round(F.sum(col), 4).cast("double")


def top_products_normalized(
    lines: DataFrame, products: DataFrame, rules: Sequence[Rule] | DataFrame = V.MERGE_RULES, n: int = 10
) -> DataFrame:
    """Top n products after merging label variants."""
    tagged = tag_labels(raw_label_sums(lines, products), "raw_display", rules)
    return (
        tagged.groupBy(F.coalesce("canonical", "raw_display").alias("product"))
        .agg(
            _qty().alias("total_quantity"),
            F.round(F.sum("amount"), 2).cast("double").alias("total_amount_gel"),
        )
        .orderBy(F.desc("total_quantity"), F.desc("total_amount_gel"), "product")
        .limit(n)
    )


def bucket_audit_counts(tagged: DataFrame, substring: str, bucket: str) -> DataFrame:
    """Lines whose raw text contains a substring: how many fell into the bucket, how many not."""
    hit = tagged.filter(F.col("raw_display").contains(substring))
    inside = F.coalesce(F.col("canonical") == bucket, F.lit(False))
    zero = F.lit(0)
    return hit.agg(
        F.coalesce(F.sum("n_lines"), zero).alias("line_rows"),
        _qty().alias("total_qty"),
        F.coalesce(F.sum(F.when(inside, F.col("n_lines")).otherwise(0)), zero).alias("rows_in_bucket"),
        F.coalesce(F.sum(F.when(inside, 0).otherwise(F.col("n_lines"))), zero).alias("rows_not_in_bucket"),
    )


def bucket_audit_labels(tagged: DataFrame, substring: str) -> DataFrame:
    """Quantity per raw label and canonical name of the same lines."""
    return (
        tagged.filter(F.col("raw_display").contains(substring))
        .groupBy("raw_display", "canonical")
        .agg(_qty().alias("qty"))
        .orderBy(F.desc("qty"), "raw_display")
    )


def bucket_audit_members(tagged: DataFrame, bucket: str) -> DataFrame:
    """Raw labels merged into one bucket."""
    return (
        tagged.filter(F.col("canonical") == bucket)
        .groupBy("raw_display")
        .agg(F.sum("n_lines").alias("n_lines"), _qty().alias("qty"))
        .orderBy(F.desc("qty"), "raw_display")
    )

