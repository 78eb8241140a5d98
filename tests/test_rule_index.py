"""Rules filed under their rarest gram: results of brute force, few candidates."""

from pyspark.sql import functions as F

from tradewind.operators import merge_rules as M

WORDS = "შავი თეთრი პური ტორტი რძე ab a 12 x".split()


def _brute(labels, rules):
    out = {}
    for label in labels:
        best = None
        for i, (priority, name, *parts) in enumerate(rules, start=1):
            if label is not None and all(p is None or p in label for p in parts):
                rank = (priority, sum(len(p or "") for p in parts), i)
                best = max(best or (rank, name), (rank, name))
        out[label] = best and best[1]
    return out


def test_equals_brute_force(spark):
    labels = [f"{a} {b}{c}" for a in WORDS for b in WORDS for c in ("", "x", " რძე")]
    labels += ["", "a", "ab", None, labels[0], "x" * 50_000 + "zq"]
    rules = [(i % 4, f"r{i}", a, b if i % 3 else None, "" if i % 5 == 0 else None)
             for i, (a, b) in enumerate((a, b) for a in [*WORDS, "zq"] for b in WORDS)]
    rules += [(9, "empty one", "", "შავი ab", None), (-1, "rest of x", "", None, "x")]
    df = spark.createDataFrame([(s,) for s in labels], "norm_label string")
    got = M.canonical_by_table(df, M.merge_rules_table(spark, rules)).collect()
    assert {r.norm_label: r.canonical for r in got} == _brute(labels, rules)
    assert len(got) == len(set(labels))


def test_empty_tables(spark):
    labels = spark.createDataFrame([("a",)], "norm_label string")
    rules = M.merge_rules_table(spark, [(1, "r", "a", None, None)])
    got = M.canonical_by_table(labels, rules.filter("false")).collect()
    assert [tuple(r) for r in got] == [("a", None)]
    assert M.canonical_by_table(labels.filter("false"), rules).count() == 0


def test_common_beginning_does_not_multiply_candidates(spark):
    """10,000 rules with one prefix: labels meet the rules of their own number, not all."""
    n = 10_000
    ids = spark.range(1, n + 1)
    code = F.lpad(F.conv(F.pmod(F.xxhash64("id"), F.lit(36**8)).cast("string"), 10, 36), 8, "0")
    text = F.concat(F.lit("same beginning of every rule "), code)
    none = F.lit(None).cast("string")
    rules = ids.select(
        "id", F.lit(1).alias("priority"), F.concat(F.lit("r"), "id").alias("canonical_name"),
        text.alias("m1"), none.alias("m2"), none.alias("m3"), none.alias("notes"),
    )
    labels = ids.select(F.concat(text, F.lit(" end")).alias("norm_label"))
    candidates = M.rule_candidates(labels, rules).count()
    # The first characters alone would give n * n; the rarest of eight random characters' grams
    # is held by about one label in a hundred thousand and by a few at most.
    assert n <= candidates < 10 * n
    got = M.canonical_by_table(labels, rules)
    assert got.filter("canonical IS NULL").isEmpty() and got.count() == n


def test_numbered_rules_meet_labels_of_their_number_only_and_nothing_is_broadcast(spark):
    """Rules that end in a number: three characters of it are held by many labels, the whole by few."""
    n = 4_000
    ids = spark.range(1, n + 1)
    none = F.lit(None).cast("string")
    text = F.concat(F.lit("goods of store "), F.col("id") + 1_000_000)
    rules = ids.select(
        "id", F.lit(1).alias("priority"), F.concat(F.lit("r"), "id").alias("canonical_name"),
        text.alias("m1"), none.alias("m2"), none.alias("m3"), none.alias("notes"),
    )
    labels = ids.select(F.concat(text, F.lit(" end")).alias("norm_label"))
    found = M.rule_candidates(labels, rules)
    assert found.count() == n
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
