import pytest
from pyspark.sql import functions as F

from tradewind.operators import accounts as A
from tradewind.operators import merge_rules as M
from tradewind.operators.entities import fill_store_addresses, store_address_status
from tradewind.plans import catalog
from tradewind.plans.driver_tables import SCHEMAS
from tradewind.session import with_joins_of_dealt_sides


def pairs(df):
    return sorted((r.user_id, r.store_id) for r in df.collect())


def test_assignments(spark):
    base = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, store_id long")
    assert pairs(A.assign_store(base, 1, 2)) == [(1, 1), (1, 2), (2, 1)]
    assert pairs(A.assign_store(base, 2, 9)) == [(1, 1), (1, 2), (2, 1), (2, 9)]
    assert pairs(A.replace_user_stores(base, 1, [7, 7])) == [(1, 7), (2, 1)]
    assert pairs(A.replace_user_stores(base, 1, [])) == [(2, 1)]
    assert pairs(A.remove_user(base, 1)) == [(2, 1)]
    gone = spark.createDataFrame([(1, 2), (5, 5)], "user_id long, store_id long")
    assert pairs(A.remove_pairs(base, gone)) == [(1, 1), (2, 1)]
    stores = spark.createDataFrame([(i, "(უცნობი მყიდველი)" if i == 2 else "x") for i in range(1, 12)], "id long, name string")
    assert pairs(A.default_assignment(stores, 4)) == [(4, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)]


def test_new_users(spark):
    users = spark.createDataFrame([(1, " Ana"), (2, "ANA"), (3, "boss"), (4, "gio")], "id long, username string")
    target = spark.createDataFrame([("Boss",)], "username string")
    stores = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8), (4, 8)], "user_id long, store_id long")
    got = A.load_new_users(users, stores, target)
    assert sorted((r.id, r.username) for r in got.users.collect()) == [(1, "Ana"), (4, "gio")]
    assert pairs(got.user_stores) == [(1, 5), (4, 8)]
    assert tuple(got.counts.first()) == (2, 2)


def test_purge(spark):
    stores = spark.createDataFrame([(1, "(უცნობი მყიდველი)"), (2, "a")], "id long, name string")
    invoices = spark.createDataFrame([(1, 1, "f"), (2, 1, "f"), (3, 2, "g"), (4, 1, None)], "id long, store_id long, source_file string")
    items = spark.createDataFrame([(1, 1), (2, 3)], "id long, invoice_id long")
    got = A.purge_unknown(stores, invoices, items)
    assert [r[0] for r in got.source_files.collect()] == ["f"]
    assert [r.id for r in got.stores.collect()] == [2]
    assert [r.id for r in got.invoices.collect()] == [3] and [r.id for r in got.items.collect()] == [2]


def test_addresses_are_filled_but_never_overwritten(spark):
    hq = "თბილისი, თ.ერისთავის 1"
    stores = spark.createDataFrame([(1, "a", hq), (2, "b", "ქუჩა"), (3, "c", ""), (4, "d", None)], "id long, name string, address string")
    docs = spark.createDataFrame(
        [(1, 1, hq), (2, 1, " x "), (3, 1, "y"), (4, 2, "z"), (5, 3, ""), (6, None, "w")],
        "doc_id long, matched_store_id long, branch_address string",
    )
    got = fill_store_addresses(stores, docs)
    assert {r.id: r.address for r in got.collect()} == {1: "x", 2: "ქუჩა", 3: "", 4: None}
    status = {r.id: r.status for r in store_address_status(got).collect()}
    assert status == {1: "ok", 2: "ok", 3: "bad", 4: "bad"}


def test_merge_rules(spark, tmp_path):
    rules = [
        (10, "low", "პური", None, None),
        (20, "long", "პური", "შავი", None),
        (20, "short", "შავი", None, None),
        (20, "tie a", "ტორტი", None, None),
        (20, "tie b", "ტორტი", None, None),
        (20, "x|y", "ab", None, None),
    ]
    labels = ["თეთრი პური", "შავი პური", "შავი რძე", "ტორტი", "რძე", "", "a|b", "xaby"]
    want = ["low", "long", "short", "tie b", None, None, None, "x|y"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(labels)], "i int, raw string")
    inline = M.tag_labels(df, "raw", rules)
    assert [r.canonical for r in inline.orderBy("i").collect()] == want
    table = M.replace_merge_rules(spark, str(tmp_path / "rules"), rules)
    table = M.replace_merge_rules(spark, str(tmp_path / "rules2"), rules)
    joined = M.tag_labels(df, "raw", table)
    assert [r.canonical for r in joined.orderBy("i").collect()] == want
    many = rules + [(1, f"r{i}", f"no such {i}", None, None) for i in range(600)]
    assert [r.canonical for r in M.tag_labels(df, "raw", many).orderBy("i").collect()] == want
    # An empty first part meets every label, as a list and as a table.
    rest = [*rules, (0, "rest", "", None, None)]
    whole = ["rest" if w is None else w for w in want]
    assert [r.canonical for r in M.tag_labels(df, "raw", rest).orderBy("i").collect()] == whole
    table = M.merge_rules_table(spark, rest)
    assert [r.canonical for r in M.tag_labels(df, "raw", table).orderBy("i").collect()] == whole


def test_default_rules_prefer_french_toast(spark):
    df = spark.createDataFrame([(1, "ფრანგული ტოსტის პური"), (2, "| 3 | სენდვიჩ ტოსტი 47036"), (3, "კულიჩი  47ო")], "i int, raw string")
    got = [r.canonical for r in M.tag_labels(df, "raw").orderBy("i").collect()]
    assert got == ["ფრანგული ტოსტის პური", "სენდვიჩ ტოსტი (470გრ პური)", "კულიჩი (470გრ)"]


def test_pairs_added_in_the_same_pass(spark):
    base = spark.createDataFrame([(1, 1), (1, 1), (7, 2), (2, None)], "user_id long, store_id long")
    sold = spark.createDataFrame([(1, 1), (7, 9), (3, 3), (3, 3)], "user_id long, store_id long")
    once = A.replace_user_stores(base, 7, [3, 5, 5], also=sold)
    twice = A.add_pairs(A.replace_user_stores(base, 7, [3, 5, 5]), sold)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.count() == 6
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_removed_pairs_are_hashed_and_repeated_pairs_stay(spark):
    base = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (3, None)], "user_id long, store_id long")
    gone = spark.createDataFrame([(2, 2), (2, 2), (3, None)], "user_id long, store_id long")
    left = A.remove_pairs(base, gone)
    assert sorted((r.user_id, r.store_id or 0) for r in left.collect()) == [(1, 1), (1, 1), (3, 0)]
    assert "ShuffledHashJoin" in left._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def served(spark, parts):
    """Pairs of 40 stores with the users of their group, dealt by store before they become many."""
    stores = spark.range(40).select(F.col("id").alias("store_id"), (F.col("id") % 3).alias("g")).repartition(parts, "store_id")
    users = spark.range(90).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("h"))
    return stores.join(F.broadcast(users), F.col("g") == F.col("h")).select("user_id", "store_id")


def test_pairs_that_are_dealt_by_store_are_added_to_where_they_are(spark):
    sold = spark.createDataFrame([(1, 1), (7, 9), (3, 77), (3, 77), (5, None)], "user_id long, store_id long")
    got = A.replace_user_stores(served(spark, 5), 7, [3, 5, 5], also=sold, parts=5)
    # Stores before they become pairs, and the new pairs; never all pairs.
    assert len(shuffles(got)) == 2 and not any("user_id" in x for x in shuffles(got))
    want = A.replace_user_stores(served(spark, 5), 7, [3, 5, 5], also=sold)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 40 * 30 - 13 + 5


@pytest.fixture
def small_tables(spark, tmp_path):
    """Tables in which keys repeat or are null, and suppliers sell to customers of other nations."""
    rows = {
        "customer": [(i if i != 5 else None, f"c{i}", i % 3 if i != 8 else None, 0.0, "x") for i in range(1, 31)] + [(4, "c4", 1, 0.0, "x")],
        "supplier": [(i if i != 6 else None, f"s{i}", i % 3, 0.0) for i in range(1, 13)] + [(9, "s9", 0, 0.0), (11, "s11", 2, 0.0)],
        "orders": [(i, i % 33 if i % 7 else None, "O", 1.0, None, "p") for i in range(60)],
        "lineitem": [(i % 70, 1, i % 14 or None, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for i in range(300)],
    }
    for name, data in rows.items():
        spark.createDataFrame(data, SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    pairs = [(s[0], c[0]) for c in rows["customer"] for s in rows["supplier"] if c[2] is not None and c[2] == s[2]]
    sold = {(line[2], o[1]) for line in rows["lineitem"] for o in rows["orders"] if line[0] == o[0]}
    return str(tmp_path), pairs, sold


def test_queries_of_pairs_shuffle_no_pairs_of_a_nation(spark, small_tables):
    folder, pairs, sold = small_tables
    assigned = catalog.load_all()[0]["assign_stores"](spark, folder)
    kept = [p for p in pairs if p[0] is not None and p[0] != 7]
    assert sorted(map(str, map(tuple, assigned.collect()))) == sorted(map(str, {*kept, *sold, (7, 3), (7, 5)}))
    assert not any("user_id" in x or "s_suppkey" in x or "c_nationkey" in x for x in shuffles(assigned))


def test_removed_pairs_leave_the_others_where_they_are(spark, small_tables):
    folder, pairs, sold = small_tables
    left = catalog.load_all()[0]["remove_pairs"](spark, folder)
    gone = {p for p in sold if None not in p}
    want = [p for p in pairs if p[0] is not None and p[0] != 9 and p not in gone]
    assert len(want) > len(set(want))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want))
    assert not any("user_id" in x or "s_suppkey" in x for x in shuffles(left))
    # The session of the caller is left as it is.
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_pairs_are_removed_where_they_are_dealt_by_store(spark):
    here = with_joins_of_dealt_sides(spark)
    gone = here.createDataFrame([(0, 0), (0, 0), (3, 0), (1, 0), (8, None)], "user_id long, store_id long")
    left = A.remove_pairs(served(here, 5), gone, 5)
    assert len(shuffles(left)) == 2 and left.count() == 40 * 30 - 2
    # Pairs that are dealt otherwise are shuffled, with the same result.
    assert A.remove_pairs(served(spark, 3), gone, 5).exceptAll(left).count() == 0
