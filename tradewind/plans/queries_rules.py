"""Registered queries for cleaning rules, labels and entity matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..functions.matching import char_ratio, token_jaccard, waybill_keys
from ..functions.returns import is_return_document, not_return_by_phrases
from ..operators import entities as E
from ..operators import merge_rules as M
from ..operators.scope import filter_by_date_range, in_period, on_listed_days
from ..session import shared_folder
from ..sources.stored_days import store_by_day
from ..sources.tables import enrich_stores, load_frames, load_invoices
from . import sql as S
from .catalog import query
from .driver_tables import END, START, raw_invoices, raw_items, raw_products, raw_stores, star, table

# --- loading and enrichment ----------------------------------------------

_RETURN = "o_orderstatus = 'P'"
_NAME = "CASE c_mktsegment WHEN 'FURNITURE' THEN c_name ELSE replace(c_name, '#', ' ') END"
_DISPLAY = f"""{_NAME} || CASE c_mktsegment
    WHEN 'BUILDING' THEN ' (#' || c_custkey || ')'
    WHEN 'MACHINERY' THEN ' (ბათუმი,_ქუჩა_' || c_nationkey || ')'
    WHEN 'HOUSEHOLD' THEN ' (მისამართი_ბაზაში_არაა) · ID: ' || c_custkey
    WHEN 'FURNITURE' THEN ' (#' || right(c_name, 9) || ')'
    ELSE ' (#' || c_custkey || ')' END"""


@query(
    "store_names",
    f"""SELECT c_custkey AS store_id, {_NAME} AS chain_store_name,
      CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN NULL WHEN c_mktsegment = 'FURNITURE' THEN right(c_name, 9) ELSE CAST(c_custkey AS VARCHAR) END AS store_branch_id,
      {_DISPLAY} AS store_display_name FROM customer""",
)
def _(spark, sf):
    return enrich_stores(raw_stores(spark, sf)).select(
        "store_id", "chain_store_name", "store_branch_id", "store_display_name"
    )


@query(
    "load_invoices",
    f"""SELECT o_orderkey AS invoice_id, o_custkey AS store_id, CAST(o_orderdate AS DATE) AS effective_date,
      o_totalprice AS revenue_gel, {_RETURN} AS parent_invoice_is_return, {_DISPLAY} AS store_display_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    return load_invoices(raw_invoices(spark, sf), raw_stores(spark, sf)).select(
        "invoice_id", "store_id", "effective_date", "revenue_gel", "parent_invoice_is_return", "store_display_name"
    )


@query(
    "load_frames",
    f"""SELECT o_orderkey AS invoice_id, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS product_id,
      CASE WHEN l_linestatus = 'O' THEN p_name WHEN l_returnflag <> 'N' THEN 'item ' || l_suppkey ELSE '' END AS product_label,
      l_quantity AS quantity, l_extendedprice AS line_total, CAST(o_orderdate AS DATE) AS effective_date,
      {_RETURN} AS parent_invoice_is_return, {_DISPLAY} AS store_name
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    LEFT JOIN part ON p_partkey = l_partkey""",
)
def _(spark, sf):
    _, lines = load_frames(
        raw_invoices(spark, sf), raw_items(spark, sf), raw_stores(spark, sf), raw_products(spark, sf)
    )
    return lines.select(
        "invoice_id", "product_id", "product_label", "quantity", "line_total", "effective_date",
        "parent_invoice_is_return", "store_name",
    )


@query(
    "parse_dates",
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) END AS invoice_date,
      CAST(o_orderdate AS DATE) AS created_date FROM orders""",
)
def _(spark, sf):
    return raw_invoices(spark, sf).select(
        "id",
        dates.parse_date_token(F.col("invoice_date")).alias("invoice_date"),
        dates.parse_created_at(F.col("created_at")).alias("created_date"),
    )


@query(
    "period_mask",
    f"""SELECT o_orderkey AS id FROM orders
    WHERE o_orderdate >= DATE '{START}' AND o_orderdate < DATE '{END}' + INTERVAL 1 DAY""",
)
def _(spark, sf):
    inv = raw_invoices(spark, sf).select(
        "id",
        dates.parse_date_token(F.col("invoice_date")).alias("effective_date"),
        F.col("created_at").alias("created_at_raw"),
    )
    return in_period(inv, START, END).select("id")


@query(
    "filter_by_date_range",
    "SELECT event_id, user_id, value FROM events WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-12'",
)
def _(spark, sf):
    start, end = dates.preset_range("7 Days", START.replace(year=2024, month=1, day=11))
    return filter_by_date_range(table(spark, sf, "events"), "ts", start, end).select("event_id", "user_id", "value")


@query(
    "stored_invoices_of_period",
    f"""SELECT o_orderkey AS invoice_id, CAST(o_orderdate AS DATE) AS effective_date, o_totalprice AS revenue_gel, {_DISPLAY} AS store_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    WHERE o_orderdate >= DATE '{START}' AND o_orderdate < DATE '{END}' + INTERVAL 1 DAY""",
)
def _(spark, sf):
    """Invoices parsed once and stored by month, then those of a period."""
    folder = shared_folder(spark, "invoices-by-day")
    loaded = load_invoices(raw_invoices(spark, sf), raw_stores(spark, sf))
    stored = store_by_day(loaded, f"{folder}/invoices", "invoice_id", grain="month", work=folder)
    return in_period(stored, START, END).select("invoice_id", "effective_date", "revenue_gel", "store_name")


@query(
    "stored_lines_of_listed_days",
    f"""SELECT CAST(o_orderdate AS DATE) AS effective_date, count(*) AS n_lines, CAST({S.dec('l_extendedprice')} AS DOUBLE) AS amount
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 400000) GROUP BY 1""",
)
def _(spark, sf):
    """Lines stored by month, summed for the days that had a very large invoice."""
    folder = shared_folder(spark, "lines-by-day")
    _, lines = load_frames(
        raw_invoices(spark, sf), raw_items(spark, sf), raw_stores(spark, sf), raw_products(spark, sf)
    )
    stored = store_by_day(lines, f"{folder}/lines", "invoice_id", "line_id", grain="month", work=folder)
    large = table(spark, sf, "orders").filter(F.col("o_totalprice") > 400000)
    listed = on_listed_days(stored, large.select(F.col("o_orderdate").alias("day")))
    return listed.groupBy("effective_date").agg(
        F.count(F.lit(1)).alias("n_lines"), money.as_double(money.exact_sum(F.col("line_total"))).alias("amount")
    )


@query("is_return_document", f"SELECT o_orderkey AS id, {_RETURN} AS is_return FROM orders")
def _(spark, sf):
    return raw_invoices(spark, sf).select(
        "id",
        is_return_document(F.col("invoice_number"), F.col("notes"), F.col("raw_text")).alias("is_return"),
    )


@query(
    "exclude_returns",
    """SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority >= '3' AND o_orderpriority < '5')
      AND NOT (o_orderstatus = 'F' AND o_orderkey % 7 = 0)""",
)
def _(spark, sf):
    # One blank in the note: the phrase rule of the order history does not fold them.
    invoices = raw_invoices(spark, sf)
    number = F.when(F.col("total").isNotNull() & F.col("notes").isNull() & (F.col("id") % 7 == 0), F.lit("Credit 1"))
    shown = invoices.withColumn("notes", F.regexp_replace("notes", " {2,}", " ")).withColumn(
        "invoice_number", F.coalesce(number, "invoice_number")
    )
    return shown.filter(not_return_by_phrases(F.col("notes"), F.col("invoice_number"))).select("id")


@query(
    "split_sales_returns",
    f"""WITH {S.INV}, {S.LINES}, {S.VALUED}
    SELECT invoice_id, product_id, {S.arr_round('CASE WHEN is_return THEN 0 ELSE sale END', 4)} AS sales,
      {S.arr_round('CASE WHEN is_return THEN credit ELSE 0 END', 4)} AS returns
    FROM priced JOIN inv USING (invoice_id)""",
)
def _(spark, sf):
    s = star(spark, sf)
    joined = s.lines.join(s.invoices, "invoice_id")
    sales, refunds = money.split_sales_returns(
        F.col("quantity"), F.col("unit_price"), F.col("line_total"), F.col("parent_invoice_is_return")
    )
    return joined.select(
        "invoice_id",
        "product_id",
        money.round_array(sales, 4).alias("sales"),
        money.round_array(refunds, 4).alias("returns"),
    )


# --- names and labels ----------------------------------------------------

@query(
    "clean_store_names",
    """SELECT c_custkey AS id, CASE c_mktsegment
      WHEN 'BUILDING' THEN 'შპს ორი ნაბიჯი ' || c_custkey
      WHEN 'MACHINERY' THEN 'სს ზღაპარი' || c_nationkey
      WHEN 'HOUSEHOLD' THEN 'შპს ' || c_name
      WHEN 'FURNITURE' THEN c_name
      ELSE 'შპს ლაქი ' || c_nationkey END AS store_name FROM customer""",
)
def _(spark, sf):
    key, nation, name = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_name")
    messy = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("12. შ პ ს  ორი   წაბიჯი "), key, F.lit(" (ფილიალი)")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("სსზღაპარი"), nation, F.lit(" ,;")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("200249043 წპს "), name, F.lit(" 404040404")))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("- "), name, F.lit(" | ")))
        .otherwise(F.concat(F.lit("შპსშპს ლაქი "), nation, F.lit(" საიდენტიფიკაციო: 123456789")))
    )
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), text.clean_store_name(messy).alias("store_name")
    )


@query(
    "fix_addresses",
    """SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'თბილისი, გლდანი ' || c_nationkey
      WHEN 'MACHINERY' THEN 'თბილისი, დიდი ლილო ' || c_nationkey WHEN 'HOUSEHOLD' THEN NULL
      ELSE 'ნუცუბიძის გამზ ' || c_nationkey END AS address,
      c_mktsegment = 'FURNITURE' AS is_hq FROM customer""",
)
def _(spark, sf):
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    messy = (
        F.when(segment == "BUILDING", F.concat(F.lit("თბილისი,  გელდანი  "), nation))
        .when(segment == "MACHINERY", F.concat(F.lit(" თბილისი, დიდი   ნინო "), nation, F.lit(" ")))
        .when(segment == "HOUSEHOLD", F.lit("  "))
        .otherwise(F.concat(F.lit("ნუცუბიძის   გამზ "), nation))
    )
    site = F.when(segment == "FURNITURE", F.lit("თბილისი, თ.ერისთავის 1")).otherwise(messy)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        text.fix_address_ocr(messy).alias("address"),
        text.is_hq_address(site).alias("is_hq"),
    )


@query(
    "product_labels",
    """SELECT p_partkey AS id, p_name AS product, p_brand || ' 470 ' || p_name AS norm_label,
      CASE WHEN length(p_name) <= 9 THEN p_name ELSE left(p_name, 8) || '…' END AS short_name,
      CASE WHEN p_type = 'PROMO' THEN 7 ELSE 6 END AS shelf_life_days FROM part""",
)
def _(spark, sf):
    name, brand = F.col("p_name"), F.col("p_brand")
    label = F.concat(F.lit("მაღაზია (#7) · | 12 | "), name)
    dirty = F.concat(F.lit("  "), brand, F.lit("|  |47036    "), name)
    kind = F.when(F.col("p_type") == "PROMO", F.lit("DARK პური")).otherwise(F.lit("პური"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        text.product_from_label(label).alias("product"),
        text.norm_label(dirty).alias("norm_label"),
        text.truncate(name, 9).alias("short_name"),
        text.shelf_life(kind).alias("shelf_life_days"),
    )


# The benchmark's product names as merge rules: colour words and kinds of goods.
RULES = (
    (100, "any red ring", "red", "ring", None),
    (100, "red goods", "red", None, None),
    (90, "small goods", "small", None, None),
    (95, "bolt family", "bolt", None, None),
    (95, "blue family", "blue", None, None),
    (95, "blue gears", "blue", "gear", None),
    (80, "widgets", "widget", None, None),
    (80, "kits", "w", "dg", "t"),
)
_RULE_VALUES = ", ".join(
    f"({i}, {p}, '{c}', '{a}', {repr(b) if b else 'NULL'}, {repr(d) if d else 'NULL'})"
    for i, (p, c, a, b, d) in enumerate(RULES, start=1)
)
_NORM = "trim(p_name)"
_TAGGED = f"""rules(id, priority, canonical, m1, m2, m3) AS (VALUES {_RULE_VALUES}),
labels AS (SELECT DISTINCT {_NORM} AS raw_display FROM part),
best AS (
  SELECT raw_display, canonical, row_number() OVER (PARTITION BY raw_display ORDER BY priority DESC,
    length(m1) + length(coalesce(m2, '')) + length(coalesce(m3, '')) DESC, id DESC) AS rn
  FROM labels JOIN rules ON contains(raw_display, m1)
    AND (m2 IS NULL OR contains(raw_display, m2)) AND (m3 IS NULL OR contains(raw_display, m3))),
tagged AS (
  SELECT trim(p_name) AS raw_display, b.canonical, quantity, line_total
  FROM lines JOIN part ON p_partkey = product_id
  LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON b.raw_display = trim(p_name))"""
_RULE_BASE = f"WITH {S.LINES}, {_TAGGED}"


def _tagged(spark, sf):
    s = star(spark, sf)
    return M.tag_labels(M.raw_label_sums(s.lines, s.products), "raw_display", RULES)


@query(
    "top_products_normalized",
    f"""{_RULE_BASE} SELECT coalesce(canonical, raw_display) AS product,
      CAST(round({S.dec('quantity')}, 4) AS DOUBLE) AS total_quantity,
      CAST(round({S.dec('line_total')}, 2) AS DOUBLE) AS total_amount_gel
    FROM tagged GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    s = star(spark, sf)
    return M.top_products_normalized(s.lines, s.products, RULES)


@query(
    "canonical_labels",
    f"{_RULE_BASE} SELECT l.raw_display AS norm_label, canonical FROM labels l LEFT JOIN best b ON b.raw_display = l.raw_display AND rn = 1",
)
def _(spark, sf):
    labels = table(spark, sf, "part").select(text.norm_label(F.col("p_name")).alias("norm_label"))
    return M.canonical_by_table(labels, M.merge_rules_table(spark, RULES))


@query(
    "bucket_audit_counts",
    f"""{_RULE_BASE} SELECT count(*) AS line_rows, CAST(round({S.dec('quantity')}, 4) AS DOUBLE) AS total_qty,
      count(*) FILTER (canonical = 'red goods') AS rows_in_bucket,
      count(*) FILTER (canonical IS NULL OR canonical <> 'red goods') AS rows_not_in_bucket
    FROM tagged WHERE contains(raw_display, 'red')""",
)
def _(spark, sf):
    return M.bucket_audit_counts(_tagged(spark, sf), "red", "red goods")


@query(
    "bucket_audit_labels",
    f"""{_RULE_BASE} SELECT raw_display, canonical, CAST(round({S.dec('quantity')}, 4) AS DOUBLE) AS qty
    FROM tagged WHERE contains(raw_display, 'red') GROUP BY 1, 2""",
)
def _(spark, sf):
    return M.bucket_audit_labels(_tagged(spark, sf), "red")


@query(
    "bucket_audit_members",
    f"""{_RULE_BASE} SELECT raw_display, count(*) AS n_lines, CAST(round({S.dec('quantity')}, 4) AS DOUBLE) AS qty
    FROM tagged WHERE canonical = 'bolt family' GROUP BY 1""",
)
def _(spark, sf):
    return M.bucket_audit_members(_tagged(spark, sf), "bolt family")


# --- similarity ----------------------------------------------------------

_CHARS = """chars(name, ch, n) AS (
  SELECT name, ch, count(*) FROM (SELECT name, unnest(string_split(lower(name), '')) AS ch FROM names) GROUP BY ALL)"""


_SCANNED = """CASE p_type WHEN 'PROMO' THEN p_name || ' ' || p_brand || ' LTD'
        WHEN 'SMALL' THEN regexp_replace('Ltd ' || p_brand || ' ' || p_name, '[aeo]', '', 'g')
        WHEN 'MEDIUM' THEN 'Lted ' || p_brand || ' ' || p_name
        WHEN 'ECONOMY' THEN replace('Ltd ' || p_brand || ' ' || p_name, 'n', 'nn')
        ELSE 'Ltd ' || p_brand || ' ' || p_name END"""


@query(
    "name_similarity",
    f"""WITH n AS (SELECT p_partkey AS id, lower('Ltd ' || p_brand || ' ' || p_name) AS a, lower({_SCANNED}) AS b FROM part),
    ca AS (SELECT id, ch, count(*) AS k FROM (SELECT id, unnest(string_split(a, '')) AS ch FROM n) GROUP BY ALL),
    cb AS (SELECT id, ch, count(*) AS k FROM (SELECT id, unnest(string_split(b, '')) AS ch FROM n) GROUP BY ALL),
    m AS (SELECT id, sum(least(ca.k, cb.k)) AS shared FROM ca JOIN cb USING (id, ch) GROUP BY id)
    SELECT id, round(2.0::DOUBLE * shared / (length(a) + length(b)), 9) AS ratio,
      len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE
        / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS jaccard FROM n JOIN m USING (id)""",
)
def _(spark, sf):
    """Every part's name against its scan."""
    full, scanned = _full_and_scanned()
    # Names cost far more than the shuffle that deals the parts of a small file to all cores.
    return table(spark, sf, "part").repartition("p_partkey").select(
        F.col("p_partkey").alias("id"),
        F.round(char_ratio(full, scanned), 9).alias("ratio"),
        token_jaccard(full, scanned).alias("jaccard"),
    )


def _full_and_scanned():
    """A part's full name, and as scans give it: doubled letters, a lost letter, words turned round."""
    name, brand = F.col("p_name"), F.col("p_brand")
    full = F.concat(F.lit("Ltd "), brand, F.lit(" "), name)
    scanned = (
        F.when(F.col("p_type") == "PROMO", F.concat(name, F.lit(" "), brand, F.lit(" LTD")))
        .when(F.col("p_type") == "SMALL", F.regexp_replace(full, "[aeo]", ""))
        .when(F.col("p_type") == "MEDIUM", F.regexp_replace(full, "^Ltd", "Lted"))
        .when(F.col("p_type") == "ECONOMY", F.regexp_replace(full, "n", "nn"))
        .otherwise(full)
    )
    return full, scanned


def _scanned_names(spark, sf):
    return table(spark, sf, "part").select(_full_and_scanned()[1].alias("name"))


@query(
    "fuzzy_match_stores",
    f"""WITH st AS (SELECT p_partkey AS id, 'Ltd ' || p_brand || ' ' || p_name AS sname FROM part),
    st1 AS (SELECT min(id) AS id, sname FROM st GROUP BY sname),
    names AS (SELECT DISTINCT {_SCANNED} AS name FROM part),
    {_CHARS},
    schars AS (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(lower(sname), '')) AS ch FROM st1) GROUP BY ALL),
    shared AS (SELECT name, id, sum(least(c.n, s.n)) AS m FROM chars c JOIN schars s USING (ch) GROUP BY ALL),
    scored AS (SELECT name, id, sname, greatest(2.0::DOUBLE * m / (length(name) + length(sname)),
        CASE WHEN list_sort(list_distinct(string_split(lower(name), ' '))) = list_sort(list_distinct(string_split(lower(sname), ' ')))
             THEN 0.9::DOUBLE ELSE 0 END) AS score FROM shared JOIN st1 USING (id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS rn FROM scored WHERE score >= 0.9::DOUBLE)
    SELECT name, id AS matched_store_id, sname AS matched_store_name, coalesce(score, 0) AS score
    FROM names LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (name)""",
)
def _(spark, sf):
    stores = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Ltd "), "p_brand", F.lit(" "), "p_name").alias("name")
    )
    return E.fuzzy_match_stores(_scanned_names(spark, sf), stores, work=shared_folder(spark, "fuzzy"))


@query(
    "waybill_keys",
    """SELECT o_orderkey AS id, unnest(list_distinct(CASE o_orderstatus
      WHEN 'P' THEN [printf('%010d/%d', o_orderkey, o_custkey), printf('%010d', o_orderkey)]
      WHEN 'F' THEN ['W-' || printf('%08d', o_custkey)]
      ELSE [printf('%012d', o_orderkey)] END)) AS key FROM orders""",
)
def _(spark, sf):
    key, cust, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    number = (
        F.when(status == "P", F.format_string(" %010d / %d", key, cust))
        .when(status == "F", F.format_string("W-%08d", cust))
        .otherwise(F.concat(F.lit("Invoice_"), key))
    )
    found = F.when(status == "O", F.format_string("%012d", key)).when(status == "F", F.lit("12345"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.explode(waybill_keys(number, found)).alias("key")
    )


# --- entity resolution ---------------------------------------------------

def _found_stores(spark, sf):
    """One document per order; status and priority decide what the text revealed."""
    status, style, cust = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")
    return table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(style < "5", F.col("c_name")).alias("store_name"),
        F.when(status == "P", F.concat(F.lit(" ქუჩა "), "c_nationkey"))
        .when((status == "F") & (style < "2"), F.lit("ფილიალი"))
        .when((status == "F") & (style < "3"), F.lit("ახალი ქუჩა"))
        .alias("branch_address"),
        F.when(style < "4", F.lit("მყიდველი")).alias("buyer_address"),
        F.when((status != "O") & (style < "5"), cust).alias("matched_store_id"),
    )


def _street_stores(spark, sf):
    """Every store twice: its main address and a branch of the same name."""
    customers = table(spark, sf, "customer")
    main = customers.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("ქუჩა "), "c_nationkey").alias("address"),
    )
    branch = customers.select(
        (F.col("c_custkey") + 1_000_000_000).alias("id"), F.col("c_name").alias("name"), F.lit("ფილიალი").alias("address")
    )
    return main.unionByName(branch)


_RESOLVE = """WITH d AS (SELECT o_orderkey AS doc_id, o_custkey, o_orderstatus AS s, o_orderpriority AS y,
    CASE WHEN o_orderpriority < '5' THEN c_name ELSE '(უცნობი მყიდველი)' END AS name, c_nationkey
  FROM orders JOIN customer ON c_custkey = o_custkey),
o AS (SELECT *, CASE WHEN s = 'O' OR y >= '5' THEN 'new_store' WHEN s = 'P' THEN 'same_id_address'
      WHEN y < '2' THEN 'same_name_address' WHEN y < '3' THEN 'new_branch' ELSE 'matched_name' END AS outcome,
    CASE WHEN s = 'P' THEN 'ქუჩა ' || c_nationkey WHEN s = 'F' AND y < '3' THEN 'ახალი ქუჩა'
         WHEN y < '4' THEN 'მყიდველი' ELSE '' END AS addr FROM d),
fresh AS (SELECT DISTINCT name, addr FROM o WHERE outcome IN ('new_store', 'new_branch')),
ids AS (SELECT *, (SELECT max(c_custkey) + 1000000000 FROM customer) + row_number() OVER (
    ORDER BY left(md5(name || '|' || addr), 5), name, addr) AS id FROM fresh)"""


@query(
    "resolve_stores",
    f"""{_RESOLVE} SELECT doc_id, CASE WHEN outcome LIKE 'new%' THEN id
      WHEN outcome = 'same_name_address' THEN o_custkey + 1000000000 ELSE o_custkey END AS store_id, outcome
    FROM o LEFT JOIN ids USING (name, addr)""",
)
def _(spark, sf):
    return E.resolve_stores(_found_stores(spark, sf), _street_stores(spark, sf))[0]


@query("new_stores", f"{_RESOLVE} SELECT id, name, nullif(addr, '') AS address FROM ids")
def _(spark, sf):
    return E.resolve_stores(_found_stores(spark, sf), _street_stores(spark, sf))[1]


@query(
    "new_products",
    """WITH f AS (SELECT 'supply ' || l_suppkey AS name, l_orderkey AS d, l_linenumber AS l, l_extendedprice AS p,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS rn
      FROM lineitem)
    SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY d, l, name) AS id, name,
      'ცალი' AS unit, p AS default_unit_price FROM f WHERE rn = 1""",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"),
        F.concat(F.lit(" supply "), "l_suppkey").alias("name"), F.col("l_extendedprice").alias("unit_price"),
    )
    return E.new_products(items, raw_products(spark, sf))


@query(
    "fill_store_addresses",
    """WITH f AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ქუჩა 1' ELSE 'სახლი ' || o END AS address
    FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
)
def _(spark, sf):
    segment = F.col("c_mktsegment")
    current = (
        F.when(segment == "BUILDING", F.lit("ქუჩა 1"))
        .when(segment == "MACHINERY", F.lit("თბილისი, თ.ერისთავის 1"))
        .when(segment == "HOUSEHOLD", F.lit(None).cast("string"))
    )
    stores = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), current.alias("address"))
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("matched_store_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("ერისთავის_1"))
        .otherwise(F.concat(F.lit(" სახლი "), "o_orderkey")).alias("branch_address"),
    )
    return E.fill_store_addresses(stores, docs)


@query(
    "replace_merge_rules",
    """SELECT p_partkey AS id, p_size AS priority, 'fam ' || p_brand AS canonical_name, lower(p_name) AS m1, p_type AS m2,
      NULL::VARCHAR AS m3, NULL::VARCHAR AS notes FROM part""",
)
def _(spark, sf):
    """The rule table overwritten with a rule per part, and read back."""
    path = shared_folder(spark, "merge-rules")
    none = F.lit(None).cast("string")
    rules = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"),
        F.concat(F.lit("fam "), "p_brand").alias("canonical_name"), F.lower("p_name").alias("m1"),
        F.col("p_type").alias("m2"), none.alias("m3"), none.alias("notes"),
    )
    M.replace_merge_rules(spark, path)
    return M.replace_merge_rules(spark, path, rules)


_SEGMENT_OF_RULE = "['auto', 'building', 'furni', 'mach', 'hold'][s_nationkey % 5 + 1]"


@query(
    "canonical_labels_by_rule_index",
    f"""WITH labels AS (SELECT DISTINCT 'goods of store ' || c_custkey || ' ' || lower(c_mktsegment) AS norm_label FROM customer),
    rules AS (SELECT s_suppkey AS id, CAST(s_nationkey % 3 AS BIGINT) AS priority, 'supplier ' || s_suppkey AS canonical,
      'goods of store ' || s_suppkey AS m1,
      CASE WHEN s_suppkey % 2 = 0 THEN {_SEGMENT_OF_RULE} END AS m2 FROM supplier),
    best AS (SELECT norm_label, canonical, row_number() OVER (PARTITION BY norm_label
        ORDER BY priority DESC, length(m1) + length(coalesce(m2, '')) DESC, id DESC) AS rn
      FROM labels JOIN rules ON contains(norm_label, m1) AND (m2 IS NULL OR contains(norm_label, m2)))
    SELECT l.norm_label, canonical FROM labels l LEFT JOIN best b ON b.norm_label = l.norm_label AND rn = 1""",
)
def _(spark, sf):
    """A rule per supplier, all with one common beginning, over a label per store."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    labels = c.select(
        F.concat(F.lit("goods of store "), "c_custkey", F.lit(" "), F.lower("c_mktsegment")).alias("norm_label")
    )
    segment = F.element_at(
        F.array(*[F.lit(x) for x in ("auto", "building", "furni", "mach", "hold")]), F.col("s_nationkey") % 5 + 1
    )
    none = F.lit(None).cast("string")
    rules = s.select(
        F.col("s_suppkey").alias("id"),
        (F.col("s_nationkey") % 3).alias("priority"),
        F.concat(F.lit("supplier "), "s_suppkey").alias("canonical_name"),
        F.concat(F.lit("goods of store "), "s_suppkey").alias("m1"),
        F.when(F.col("s_suppkey") % 2 == 0, segment).alias("m2"),
        none.alias("m3"),
        none.alias("notes"),
    )
    return M.canonical_by_table(labels, rules)
