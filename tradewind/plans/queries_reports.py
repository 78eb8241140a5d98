"""Registered report and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scope import exclude_unknown_store, scope_filter, store_focus, store_search
from ..session import with_smaller_partitions
from ..sources.tables import load_invoices, load_line_items, load_star
from . import planning as P
from . import reports as R
from . import sql as S
from .catalog import query
from .driver_tables import (
    AS_OF,
    END,
    HISTORY_DAYS,
    START,
    order_facts,
    raw_invoices,
    raw_items,
    raw_products,
    raw_stores,
    star,
    table,
)
from .quality import data_warnings, parity_check
from .session_report import session_report

PERIOD = (START, END)


@query(
    "kpi_bundle",
    f"""{S.BASE}, head AS (
      SELECT CAST({S.dec('revenue_gel')} AS DOUBLE) AS revenue, count(DISTINCT store_name) AS n_stores FROM period),
    body AS (SELECT CAST({S.dec('CASE WHEN is_return THEN credit ELSE 0 END')} AS DOUBLE) AS refunds
      FROM priced JOIN period USING (invoice_id)),
    both_ AS (SELECT *, CASE WHEN revenue > 0 THEN refunds / revenue * 100 ELSE 0 END AS pct FROM head, body)
    SELECT {S.exact_round('revenue', 2)} AS total_revenue_gel, {S.exact_round('refunds', 2)} AS total_returns_gel,
           {S.exact_round('pct', 2)} AS returns_pct, n_stores FROM both_""",
)
def _(spark, sf):
    return R.kpi_bundle(star(spark, sf), *PERIOD)


@query("revenue_by_store", f"{S.BASE}, {S.REVENUE} SELECT * FROM rev")
def _(spark, sf):
    return R.revenue_by_store(star(spark, sf), *PERIOD)


@query("returns_vs_sales_by_store", f"{S.BASE}, {S.SALES_RETURNS} SELECT * FROM sr")
def _(spark, sf):
    return R.returns_vs_sales_by_store(star(spark, sf), *PERIOD)


@query(
    "top_products_by_quantity",
    f"""{S.BASE}, {S.PRODUCTS}, total AS (SELECT CAST(sum(s) AS DOUBLE) AS t FROM prod)
    SELECT product_label, {S.money('q')} AS quantity, {S.money('s')} AS sales_gel,
           {S.money('CAST(s AS DOUBLE) / t * 100')} AS pct_of_sales
    FROM prod, total ORDER BY q DESC, product_label LIMIT 15""",
)
def _(spark, sf):
    return R.top_products_by_quantity(star(spark, sf), *PERIOD)


@query(
    "all_products_by_quantity_share",
    f"""{S.BASE}, {S.PRODUCTS}, total AS (SELECT CAST(sum(q) AS DOUBLE) AS t FROM prod)
    SELECT product_label, {S.money('q')} AS quantity, {S.money('s')} AS sales_gel,
           {S.money('CAST(q AS DOUBLE) / t * 100')} AS pct_of_total_qty FROM prod, total""",
)
def _(spark, sf):
    return R.all_products_by_quantity_share(star(spark, sf), *PERIOD)


@query(
    "daily_revenue",
    f"""{S.BASE} SELECT CAST(effective_date AS DATE) AS day, {S.money(S.dec('revenue_gel'))} AS revenue_gel
    FROM period GROUP BY 1""",
)
def _(spark, sf):
    return R.daily_revenue(star(spark, sf), *PERIOD)


@query(
    "daily_sales_returns",
    f"""{S.BASE} SELECT CAST(effective_date AS DATE) AS day,
      {S.money(S.dec('CASE WHEN is_return THEN 0 ELSE sale END'))} AS sales_gel,
      {S.money(S.dec('CASE WHEN is_return THEN credit ELSE 0 END'))} AS returns_gel
    FROM priced JOIN period USING (invoice_id) GROUP BY 1""",
)
def _(spark, sf):
    return R.daily_sales_returns(star(spark, sf), *PERIOD)


@query(
    "store_share",
    f"""{S.BASE}, {S.SALES_RETURNS}, {S.REVENUE},
    total AS (SELECT CAST({S.dec('revenue_gel')} AS DOUBLE) AS t FROM rev),
    m AS (SELECT store_name, revenue_gel, coalesce(sales_gel, 0) AS sales_gel,
                 coalesce(returns_gel, 0) AS returns_gel FROM rev LEFT JOIN sr USING (store_name))
    SELECT store_name, revenue_gel, sales_gel, returns_gel, {S.money('revenue_gel / t * 100')} AS share_pct,
      {S.money('CASE WHEN sales_gel = 0 THEN 0 ELSE returns_gel / sales_gel * 100 END')} AS return_pct
    FROM m, total""",
)
def _(spark, sf):
    return R.store_share(star(spark, sf), *PERIOD)


@query(
    "restock_by_store",
    f"""{S.BASE}, sums AS (
      SELECT store_name, CAST({S.dec('revenue_gel')} AS DOUBLE) AS revenue_gel FROM period GROUP BY 1),
    daily AS (SELECT *, {S.money(f'revenue_gel / {(END - START).days + 1}')} AS avg_daily_revenue_gel FROM sums)
    SELECT store_name, revenue_gel, avg_daily_revenue_gel,
      {S.money('avg_daily_revenue_gel * 1.75::DOUBLE')} AS recommended_restock_gel,
      CAST(70 + CAST('0x' || left(md5(store_name || '|{START}|{END}'), 8) AS BIGINT) % 11 AS INTEGER) AS confidence_pct
    FROM daily""",
)
def _(spark, sf):
    return R.restock_by_store(star(spark, sf), *PERIOD)


@query("store_metrics", f"{S.BASE}, {S.SALES_RETURNS}, {S.METRICS} SELECT * FROM metrics")
def _(spark, sf):
    return R.store_metrics(R.returns_vs_sales_by_store(star(spark, sf), *PERIOD))


@query(
    "heat_classes",
    f"""{S.BASE}, {S.SALES_RETURNS}, {S.METRICS} SELECT *,
      CASE WHEN return_rate_pct > 30 THEN 'red' WHEN return_rate_pct < 10 THEN 'green' ELSE 'neutral' END AS heat
    FROM metrics""",
)
def _(spark, sf):
    return R.heat_classes(R.store_metrics(R.returns_vs_sales_by_store(star(spark, sf), *PERIOD)))


@query(
    "network_summary",
    f"""{S.BASE}, {S.SALES_RETURNS}, {S.PRODUCTS},
    t AS (SELECT CAST({S.dec('sales_gel')} AS DOUBLE) AS total_sales_gel,
                 CAST({S.dec('returns_gel')} AS DOUBLE) AS total_returns_gel FROM sr),
    n AS (SELECT count(DISTINCT store_name) AS active_stores FROM period),
    top AS (SELECT product_label AS top_product, {S.money('q')} AS top_quantity
            FROM prod ORDER BY q DESC, product_label LIMIT 1),
    r AS (SELECT *, total_returns_gel / total_sales_gel * 100 AS rate FROM t)
    SELECT total_sales_gel, total_returns_gel, {S.money('rate')} AS return_rate_pct,
      CASE WHEN rate <= 10 THEN 'low' WHEN rate <= 22 THEN 'medium' ELSE 'high' END AS risk_band,
      active_stores, top_product, top_quantity FROM r, n, top""",
)
def _(spark, sf):
    return R.network_summary(star(spark, sf), *PERIOD)


@query(
    "best_worst_store",
    f"""{S.BASE}, {S.SALES_RETURNS}, {S.METRICS}, ok AS (SELECT * FROM metrics WHERE sales_gel > 1e-6),
    b AS (SELECT store_name AS best_store, return_rate_pct AS best_rate_pct FROM ok ORDER BY 2, 1 LIMIT 1),
    w AS (SELECT store_name AS worst_store, return_rate_pct AS worst_rate_pct FROM ok ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT * FROM b, w""",
)
def _(spark, sf):
    return R.best_worst_store(R.store_metrics(R.returns_vs_sales_by_store(star(spark, sf), *PERIOD)))


@query(
    "top_n_plus_other",
    f"""{S.BASE}, {S.REVENUE}, ranked AS (
      SELECT *, row_number() OVER (ORDER BY revenue_gel DESC, store_name) AS rn FROM rev)
    SELECT CASE WHEN rn <= 10 THEN store_name ELSE 'სხვა მაღაზიები' END AS store_name,
      CAST({S.dec('revenue_gel')} AS DOUBLE) AS revenue_gel FROM ranked GROUP BY 1""",
)
def _(spark, sf):
    return R.top_n_plus_other(R.revenue_by_store(star(spark, sf), *PERIOD))


@query(
    "top_stores_by_sales",
    f"{S.BASE}, {S.SALES_RETURNS} SELECT * FROM sr ORDER BY sales_gel DESC, store_name LIMIT 15",
)
def _(spark, sf):
    return R.top_stores_by_sales(R.returns_vs_sales_by_store(star(spark, sf), *PERIOD))


@query(
    "top_return_rates",
    f"""{S.BASE}, {S.SALES_RETURNS}, {S.METRICS} SELECT store_name, return_rate_pct AS return_pct FROM metrics
    WHERE return_rate_pct IS NOT NULL ORDER BY abs(return_rate_pct) DESC, store_name LIMIT 20""",
)
def _(spark, sf):
    return R.top_return_rates(R.store_metrics(R.returns_vs_sales_by_store(star(spark, sf), *PERIOD)))


@query(
    "products_across_stores",
    f"""{S.BASE}, {S.PRODUCTS}, rounded AS (
      SELECT regexp_extract(product_label, ' · (.*)$', 1) AS product, {S.money('q')} AS quantity,
             {S.money('s')} AS sales_gel FROM prod)
    SELECT product, CAST({S.dec('quantity')} AS DOUBLE) AS quantity, CAST({S.dec('sales_gel')} AS DOUBLE) AS sales_gel
    FROM rounded GROUP BY product ORDER BY 2 DESC, 1 LIMIT 15""",
)
def _(spark, sf):
    return R.products_across_stores(R.all_products_by_quantity_share(star(spark, sf), *PERIOD))


@query(
    "period_counts",
    f"""{S.BASE} SELECT (SELECT count(*) FROM period) AS n_invoices,
      (SELECT count(*) FROM lines JOIN period USING (invoice_id)) AS n_lines""",
)
def _(spark, sf):
    return R.period_counts(star(spark, sf), *PERIOD)


@query(
    "returns_line_sample",
    f"""{S.BASE} SELECT invoice_id, store_name, store_name AS unique_store_key, quantity, unit_price, line_total,
      p_name AS product_label, is_return AS parent_invoice_is_return
    FROM lines JOIN period USING (invoice_id) JOIN part ON p_partkey = product_id
    ORDER BY invoice_id, product_id, quantity, unit_price, line_total LIMIT 25""",
)
def _(spark, sf):
    return R.returns_line_sample(star(spark, sf), *PERIOD)


_RAW_STORE_ADDRESS = """CASE c_mktsegment WHEN 'BUILDING' THEN 'თბილისი,თ.ერისთავის 1, ქუჩა ' || c_nationkey || ' #' || c_custkey
  WHEN 'MACHINERY' THEN '  ბათუმი, ქუჩა ' || c_nationkey WHEN 'HOUSEHOLD' THEN NULL
  WHEN 'FURNITURE' THEN 'თბილისი, თ.ერისთავის_1' ELSE 'ქუთაისი #' || c_nationkey || chr(160) || '＃ ' || c_custkey END"""


@query(
    "largest_invoices",
    f"""WITH s AS (SELECT c_custkey, {_RAW_STORE_ADDRESS} AS address FROM customer),
    top AS (SELECT o_orderkey AS id, o_totalprice, o_orderstatus, o_orderpriority FROM orders JOIN s ON c_custkey = o_custkey
      WHERE o_orderstatus <> 'O' AND (address ILIKE '%ბათუმი, ქუჩა 7' OR address ILIKE '%ქუჩა 3 %')
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
    SELECT id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority < '3' THEN 'CR-' ELSE 'CRATE-' END || id AS invoice_number,
      'file_' || id || '.pdf' AS source_file, o_totalprice AS total,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = id) AS items FROM top""",
)
def _(spark, sf):
    return R.largest_invoices(
        raw_invoices(spark, sf), raw_items(spark, sf), raw_stores(spark, sf), ("%ბათუმი, ქუჩა 7", "%ქუჩა 3 %")
    )


@query(
    "return_candidates",
    """WITH top AS (SELECT o_orderkey AS id, o_totalprice, o_orderpriority, o_custkey FROM orders
      WHERE o_orderstatus = 'P' AND o_orderpriority < '5' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)
    SELECT id, CASE WHEN o_orderpriority < '3' THEN 'CR-' ELSE 'BOX-' END || id AS invoice_number,
      CASE WHEN o_orderpriority >= '3' THEN 'time=10:00:00 | უკან დაბრუნება' ELSE 'Creditors' END AS notes,
      o_totalprice AS total,
      CASE c_mktsegment WHEN 'FURNITURE' THEN c_name ELSE replace(c_name, '#', ' ') END AS store_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = id) AS items
    FROM top JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    invoices = raw_invoices(spark, sf).withColumns(
        {
            "invoice_number": F.regexp_replace("invoice_number", "^CRATE", "BOX"),
            "notes": F.regexp_replace("notes", " {2,}", " "),
        }
    )
    return R.return_candidates(invoices, raw_items(spark, sf), raw_stores(spark, sf))


@query(
    "negative_lines",
    """SELECT count(*) AS n_negative, CAST(sum(CAST(-l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_negative,
      (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority >= '3' AND o_orderpriority < '5') AS n_noted_invoices
    FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F'""",
)
def _(spark, sf):
    return R.negative_lines(star(spark, sf).lines, raw_invoices(spark, sf))


# --- planning ------------------------------------------------------------

def _history(spark, sf):
    invoices, lines = order_facts(spark, sf)
    return P.order_history(invoices, lines, AS_OF, HISTORY_DAYS)


_PLAN = f"WITH {S.INV}, {S.HISTORY}, {S.FREQ}"


@query(
    "order_history",
    f"""WITH {S.INV}, {S.SOLD} SELECT store_id, product_id, description, CAST(effective_date AS DATE) AS visit_date,
      CAST({S.dec('quantity')} AS DOUBLE) AS quantity, CAST({S.dec('line_total')} AS DOUBLE) AS line_total, count(*) AS n_lines
    FROM sold JOIN inv USING (invoice_id) WHERE quantity > 0 AND NOT is_return
      AND effective_date >= DATE '{AS_OF}' - INTERVAL {HISTORY_DAYS} DAY GROUP BY ALL""",
)
def _(spark, sf):
    h = _history(spark, sf)
    return h.withColumns({c: F.col(c).cast("double") for c in ("quantity", "line_total")})


@query("visit_frequency", f"{_PLAN} SELECT store_id, visit_freq_days, n_visits, CAST(n_days AS INTEGER) AS n_days FROM freq")
def _(spark, sf):
    return P.visit_frequency(_history(spark, sf))


@query("product_recommendations", f"{_PLAN}, {S.RECS} SELECT * FROM banded")
def _(spark, sf):
    return P.product_recommendations(_history(spark, sf), star(spark, sf).products)


_ORDER_PLAN = f"""{_PLAN}, {S.RECS}, {S.STORES}, tot AS (
      SELECT store_id, CAST(sum(recommended_qty) AS BIGINT) AS total_pieces, count(*) AS n_products,
        count(*) FILTER (confidence_band = 'high') AS n_high, count(*) FILTER (confidence_band = 'medium') AS n_medium,
        count(*) FILTER (confidence_band = 'low') AS n_low FROM banded GROUP BY 1),
    plan AS (SELECT s.store_id, store_name, coalesce(visit_freq_days, 2.0) AS visit_freq_days,
      DATE '{AS_OF}' + CAST(round_even(coalesce(visit_freq_days, 2.0), 0) AS INTEGER) AS next_visit,
      coalesce(total_pieces, 0) AS total_pieces, coalesce(n_products, 0) AS n_products, coalesce(n_high, 0) AS n_high,
      coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low
    FROM stores s LEFT JOIN freq USING (store_id) LEFT JOIN tot USING (store_id))"""


@query("order_plan", f"{_ORDER_PLAN} SELECT * FROM plan")
def _(spark, sf):
    s = star(spark, sf)
    return P.order_plan(_history(spark, sf), s.products, s.stores, AS_OF)


@query(
    "order_plan_summary",
    f"""{_ORDER_PLAN}, m AS (SELECT count(*) AS n_stores, CAST({S.dec('visit_freq_days')} AS DOUBLE) / count(*) AS mean FROM plan)
    SELECT n_stores, {S.exact_round('mean', 1)} AS mean_visit_freq FROM m""",
)
def _(spark, sf):
    s = star(spark, sf)
    return P.order_plan_summary(P.order_plan(_history(spark, sf), s.products, s.stores, AS_OF))


# --- scope, quality, bundle ----------------------------------------------

def _nation_scope(spark, sf):
    """Stores of the nations that have a supplier with a low balance, as an assignment."""
    low = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 1000)
    c = table(spark, sf, "customer")
    nations = low.select(F.col("s_nationkey").alias("c_nationkey"))
    return c.join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("store_id"))


_SCOPED = "c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000)"


@query(
    "scope_filter",
    f"""SELECT o_orderkey AS invoice_id, o_custkey AS store_id, o_totalprice AS revenue_gel FROM orders
    JOIN customer ON c_custkey = o_custkey WHERE {_SCOPED}""",
)
def _(spark, sf):
    return scope_filter(star(spark, sf).invoices, _nation_scope(spark, sf)).select(
        "invoice_id", "store_id", "revenue_gel"
    )


@query(
    "store_focus",
    f"{S.BASE} SELECT * FROM stores WHERE contains(store_name, '#12')",
)
def _(spark, sf):
    stores = star(spark, sf).stores.withColumnRenamed("store_display_name", "store_name")
    return store_focus(stores, "რა ხდება ფილიალში #12?", "store_name")


@query(
    "store_search",
    f"""WITH s AS (SELECT c_custkey AS id,
      CASE c_mktsegment WHEN 'FURNITURE' THEN c_name ELSE replace(c_name, '#', ' ') END AS name, {_RAW_STORE_ADDRESS} AS address FROM customer)
    SELECT * FROM s WHERE contains(lower(name), '99') OR contains(coalesce(address, ''), '99')""",
)
def _(spark, sf):
    return store_search(exclude_unknown_store(raw_stores(spark, sf)), "99")


_KPI_SQL = f"""kpi AS (SELECT CAST({S.dec('revenue_gel')} AS DOUBLE) AS rev, count(DISTINCT store_name) AS n FROM period),
    ref AS (SELECT CAST({S.dec('CASE WHEN is_return THEN credit ELSE 0 END')} AS DOUBLE) AS refunds
      FROM priced JOIN period USING (invoice_id))"""


def _report_sql() -> str:
    """The bundle for the scope above, focus on stores whose name has '#12'."""

    def block(tag: str, where: str, prefix: str, n_products: int, n_restock: int) -> str:
        return f"""p{tag} AS (SELECT * FROM period WHERE {where}),
        k{tag} AS (SELECT coalesce(CAST({S.dec('revenue_gel')} AS DOUBLE), 0) AS rev, count(DISTINCT store_name) AS n FROM p{tag}),
        f{tag} AS (SELECT coalesce(CAST({S.dec('CASE WHEN p.is_return THEN credit ELSE 0 END')} AS DOUBLE), 0) AS refunds
          FROM priced JOIN p{tag} p USING (invoice_id)),
        r{tag} AS (SELECT store_name, CAST({S.dec('revenue_gel')} AS DOUBLE) AS r FROM p{tag} GROUP BY 1),
        a{tag} AS (SELECT store_name, {S.money('r')} AS revenue_gel, {S.money(f'r / {(END - START).days + 1}')} AS avg_d FROM r{tag}),
        b{tag} AS (SELECT *, {S.money('avg_d * 1.75::DOUBLE')} AS rec,
          CAST(70 + CAST('0x' || left(md5(store_name || '|{START}|{END}'), 8) AS BIGINT) % 11 AS DOUBLE) AS conf FROM a{tag}),
        c{tag} AS (SELECT *, row_number() OVER (ORDER BY rec DESC, store_name) AS rk FROM b{tag}),
        q{tag} AS (SELECT store_name || ' · ' || p_name AS product_label, {S.dec('quantity')} AS q, {S.dec('greatest(line_total, 0)')} AS s
          FROM lines JOIN p{tag} USING (invoice_id) JOIN part ON p_partkey = product_id GROUP BY 1),
        t{tag} AS (SELECT *, row_number() OVER (ORDER BY q DESC, product_label) AS rk FROM q{tag}),
        out{tag} AS (
          SELECT '{prefix}kpi' AS section, 1 AS rank, 'all' AS name, 'total_revenue_gel' AS metric, {S.exact_round('rev', 2)} AS value FROM k{tag}
          UNION ALL SELECT '{prefix}kpi', 1, 'all', 'total_returns_gel', {S.exact_round('refunds', 2)} FROM f{tag}
          UNION ALL SELECT '{prefix}kpi', 1, 'all', 'returns_pct', {S.exact_round('(CASE WHEN rev > 0 THEN refunds / rev * 100 ELSE 0 END)', 2)} FROM k{tag}, f{tag}
          UNION ALL SELECT '{prefix}kpi', 1, 'all', 'n_stores', CAST(n AS DOUBLE) FROM k{tag}
          UNION ALL SELECT '{prefix}restock', rk, store_name, 'recommended_restock_gel', rec FROM c{tag} WHERE rk <= {n_restock}
          UNION ALL SELECT '{prefix}restock', rk, store_name, 'avg_daily_revenue_gel', avg_d FROM c{tag} WHERE rk <= {n_restock}
          UNION ALL SELECT '{prefix}restock', rk, store_name, 'confidence_pct', conf FROM c{tag} WHERE rk <= {n_restock}
          UNION ALL SELECT '{prefix}products', rk, product_label, 'quantity', {S.money('q')} FROM t{tag} WHERE rk <= {n_products}
          UNION ALL SELECT '{prefix}products', rk, product_label, 'sales_gel', {S.money('s')} FROM t{tag} WHERE rk <= {n_products})"""

    scoped = f"store_id IN (SELECT c_custkey FROM customer WHERE {_SCOPED})"
    return f"""{S.BASE}, {block('1', scoped, '', 8, 8)},
    {block('2', scoped + " AND contains(store_name, '#12')", 'focus_', 5, 3)},
    d AS (SELECT *, row_number() OVER (ORDER BY revenue_gel DESC, store_name) AS rk FROM a1)
    SELECT section, CAST(rank AS INTEGER) AS rank, name, metric, value FROM (
      SELECT * FROM out1 UNION ALL SELECT * FROM out2
      UNION ALL SELECT 'revenue', rk, store_name, 'revenue_gel', revenue_gel FROM d WHERE rk <= 8)"""


@query("session_report", _report_sql())
def _(spark, sf):
    spark = with_smaller_partitions(spark)
    return session_report(star(spark, sf), *PERIOD, "როგორია #12?", _nation_scope(spark, sf))


@query(
    "data_warnings",
    """WITH a AS (SELECT DISTINCT 'ბათუმი, ქუჩა ' || c_nationkey AS addr FROM customer WHERE c_mktsegment = 'MACHINERY'
      UNION SELECT 'თბილისი, თ.ერისთავის_1' FROM customer WHERE c_mktsegment = 'FURNITURE'),
    top AS (SELECT addr FROM a ORDER BY addr LIMIT 15)
    SELECT 'sales_equal_returns' AS "check", 0::BIGINT AS n, NULL::VARCHAR AS sample
    UNION ALL SELECT 'credit_text_without_returns', 0, NULL
    UNION ALL SELECT 'no_returns_sample', 0, NULL
    UNION ALL SELECT 'address_without_code', (SELECT count(*) FROM a), (SELECT string_agg(addr, ' | ' ORDER BY addr) FROM top)""",
)
def _(spark, sf):
    loaded = load_star(raw_invoices(spark, sf), raw_items(spark, sf), raw_stores(spark, sf), raw_products(spark, sf))
    return data_warnings(loaded, *PERIOD)


@query(
    "data_warnings_without_returns",
    f"""WITH a AS (SELECT DISTINCT 'ბათუმი, ქუჩა ' || c_nationkey AS addr FROM customer WHERE c_mktsegment = 'MACHINERY'
      UNION SELECT 'თბილისი, თ.ერისთავის_1' FROM customer WHERE c_mktsegment = 'FURNITURE'),
    top AS (SELECT addr FROM a ORDER BY addr LIMIT 15),
    t AS (SELECT o_orderkey AS id, 'ტიპი: ' || CASE WHEN o_orderstatus = 'P' AND o_orderpriority >= '5' THEN 'კორექტირება ' ELSE 'მიწოდება ' END
        || o_orderkey || repeat(' ', 6000) || CASE WHEN o_orderkey % 5 = 0 THEN 'საკრედიტო' ELSE '' END AS text
      FROM orders WHERE o_orderdate >= DATE '{START}' AND o_orderdate < DATE '{END}' + INTERVAL 1 DAY)
    SELECT 'sales_equal_returns' AS "check", 0::BIGINT AS n, NULL::VARCHAR AS sample
    UNION ALL SELECT 'credit_text_without_returns', count(*), 'invoice_id=' || min(id) FROM t WHERE id % 5 = 0
    UNION ALL SELECT 'no_returns_sample', 1, (SELECT 'invoice_id=' || id || ' ' || left(text, 900) FROM t ORDER BY id LIMIT 1)
    UNION ALL SELECT 'address_without_code', (SELECT count(*) FROM a), (SELECT string_agg(addr, ' | ' ORDER BY addr) FROM top)""",
)
def _(spark, sf):
    """No invoice counts as a return although texts name credits, far behind their beginning."""
    loaded = load_star(raw_invoices(spark, sf), raw_items(spark, sf), raw_stores(spark, sf), raw_products(spark, sf))
    credit = F.when(F.col("invoice_id") % 5 == 0, F.lit("საკრედიტო")).otherwise(F.lit(""))
    invoices = loaded.invoices.withColumns(
        {
            "parent_invoice_is_return": F.lit(False),
            "raw_text": F.concat("raw_text", F.lit(" " * 6000), credit),
        }
    )
    return data_warnings(loaded._replace(invoices=invoices), *PERIOD)


@query(
    "returns_in_long_texts",
    """SELECT doc_id AS invoice_id, n_chars AS revenue_gel, lang = 'es' AS parent_invoice_is_return FROM documents""",
)
def _(spark, sf):
    """Documents as invoices whose return phrase stands thousands of characters behind the text."""
    phrase = F.when(F.col("lang") == "es", F.lit("უკან  დაბრუნება")).otherwise(F.lit("მიწოდება"))
    invoices = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit(1).cast("long").alias("store_id"),
        F.lit("2026-01-01").alias("invoice_date"),
        F.lit(None).cast("double").alias("subtotal"),
        F.col("n_chars").cast("double").alias("total"),
        F.lit("2026-01-01").alias("created_at"),
        F.concat(F.lit("N-"), F.col("doc_id")).alias("invoice_number"),
        F.lit(None).cast("string").alias("notes"),
        F.concat("text", F.lit(" ." * 3000), phrase).alias("raw_text"),
    )
    loaded = load_star(invoices, raw_items(spark, sf), raw_stores(spark, sf), raw_products(spark, sf))
    return loaded.invoices.select("invoice_id", "revenue_gel", "parent_invoice_is_return")


@query(
    "optional_columns",
    """SELECT l_orderkey AS invoice_id, CASE WHEN l_linestatus = 'O' THEN p_name WHEN l_returnflag <> 'N' THEN 'item ' || l_suppkey ELSE '' END AS product_label,
      l_returnflag = 'R' AS is_return, o_orderstatus AS kind
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
)
def _(spark, sf):
    """Tables with columns that only some versions have: they are carried through."""
    kinds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    invoices = raw_invoices(spark, sf).join(kinds, "id")
    flags = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("product_id"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("item "), F.col("l_suppkey"))).alias("description"),
        F.monotonically_increasing_id().alias("id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price"),
        F.col("l_extendedprice").alias("line_total"),
        (F.col("l_returnflag") == "R").alias("is_return"),
    )
    lines = load_line_items(flags, raw_products(spark, sf), invoices)
    loaded = load_invoices(invoices, raw_stores(spark, sf))
    return lines.join(loaded.select("invoice_id", "kind"), "invoice_id").select(
        "invoice_id", "product_label", "is_return", "kind"
    )


@query(
    "parity_check",
    f"""{S.BASE}, {S.SALES_RETURNS}, {_KPI_SQL},
    kept AS (SELECT * FROM period WHERE NOT is_return),
    rep AS (SELECT (SELECT count(*) FROM inv) AS a_inv, (SELECT count(*) FROM inv WHERE NOT is_return) AS b_inv,
      (SELECT rev FROM kpi) AS a_rev, (SELECT CAST({S.dec('revenue_gel')} AS DOUBLE) FROM kept) AS b_rev,
      (SELECT refunds FROM ref) AS a_ret, (SELECT n FROM kpi) AS a_n, (SELECT count(DISTINCT store_name) FROM kept) AS b_n)
    SELECT * FROM (
      SELECT 'invoice_rows' AS metric, CAST(a_inv AS DOUBLE) AS "left", CAST(b_inv AS DOUBLE) AS "right" FROM rep
      UNION ALL SELECT 'total_revenue_gel', {S.exact_round('a_rev', 2)}, {S.exact_round('b_rev', 2)} FROM rep
      UNION ALL SELECT 'total_returns_gel', {S.exact_round('a_ret', 2)}, 0 FROM rep
      UNION ALL SELECT 'returns_pct', {S.exact_round('(a_ret / a_rev * 100)', 2)}, 0 FROM rep
      UNION ALL SELECT 'n_stores', a_n, b_n FROM rep
      UNION ALL SELECT 'revenue_by_store_sum', {S.exact_round('a_rev', 2)}, {S.exact_round('b_rev', 2)} FROM rep
      UNION ALL SELECT 'returns_vs_sales_returns', (SELECT CAST({S.dec('returns_gel')} AS DOUBLE) FROM sr), 0
      UNION ALL SELECT 'invoices_column:kind', 0, 1 UNION ALL SELECT 'lines_column:note', 1, 0)
    WHERE abs("left" - "right") > CASE WHEN metric IN ('invoice_rows', 'n_stores') THEN 0 ELSE 0.01 END""",
)
def _(spark, sf):
    full = star(spark, sf)
    kept = full.invoices.filter(~F.col("parent_invoice_is_return")).withColumn("kind", F.lit("x"))
    partial = full._replace(invoices=kept)
    noted = full._replace(lines=full.lines.withColumn("note", F.lit("x")))
    return parity_check(noted, partial, *PERIOD)
