"""Building blocks of the equivalent SQL, written without the package's expressions."""

from __future__ import annotations

from .driver_tables import AS_OF, END, HISTORY_DAYS, START

IN_PERIOD = f"effective_date >= DATE '{START}' AND effective_date < DATE '{END}' + INTERVAL 1 DAY"

INV = """inv AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS store_id, o_orderdate AS effective_date,
         o_totalprice AS revenue_gel, o_orderstatus = 'P' AS is_return
  FROM orders)"""
LINES = """lines AS (
  SELECT l_orderkey AS invoice_id, l_partkey AS product_id,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
         l_extendedprice / l_quantity AS unit_price,
         CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN -l_extendedprice
              ELSE l_extendedprice END AS line_total
  FROM lineitem)"""
VALUED = """valued AS (
  SELECT *, abs(quantity) * abs(unit_price) AS implied,
         CASE WHEN quantity < 0 AND abs(line_total) < 1e-12
              THEN abs(quantity) * abs(unit_price) ELSE line_total END AS v
  FROM lines),
priced AS (
  SELECT *, greatest(v, 0.0::DOUBLE) AS sale,
         CASE WHEN abs(v) > 1e-12 THEN abs(v) ELSE implied END AS credit
  FROM valued)"""
STORES = """stores AS (
  SELECT c_custkey AS store_id, c_name || ' (#' || c_custkey || ')' AS store_name FROM customer)"""
PERIOD = f"""period AS (
  SELECT inv.*, store_name FROM inv JOIN stores USING (store_id) WHERE {IN_PERIOD})"""
BASE = f"WITH {INV}, {LINES}, {VALUED}, {STORES}, {PERIOD}"


def dec(x: str) -> str:
    """Exact sum of a double column."""
    return f"sum(CAST({x} AS DECIMAL(18,4)))"


def arr_round(x: str, digits: int) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}, 0) / {scale})"


def money(x: str) -> str:
    return arr_round(x, 2)


def exact_round(x: str, digits: int) -> str:
    """Nearest decimal of the exact binary value; x should be a plain column."""
    s = f"{10**digits}::DOUBLE"
    x = f"CAST({x} AS DOUBLE)"
    p = f"({x} * {s})"
    c = f"({x} * 134217729::DOUBLE)"
    hi = f"({c} - ({c} - {x}))"
    err = f"(({hi} * {s} - {p}) + ({x} - {hi}) * {s})"
    return (
        f"(CASE WHEN abs({p} - floor({p}) - 0.5::DOUBLE) = 0 AND {err} > 0 THEN ceil({p}) "
        f"WHEN abs({p} - floor({p}) - 0.5::DOUBLE) = 0 AND {err} < 0 THEN floor({p}) "
        f"ELSE round_even({p}, 0) END / {s})"
    )


SALES_RETURNS = f"""sr AS (
  SELECT store_name,
         {money(dec('CASE WHEN is_return THEN 0 ELSE sale END'))} AS sales_gel,
         greatest({money(dec('CASE WHEN is_return THEN credit ELSE 0 END'))}, 0) AS returns_gel
  FROM priced JOIN period USING (invoice_id) GROUP BY store_name)"""
REVENUE = f"""rev AS (
  SELECT store_name, {money(dec('revenue_gel'))} AS revenue_gel FROM period GROUP BY store_name)"""
PRODUCTS = f"""prod AS (
  SELECT store_name || ' · ' || p_name AS product_label, {dec('quantity')} AS q,
         {dec('greatest(line_total, 0)')} AS s
  FROM lines JOIN period USING (invoice_id) JOIN part ON p_partkey = product_id
  GROUP BY 1)"""
METRICS = f"""metrics AS (
  SELECT store_name, sales_gel, returns_gel,
         {arr_round('CASE WHEN sales_gel > 1e-9 THEN returns_gel / sales_gel * 100 END', 2)} AS return_rate_pct
  FROM sr)"""
SOLD = """sold AS (
  SELECT l_orderkey AS invoice_id, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS product_id,
         CASE WHEN l_linestatus <> 'O' AND l_returnflag <> 'N' THEN 'item ' || l_suppkey END AS description,
         l_quantity AS quantity, l_extendedprice AS line_total
  FROM lineitem)"""
HISTORY = f"""{SOLD}, hist AS (
  SELECT store_id, CAST(effective_date AS DATE) AS visit_date, coalesce(p_name, description, '') AS product, quantity
  FROM sold JOIN inv USING (invoice_id) LEFT JOIN part ON p_partkey = product_id
  WHERE quantity > 0 AND NOT is_return
    AND effective_date >= DATE '{AS_OF}' - INTERVAL {HISTORY_DAYS} DAY)"""
FREQ = f"""visits AS (SELECT DISTINCT store_id, visit_date FROM hist),
gaps AS (
  SELECT *, date_diff('day', lag(visit_date) OVER (PARTITION BY store_id ORDER BY visit_date), visit_date) AS gap
  FROM visits),
mean_gap AS (
  SELECT store_id, CAST(sum(gap) AS DOUBLE) / nullif(count(gap), 0) AS m, count(*) AS n_visits,
         greatest(date_diff('day', min(visit_date), max(visit_date)) + 1, 1) AS n_days
  FROM gaps GROUP BY store_id),
freq AS (
  SELECT store_id, coalesce({exact_round('m', 1)}, 2.0) AS visit_freq_days, n_visits, n_days
  FROM mean_gap)"""
RECS = f"""per_day AS (
  SELECT store_id, product, visit_date, sum(quantity) AS q FROM hist GROUP BY ALL),
per_product AS (
  SELECT store_id, product, sum(q) AS total, count(*) AS n_dates,
         round(stddev_samp(q) / (avg(q) + 0.001), 6) AS cv
  FROM per_day WHERE length(product) >= 2 GROUP BY ALL),
based AS (
  SELECT *, CASE WHEN n_visits >= 15 THEN 85 WHEN n_visits >= 8 THEN 75
                 WHEN n_visits >= 4 THEN 65 ELSE 50 END AS base,
         total / n_visits AS per_visit,
         total / n_days * visit_freq_days * 1.1::DOUBLE AS need
  FROM per_product JOIN freq USING (store_id)),
recs AS (
  SELECT store_id, product, {exact_round('per_visit', 1)} AS avg_per_visit,
         CAST(greatest(round_even(need, 0), 1) AS BIGINT) AS recommended_qty,
         CASE WHEN n_dates > 2 AND cv < 0.3 THEN least(base + 10, 90)
              WHEN n_dates > 2 AND cv > 0.7 THEN greatest(base - 15, 40)
              ELSE base END AS confidence_pct,
         n_visits, visit_freq_days
  FROM based),
banded AS (
  SELECT *, CASE WHEN confidence_pct >= 80 THEN 'high' WHEN confidence_pct >= 65 THEN 'medium'
                 ELSE 'low' END AS confidence_band,
         CASE WHEN contains(lower(product), 'შავი') OR contains(lower(product), 'რუხი')
                OR contains(lower(product), 'dark') THEN 7 ELSE 6 END AS shelf_life_days
  FROM recs)"""
