"""Registered queries for waybill and document loading, accounts and stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import ingest as I
from ..operators import stitching as ST
from ..operators.documents import extract_documents
from ..session import shared_folder, with_joins_of_dealt_sides, with_smaller_partitions
from ..sources.usage_log import read_usage_errors, read_usage_log, usage_by_user_model, usage_costs
from ..sources.waybills import bad_lines, good_lines, parse_waybills, read_waybill_records, stream_waybill_xml
from ..streaming import waybill_stream as WS
from . import sql as S
from .catalog import query
from .driver_tables import (
    SCHEMAS,
    import_lines,
    raw_invoices,
    raw_items,
    raw_products,
    raw_stores,
    stitch_tables,
    table,
    waybill_documents,
    waybill_lines,
    waybill_texts,
)

# --- waybills ------------------------------------------------------------

_WAYBILLS = """w AS (SELECT '0' || l_orderkey AS invoice_id, 'part ' || l_linenumber AS product_name,
    l_returnflag AS buyer_barcode, l_quantity AS quantity, l_extendedprice AS line_total, l_partkey AS line_no,
    l_shipdate AS synced_at FROM lineitem)"""


def _last(source: str) -> str:
    return f"""SELECT invoice_id, product_name, buyer_barcode, quantity, line_total, line_no, synced_at FROM (
      SELECT *, row_number() OVER (PARTITION BY invoice_id, product_name, buyer_barcode
        ORDER BY synced_at DESC, line_no DESC, quantity DESC, line_total DESC) AS rn FROM {source}) WHERE rn = 1"""


@query("latest_waybills", f"WITH {_WAYBILLS} {_last('w')}")
def _(spark, sf):
    return I.latest_per_key(waybill_lines(spark, sf))


@query(
    "upsert_waybills",
    f"""WITH {_WAYBILLS}, cur AS (SELECT * FROM ({_last("(SELECT * FROM w WHERE synced_at < DATE '1998-01-01')")})),
    inc AS ({_last("(SELECT * FROM w WHERE synced_at >= DATE '1997-07-01')")})
    SELECT * FROM inc UNION ALL SELECT * FROM cur ANTI JOIN inc USING (invoice_id, product_name, buyer_barcode)""",
)
def _(spark, sf):
    lines = waybill_lines(spark, sf)
    current = I.latest_per_key(lines.filter(F.col("synced_at") < F.lit("1998-01-01").cast("timestamp_ntz")))
    batch = lines.filter(F.col("synced_at") >= F.lit("1997-07-01").cast("timestamp_ntz"))
    return I.upsert_waybills(current, batch)


@query("waybill_stream", f"WITH {_WAYBILLS} {_last('w')}")
def _(spark, sf):
    """The whole lineitem table as new waybill files, loaded by the stream and read back."""
    folder = shared_folder(spark, "waybill-stream")
    source = (
        spark.readStream.schema(SCHEMAS["lineitem"])
        .option("pathGlobFilter", "lineitem.parquet")
        .parquet(sf)
        .select(
            F.concat(F.lit("0"), "l_orderkey").alias("invoice_id"),
            F.concat(F.lit("part "), "l_linenumber").alias("product_name"),
            F.col("l_returnflag").alias("buyer_barcode"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("line_total"),
            F.col("l_partkey").alias("line_no"),
            F.col("l_shipdate").alias("synced_at"),
        )
    )
    WS.waybill_stream(source, f"{folder}/log", f"{folder}/runs", f"{folder}/checkpoint").awaitTermination()
    return WS.current_waybills(WS.read_log(spark, f"{folder}/log")).drop("batch_id")


_XML = """x AS (SELECT o_orderkey, o_custkey, o_orderdate, l_partkey, l_quantity, l_extendedprice, l_orderkey IS NOT NULL AS has,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS line_no
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
w AS (SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, strftime(o_orderdate, '%Y-%m-%d') AS date, '' AS seller_name, '' AS seller_address,
    'buyer ' || o_custkey AS buyer_name, '' AS buyer_address, '' AS buyer_barcode,
    CASE WHEN has THEN 'part ' || l_partkey || CASE WHEN o_orderkey % 3 = 0 THEN ' </Product>' ELSE '' END || ' & co' ELSE '' END AS product_name,
    CASE WHEN has THEN floor(l_quantity) ELSE 0 END AS quantity,
    CASE WHEN has THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 0 END AS price,
    CAST(line_no AS INTEGER) AS line_no, has AND l_partkey % 97 = 0 AS bad FROM x)"""


@query(
    "read_waybill_xml",
    f"""WITH {_XML} SELECT w.* EXCLUDE (bad), {S.exact_round('(quantity * price)', 2)} AS line_total FROM w WHERE NOT bad""",
)
def _(spark, sf):
    return good_lines(parse_waybills(waybill_texts(spark, sf)))


@query(
    "waybill_xml_errors",
    f"WITH {_XML} SELECT invoice_id, product_name, line_no, 'many' AS bad_number FROM w WHERE bad",
)
def _(spark, sf):
    return bad_lines(parse_waybills(waybill_texts(spark, sf)))


@query(
    "waybill_xml_records",
    f"""WITH {_XML} SELECT w.* EXCLUDE (bad), {S.exact_round('(quantity * price)', 2)} AS line_total
    FROM w WHERE NOT bad AND CAST(invoice_id AS BIGINT) % 3 = 0""",
)
def _(spark, sf):
    """Files of many waybills of one layout, cut into input splits by their closing tags."""
    folder = shared_folder(spark, "waybill-records")
    waybill_texts(spark, sf).write.text(f"{folder}/in")
    return read_waybill_records(spark, f"{folder}/in", "Waybill", "s")


@query(
    "waybill_xml_stream",
    f"""WITH {_XML}, g AS (SELECT w.* EXCLUDE (bad), {S.exact_round('(quantity * price)', 2)} AS line_total,
      row_number() OVER (PARTITION BY invoice_id, product_name ORDER BY line_no DESC) AS rn FROM w WHERE NOT bad)
    SELECT * EXCLUDE (rn) FROM g WHERE rn = 1""",
)
def _(spark, sf):
    """The same waybills as files of all layouts, loaded by the stream, compacted, and read back."""
    folder = shared_folder(spark, "waybill-xml-stream")
    waybill_texts(spark, sf).write.text(f"{folder}/in")
    source = stream_waybill_xml(spark, f"{folder}/in")
    WS.waybill_stream(source, f"{folder}/log", f"{folder}/runs", f"{folder}/checkpoint").awaitTermination()
    WS.compact_log(spark, f"{folder}/log")
    return WS.current_waybills(WS.read_log(spark, f"{folder}/log")).drop("batch_id", "synced_at")


@query(
    "failed_sync_runs",
    """SELECT 1 AS run_id, 'failed' AS status, 0 AS rows_written, 0 AS waybills_count, 'no such layout' AS error_message
    UNION ALL SELECT 2, 'success', (SELECT count(*) FROM lineitem), (SELECT count(DISTINCT l_orderkey) FROM lineitem), NULL
    UNION ALL SELECT 3, 'success', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'),
      (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R'), NULL""",
)
def _(spark, sf):
    """A batch that fails for good, one that is loaded twice, and one that succeeds on retry."""
    folder = shared_folder(spark, "failed-sync")
    log, runs = f"{folder}/log", f"{folder}/runs"
    lines = waybill_lines(spark, sf)
    returned = lines.filter("buyer_barcode = 'R'")

    def broken(_batch):
        raise ValueError("no such layout")

    for batch, number, prepare in ((lines, 1, broken), (lines, 2, None), (lines, 2, None), (returned, 3, broken), (returned, 3, None)):
        try:
            (WS.sync_batch(log, runs, prepare) if prepare else WS.sync_batch(log, runs))(batch, number)
        except ValueError:
            continue
    return WS.read_sync_runs(spark, runs).select("run_id", "status", "rows_written", "waybills_count", "error_message")


@query(
    "sync_run_counts",
    """SELECT event_type AS run, count(*) AS rows_written, count(DISTINCT user_id) AS waybills_count
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    batch = table(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.col("user_id").alias("invoice_id")
    )
    return I.batch_counts(batch, ["run"])


@query(
    "latest_sync_runs",
    """WITH r AS (SELECT user_id AS run_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id
        ORDER BY event_type = 'error' DESC, CASE WHEN event_type = 'error' THEN ts END DESC, ts DESC) AS rn FROM events)
    SELECT run_id, ts AS started_at, CASE WHEN event_type = 'error' THEN ts END AS finished_at,
      CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status, value FROM r WHERE rn = 1""",
)
def _(spark, sf):
    failed = F.col("event_type") == "error"
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("ts").alias("started_at"),
        F.when(failed, F.col("ts")).alias("finished_at"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("running")).alias("status"),
        "value",
    )
    return I.latest_sync_runs(runs)


# --- import --------------------------------------------------------------

def _import(spark, sf):
    """Import all lines into tables that already know some stores and invoices."""
    spark = with_smaller_partitions(spark)
    known_stores = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    known_invoices = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"),
        F.format_string("%010d", "o_orderkey").alias("invoice_number"),
    )
    known_items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    work = shared_folder(spark, "import")
    return I.import_waybills(import_lines(spark, sf), known_stores, known_invoices, known_items, work)


_IMPORT = f"""WITH l AS (SELECT printf('%010d', o_orderkey) AS num, o_orderkey, o_orderstatus, o_orderdate, c_name, c_custkey, c_mktsegment,
    c_nationkey, l_partkey, l_linenumber, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
ns AS (SELECT c_name AS name, 'ქუჩა ' || min(c_nationkey) AS address FROM l WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
stores_new AS (SELECT (SELECT max(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')
    + row_number() OVER (ORDER BY left(md5(name), 5), name) AS id, name, address FROM ns),
ids AS (SELECT id, name FROM stores_new UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'),
ni AS (SELECT num, c_name, min(o_orderdate) AS d, CAST({S.dec('l_extendedprice')} AS DOUBLE) AS total FROM l WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
inv_new AS (SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')
    + row_number() OVER (ORDER BY left(md5(num), 5), num) AS id, ids.id AS store_id, num AS invoice_number,
    strftime(d, '%Y-%m-%dT%H:%M:%S') AS invoice_date, total, total AS subtotal, 'rs_ge_sync' AS source_file
  FROM ni JOIN ids ON ids.name = ni.c_name)"""


@query("import_stores", f"{_IMPORT} SELECT * FROM stores_new")
def _(spark, sf):
    return _import(spark, sf).stores


@query("import_invoices", f"{_IMPORT} SELECT * FROM inv_new")
def _(spark, sf):
    return _import(spark, sf).invoices


@query(
    "import_items",
    f"""{_IMPORT}, it AS (SELECT i.id AS invoice_id, 'part ' || l_partkey AS description, l_quantity AS quantity,
        l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total, l_linenumber
      FROM l JOIN inv_new i ON i.invoice_number = l.num),
    n AS (SELECT *, row_number() OVER (ORDER BY invoice_id // 4096, l_linenumber // 4096, invoice_id, l_linenumber,
      description, quantity, unit_price) AS rn FROM it)
    SELECT (SELECT max(l_orderkey) FROM lineitem) + rn AS id, invoice_id, description, quantity, unit_price, line_total FROM n""",
)
def _(spark, sf):
    return _import(spark, sf).items


@query(
    "import_counts",
    f"""{_IMPORT} SELECT (SELECT count(*) FROM inv_new) AS invoices,
      (SELECT count(*) FROM l WHERE o_orderstatus <> 'F') AS items, (SELECT count(*) FROM stores_new) AS stores_created""",
)
def _(spark, sf):
    return I.loaded_counts(_import(spark, sf))


# --- documents into tables -----------------------------------------------

_DOCS = """src AS (SELECT doc_id, text, lang, source, n_chars, n_chars % 28 + 1 AS d, doc_id % 12 + 1 AS m FROM documents),
head AS (SELECT doc_id,
  CASE lang WHEN 'en' THEN printf('%010d', doc_id) WHEN 'de' THEN printf('%010d', doc_id)
            WHEN 'fr' THEN 'W-' || printf('%010d', doc_id) END AS waybill_number,
  CASE lang WHEN 'de' THEN d || '.' || m || '.2026' ELSE '2026-' || printf('%02d', m) || '-' || printf('%02d', d) END AS invoice_date,
  printf('%02d:%02d:00', n_chars % 24, doc_id % 60) AS invoice_time,
  'შპს მაღაზია ' || source AS store_name,
  'ქუთაისი, გამზირი ' || d || ' #' || doc_id AS origin_address,
  'თბილისი, ქუჩა ' || source || ' #' || n_chars || ' სასაქონლო ზედნადების ცხრილი' AS buyer_address,
  lang, source FROM src),
x AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM src),
y AS (SELECT *, length(x) % 97 + 1 AS qty, i % 50 + 1 AS price FROM x),
z AS (SELECT *, CASE WHEN lang IN ('en', 'fr')
    THEN trim(regexp_replace((i + 1) || ' ' || x || ' ' || printf('%013d', doc_id * 1000 + i) || ' ცალი ' || qty || '.00 ' || price || '.25 ' || (qty * price) || '.00', '\\s+', ' ', 'g'))
    ELSE trim(x || ' ' || qty || ' ' || price || ',5') END AS line FROM y),
b AS (SELECT *, trim(regexp_replace(trim(regexp_extract(line, '(.+?)\\s+(\\d{13})\\s+(.+)$', 1)), '^#?\\s*\\d{1,3}\\s+', '')) AS bname,
    regexp_extract_all(regexp_replace(regexp_extract(line, '(.+?)\\s+(\\d{13})\\s+(.+)$', 3), '^ცალი\\s+', ''), '\\d+\\.\\d{2,4}') AS decs,
    trim(regexp_extract(line, '^(.+?)\\s+(\\d+(?:[.,]\\d+)?)\\s+(\\d+(?:[.,]\\d+)?)\\s*$', 1)) AS pname FROM z),
found AS (
  SELECT doc_id, i, bname AS name, decs[1] AS quantity, coalesce(decs[2], '') AS price FROM b
  WHERE lang IN ('en', 'fr') AND length(line) >= 25 AND length(bname) >= 2 AND len(decs) > 0
    AND NOT regexp_matches(lower(bname), 'საქონლის დასახელება|დასახელება|სახელი|ნივთი|პროდუქტ|name|product|item')
    AND lower(bname) NOT IN ('სულ', 'total', '#')
  UNION ALL
  SELECT doc_id, i, pname, qty || '', price || '.5' FROM b
  WHERE lang NOT IN ('en', 'fr') AND length(line) >= 5 AND pname <> ''
    AND NOT regexp_matches(lower(pname), 'საქონლის დასახელება|დასახელება|სახელი|ნივთი|პროდუქტ|name|product|item')
    AND lower(pname) NOT IN ('სულ', 'total')),
items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no, name, quantity, price FROM found)"""


def _ingest(spark, sf):
    """Load all waybill documents into tables that know some of their numbers."""
    docs = extract_documents(waybill_documents(spark, sf)).join(
        table(spark, sf, "documents").select("doc_id", "source"), "doc_id"
    ).withColumn("store_id", F.substring("source", 4, 10).cast("long"))
    docs = docs.withColumn("invoice_number_raw", F.col("waybill_number"))
    known = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 20).alias("store_id"),
        F.format_string("%010d", "o_orderkey").alias("invoice_number"),
    )
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    work = shared_folder(spark, "ingest")
    return I.ingest_documents(docs, known, items, raw_products(spark, sf), work=work)


_INGEST = f"""WITH {_DOCS},
num AS (SELECT h.*, coalesce(waybill_number, 'invoice_' || doc_id) AS invoice_number,
    CAST(substr(source, 4) AS BIGINT) AS store_id FROM head h),
fresh AS (SELECT * FROM num WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F'
    AND o_orderkey % 20 = store_id AND printf('%010d', o_orderkey) = invoice_number)),
priced AS (SELECT doc_id, line_no, name, CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(nullif(price, '') AS DOUBLE) AS unit_price,
    {S.exact_round('(CAST(quantity AS DOUBLE) * TRY_CAST(nullif(price, %s) AS DOUBLE))' % "''", 4)} AS line_total FROM items),
inv_new AS (SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F') + row_number() OVER (ORDER BY doc_id) AS id,
    fresh.*, (SELECT CAST({S.dec('line_total')} AS DOUBLE) FROM priced p WHERE p.doc_id = fresh.doc_id) AS subtotal FROM fresh),
mine AS (SELECT p.*, i.id AS invoice_id FROM priced p JOIN inv_new i USING (doc_id)),
names AS (SELECT trim(name) AS name, min((doc_id, line_no, unit_price)) AS f FROM mine WHERE trim(name) <> ''
    AND trim(name) NOT IN (SELECT p_name FROM part) GROUP BY 1),
prod_new AS (SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY f[1], f[2], name) AS id, name,
    'ცალი' AS unit, f[3] AS default_unit_price FROM names)"""


@query(
    "ingest_invoices",
    f"""{_INGEST} SELECT id, doc_id, invoice_number, store_id, invoice_date, subtotal, subtotal AS total, 'GEL' AS currency,
      '/in/invoice_' || doc_id || '.pdf' AS source_file, 'time=' || invoice_time AS notes FROM inv_new""",
)
def _(spark, sf):
    return _ingest(spark, sf).invoices.drop("raw_text")


@query("ingest_products", f"{_INGEST} SELECT * FROM prod_new")
def _(spark, sf):
    return _ingest(spark, sf).products


@query(
    "ingest_items",
    f"""{_INGEST}, known AS (SELECT name, id FROM prod_new UNION ALL SELECT p_name, min(p_partkey) FROM part GROUP BY 1)
    SELECT (SELECT max(l_orderkey) FROM lineitem) + row_number() OVER (ORDER BY invoice_id // 4096, line_no // 4096, invoice_id, line_no) AS id,
      invoice_id, k.id AS product_id, CAST(line_no AS INTEGER) AS line_no, m.name AS description, quantity, unit_price, line_total
    FROM mine m LEFT JOIN known k ON k.name = trim(m.name)""",
)
def _(spark, sf):
    return _ingest(spark, sf).items


# --- accounts ------------------------------------------------------------

#: Pairs of one partition: about what a task can keep in memory to tell repeated ones.
PAIRS_A_PART = 1_000_000


def _pair_parts(spark, sf):
    """How many partitions the pairs need, by their number: it grows with the square of the tables."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    pairs = c.join(s, F.col("c_nationkey") == F.col("s_nationkey")).agg(F.sum(F.col("c") * F.col("s"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_A_PART))


def _pairs(spark, sf, parts):
    """(user, store) pairs: a supplier serves the customers of its nation.

    Customers are dealt over the partitions before they become many pairs, each of which stays
    in its customer's. Suppliers are broadcast: where pairs can be listed at all, they are few.
    """
    c, s = table(spark, sf, "customer").repartition(parts, "c_custkey"), table(spark, sf, "supplier")
    return c.join(F.broadcast(s), F.col("c_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("user_id"), F.col("c_custkey").alias("store_id")
    )


_PAIRS = "pairs AS (SELECT s_suppkey AS user_id, c_custkey AS store_id FROM customer JOIN supplier ON s_nationkey = c_nationkey)"


@query(
    "assign_stores",
    f"""WITH {_PAIRS} SELECT user_id, store_id FROM pairs WHERE user_id <> 7
    UNION SELECT l_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION SELECT 7, 3 UNION SELECT 7, 5""",
)
def _(spark, sf):
    sold = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("l_suppkey").alias("user_id"), F.col("o_custkey").alias("store_id"))
    parts = _pair_parts(spark, sf)
    return A.replace_user_stores(_pairs(spark, sf, parts), 7, [3, 5, 5], also=sold, parts=parts)


@query(
    "remove_pairs",
    f"""WITH {_PAIRS} SELECT * FROM pairs WHERE user_id <> 9 AND (user_id, store_id) NOT IN (
      SELECT l_suppkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
)
def _(spark, sf):
    spark = with_joins_of_dealt_sides(spark)
    sold = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(F.col("l_suppkey").alias("user_id"), F.col("o_custkey").alias("store_id"))
    parts = _pair_parts(spark, sf)
    return A.remove_pairs(A.remove_user(_pairs(spark, sf, parts), 9), sold, parts)


@query("default_assignment", "SELECT 4::BIGINT AS user_id, c_custkey AS store_id FROM customer ORDER BY c_custkey LIMIT 8")
def _(spark, sf):
    return A.default_assignment(raw_stores(spark, sf), 4)


def _migrate(spark, sf):
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("username"),
        F.col("c_mktsegment").alias("role"),
    )
    taken = table(spark, sf, "supplier").select(
        F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("username")
    )
    pairs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("store_id")
    )
    return A.load_new_users(users, pairs, taken)


_TAKEN = "lower(c_name) IN (SELECT lower(replace(s_name, 'Supplier', 'Customer')) FROM supplier)"


@query("load_new_users", f"SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role FROM customer WHERE NOT {_TAKEN}")
def _(spark, sf):
    return _migrate(spark, sf).users


@query(
    "load_new_user_stores",
    f"SELECT o_custkey AS user_id, o_orderkey AS store_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT {_TAKEN}",
)
def _(spark, sf):
    return _migrate(spark, sf).user_stores


@query(
    "load_new_users_counts",
    f"SELECT count(*) FILTER (NOT {_TAKEN}) AS migrated, count(*) FILTER ({_TAKEN}) AS skipped FROM customer",
)
def _(spark, sf):
    return _migrate(spark, sf).counts


def _purged(spark, sf):
    stores = raw_stores(spark, sf).select("id", F.substring("name", 1, 17).alias("name"))
    return A.purge_unknown(stores, raw_invoices(spark, sf), raw_items(spark, sf), "Customer 00000000")


_GONE = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_name LIKE 'Customer#00000000_')"


@query("purge_source_files", f"SELECT DISTINCT 'file_' || o_orderkey || '.pdf' AS source_file FROM orders WHERE {_GONE}")
def _(spark, sf):
    return _purged(spark, sf).source_files


@query("purge_invoices", f"SELECT o_orderkey AS id, o_custkey AS store_id FROM orders WHERE NOT {_GONE}")
def _(spark, sf):
    return _purged(spark, sf).invoices.select("id", "store_id")


@query(
    "purge_items",
    f"""SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, l_extendedprice AS line_total FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_GONE})""",
)
def _(spark, sf):
    return _purged(spark, sf).items.select("invoice_id", "line_no", "line_total")


def _usage(spark, sf):
    """Events as the assistant's usage log; the JSON property is the cached token count."""
    cached = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        F.col("ts").cast("string").alias("ts"),
        "user_id",
        F.col("event_type").alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.when(F.col("event_type") != "error", cached).alias("output_tokens"),
        (cached * 1000).alias("cache_creation_input_tokens"),
        "event_id",
    )


_USAGE = f"""WITH u AS (SELECT event_id, user_id, event_type AS model, CAST(floor(value * 100) AS BIGINT) AS i,
    CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS BIGINT) END AS o, CAST(props->>'$.k' AS BIGINT) * 1000 AS c FROM events),
costs AS (SELECT event_id, user_id, model, i + coalesce(o, 0) AS tokens_used,
    {S.exact_round('(CAST(c AS DOUBLE) * 1.0::DOUBLE / 1000000::DOUBLE)', 6)} AS cost FROM u)"""


@query("usage_costs", f"{_USAGE} SELECT event_id, user_id, model, tokens_used, cost AS cache_creation_cost_usd_est FROM costs")
def _(spark, sf):
    return usage_costs(_usage(spark, sf)).select(
        "event_id", "user_id", "model", "tokens_used", "cache_creation_cost_usd_est"
    )


@query(
    "usage_by_user_model",
    f"""{_USAGE} SELECT user_id, model, count(*) AS n_calls, CAST(sum(tokens_used) AS BIGINT) AS tokens_used,
      CAST(sum(CAST(cost AS DECIMAL(18,6))) AS DOUBLE) AS cost_usd FROM costs GROUP BY 1, 2""",
)
def _(spark, sf):
    return usage_by_user_model(_usage(spark, sf))


def _usage_lines(spark, sf):
    """The usage log as a folder of JSON lines, every fiftieth of them cut short."""
    usage = _usage(spark, sf).select(
        "ts", "user_id", F.concat(F.lit("s"), "event_id").alias("session_id"), "model",
        "input_tokens", "output_tokens", "cache_creation_input_tokens",
    )
    record = F.to_json(F.struct(*usage.columns))
    broken = F.substring("session_id", 2, 20).cast("long") % 50 == 0
    folder = f"{shared_folder(spark, 'usage-log')}/in"
    usage.select(F.when(broken, F.substring(record, F.lit(1), F.length(record) - 9)).otherwise(record)).write.text(folder)
    return folder


@query(
    "usage_log_lines",
    f"""{_USAGE} SELECT 's' || u.event_id AS session_id, u.user_id, u.model, u.i AS input_tokens, u.o AS output_tokens,
      u.c AS cache_creation_input_tokens, u.i + coalesce(u.o, 0) AS tokens_used,
      c.cost AS cache_creation_cost_usd_est FROM u JOIN costs c USING (event_id) WHERE event_id % 50 <> 0""",
)
def _(spark, sf):
    columns = [
        "session_id", "user_id", "model", "input_tokens", "output_tokens", "cache_creation_input_tokens",
        "tokens_used", "cache_creation_cost_usd_est",
    ]
    return usage_costs(read_usage_log(spark, _usage_lines(spark, sf))).select(*columns)


@query(
    "usage_log_errors",
    f"""{_USAGE} SELECT left(l, length(l) - 9) AS line FROM (SELECT '{{"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S')
        || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END
        || '","user_id":' || user_id || ',"session_id":"s' || event_id || '","model":"' || event_type || '","input_tokens":'
        || CAST(floor(value * 100) AS BIGINT)
        || CASE WHEN event_type <> 'error' THEN ',"output_tokens":' || (props->>'$.k') ELSE '' END
        || ',"cache_creation_input_tokens":' || CAST(props->>'$.k' AS BIGINT) * 1000 || '}}' AS l
      FROM events WHERE event_id % 50 = 0)""",
)
def _(spark, sf):
    return read_usage_errors(spark, _usage_lines(spark, sf))


# --- stitching -----------------------------------------------------------

_STITCH = f"""WITH o AS (SELECT *, o_orderstatus = 'O' AS apx, o_orderpriority AS y FROM orders),
known AS (SELECT o_custkey, min(o_orderkey) AS parent FROM o WHERE NOT apx GROUP BY 1),
links AS (SELECT o_orderkey AS appendix_id, parent AS parent_id FROM o JOIN known USING (o_custkey) WHERE apx AND y < '5'),
its AS (SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey AS invoice_id,
    CASE WHEN l_linenumber < 6 THEN l_linenumber END AS line_no, sum(l_quantity) AS quantity,
    CAST({S.dec('l_extendedprice')} AS DOUBLE) AS line_total FROM lineitem GROUP BY l_orderkey, l_linenumber),
last AS (SELECT invoice_id AS parent_id, max(coalesce(line_no, 0)) AS m FROM its GROUP BY 1),
moved AS (SELECT id, l.parent_id AS invoice_id, CAST(coalesce(m, 0) + row_number() OVER (
    PARTITION BY l.parent_id ORDER BY appendix_id, coalesce(line_no, 999999), id) AS INTEGER) AS line_no, quantity, line_total
  FROM its JOIN links l ON l.appendix_id = its.invoice_id LEFT JOIN last ON last.parent_id = l.parent_id),
all_items AS (SELECT * FROM moved UNION ALL SELECT * FROM its WHERE invoice_id NOT IN (SELECT appendix_id FROM links)),
sums AS (SELECT invoice_id, CAST({S.dec('line_total')} AS DOUBLE) AS total FROM all_items GROUP BY 1),
parts AS (SELECT parent_id, appendix_id, concat_ws(' | ',
    CASE WHEN y < '2' THEN 'merged appendix source_file=''f' || appendix_id || '.pdf''' END,
    CASE WHEN y < '3' THEN 'appendix notes: note ' || appendix_id END) AS part
  FROM links JOIN o ON o_orderkey = appendix_id WHERE y < '3'),
extra AS (SELECT parent_id, string_agg(part, ' | ' ORDER BY appendix_id) AS extra FROM parts GROUP BY 1),
inv_after AS (SELECT o_orderkey AS id, CASE WHEN apx THEN (SELECT max(c_custkey) + 1 FROM customer) ELSE o_custkey END AS store_id,
    CASE WHEN o_orderkey IN (SELECT parent_id FROM links) THEN s.total ELSE o_totalprice END AS total,
    nullif(concat_ws(' | ', CASE WHEN y < '3' THEN 'note ' || o_orderkey END, extra), '') AS notes
  FROM o LEFT JOIN sums s ON s.invoice_id = o_orderkey LEFT JOIN extra e ON e.parent_id = o_orderkey
  WHERE o_orderkey NOT IN (SELECT appendix_id FROM links))"""


def _stitched(spark, sf):
    return ST.stitch_appendices(*stitch_tables(spark, sf), work=shared_folder(spark, "stitch"))


@query("stitch_links", f"{_STITCH} SELECT * FROM links")
def _(spark, sf):
    return _stitched(spark, sf).links


@query("stitch_items", f"{_STITCH} SELECT * FROM all_items")
def _(spark, sf):
    return _stitched(spark, sf).items


@query("stitch_invoices", f"{_STITCH} SELECT * FROM inv_after")
def _(spark, sf):
    return _stitched(spark, sf).invoices.select("id", "store_id", "total", "notes")


@query(
    "stitch_summary",
    f"""{_STITCH} SELECT (SELECT count(*) FROM o WHERE apx) AS seen, (SELECT count(*) FROM links) AS stitched,
      (SELECT count(*) FROM o WHERE apx) - (SELECT count(*) FROM links) AS skipped, 0::BIGINT AS orphan_stores_deleted,
      (SELECT count(*) FROM o WHERE apx) - (SELECT count(*) FROM links) AS remaining_unknown""",
)
def _(spark, sf):
    return _stitched(spark, sf).summary


@query(
    "skipped_appendices",
    f"""{_STITCH} SELECT o_orderkey AS id, CASE WHEN y < '3' THEN printf('%010d/%d', o_custkey, o_orderkey)
        WHEN y < '5' THEN 'invoice_' || o_orderkey ELSE 'A' || o_orderkey END AS invoice_number,
      CASE WHEN y < '3' THEN printf('%010d, %010d/%d', o_custkey, o_custkey, o_orderkey) WHEN y < '5' THEN printf('%010d', o_custkey)
        WHEN length('A' || o_orderkey) >= 6 THEN 'A' || o_orderkey ELSE '' END AS keys
    FROM o WHERE apx AND o_orderkey NOT IN (SELECT appendix_id FROM links)""",
)
def _(spark, sf):
    stores, invoices, _items = stitch_tables(spark, sf)
    return ST.skipped_appendices(invoices, stores, _stitched(spark, sf).links)


@query(
    "recompute_totals",
    f"""SELECT o_orderkey AS id, CAST({S.dec('l_extendedprice')} AS DOUBLE) AS subtotal,
      CAST({S.dec('l_extendedprice')} AS DOUBLE) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, sf):
    _stores, invoices, items = stitch_tables(spark, sf)
    return ST.recompute_totals(invoices, items).select("id", "subtotal", "total")


@query(
    "store_invoice_counts",
    """SELECT c_custkey AS id, CASE c_mktsegment WHEN 'FURNITURE' THEN c_name ELSE replace(c_name, '#', ' ') END AS name,
      count(o_orderkey) AS n_invoices FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def _(spark, sf):
    return ST.store_invoice_counts(raw_stores(spark, sf), raw_invoices(spark, sf))
