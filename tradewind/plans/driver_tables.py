"""The benchmark tables in the shape of the stored tables.

Invoice = order, line = lineitem, store = customer, product = part. Two mappings:
``star`` reads the facts as already enriched (typed dates and flags), as a loaded
warehouse would hold them; the ``raw_*`` frames are free-text source tables for the
loading and cleaning operators. Both cover whole tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Star

START, END = date(1996, 1, 1), date(1998, 12, 31)
AS_OF = date(2001, 8, 1)
HISTORY_DAYS = 730


# Known schemas: no footer is read before the query runs.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def signed_lines(lineitem: DataFrame) -> DataFrame:
    """Lines with the signs of real data: returned goods and credited amounts."""
    returned = F.col("l_returnflag") == "R"
    credited = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")
    price = F.col("l_extendedprice")
    return lineitem.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_partkey").alias("product_id"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        (price / F.col("l_quantity")).alias("unit_price"),
        F.when(returned, 0.0).when(credited, -price).otherwise(price).alias("line_total"),
    )


def star(spark: SparkSession, sf_dir: str) -> Star:
    orders = table(spark, sf_dir, "orders")
    return Star(
        invoices=orders.select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("store_id"),
            F.col("o_orderdate").alias("effective_date"),
            F.col("o_totalprice").alias("revenue_gel"),
            (F.col("o_orderstatus") == "P").alias("parent_invoice_is_return"),
        ),
        lines=signed_lines(table(spark, sf_dir, "lineitem")),
        stores=table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("store_id"),
            F.concat("c_name", F.lit(" (#"), "c_custkey", F.lit(")")).alias("store_display_name"),
        ),
        products=table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name")
        ),
    )


def order_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(invoices, lines) for order planning: half of the lines have no product id, some a description."""
    invoices = star(spark, sf_dir).invoices.withColumnRenamed("parent_invoice_is_return", "is_return")
    lines = raw_items(spark, sf_dir).select("invoice_id", "product_id", "description", "quantity", "line_total")
    return invoices, lines


# --- raw tables ----------------------------------------------------------

def raw_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores whose address form, and branch code in the name, depend on the market segment."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    segment = F.col("c_mktsegment")
    address = (
        F.when(segment == "BUILDING", F.concat(F.lit("თბილისი,თ.ერისთავის 1, ქუჩა "), nation, F.lit(" #"), key))
        .when(segment == "MACHINERY", F.concat(F.lit("  ბათუმი, ქუჩა "), nation))
        .when(segment == "HOUSEHOLD", F.lit(None).cast("string"))
        .when(segment == "FURNITURE", F.lit("თბილისი, თ.ერისთავის_1"))
        .otherwise(F.concat(F.lit("ქუთაისი #"), nation, F.lit("\u00a0＃ "), key))
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(segment == "FURNITURE", F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("name"),
        address.alias("address"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )


def _free_date(ts: Column, style: Column) -> Column:
    """Free-text dates in the styles of scanned documents."""
    return (
        F.when(style == "1-URGENT", F.date_format(ts, "yyyy-MM-dd"))
        .when(style == "2-HIGH", F.date_format(ts, "d/M/yyyy"))
        .when(style == "3-MEDIUM", F.concat(F.lit(" "), F.date_format(ts, "dd.MM.yyyy")))
        .when(style == "4-NOT SPECIFIED", F.lit("  "))
        .otherwise(F.concat(F.date_format(ts, "dd/MM/yyyy"), F.lit(", გვ. 1")))
    )


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with free-text dates; status and priority decide how a return shows."""
    key, status, style = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    returned = status == "P"
    number = F.when(returned & (style < "3"), F.concat(F.lit("CR-"), key)).otherwise(
        F.concat(F.lit("CRATE-"), key)
    )
    notes = F.when(returned & (style >= "3") & (style < "5"), F.lit("time=10:00:00 | უკან  დაბრუნება")).when(
        status == "F", F.lit(None).cast("string")
    ).otherwise(F.lit("Creditors"))
    raw = F.when(returned & (style >= "5"), F.concat(F.lit("ტიპი: კორექტირება "), key)).otherwise(
        F.concat(F.lit("ტიპი: მიწოდება "), key)
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        number.alias("invoice_number"),
        F.col("o_custkey").alias("store_id"),
        _free_date(F.col("o_orderdate"), style).alias("invoice_date"),
        F.when(status == "O", F.col("o_totalprice")).alias("subtotal"),
        F.when(status != "O", F.col("o_totalprice")).alias("total"),
        F.concat(F.lit("file_"), key, F.lit(".pdf")).alias("source_file"),
        raw.alias("raw_text"),
        notes.alias("notes"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'10:11:12'Z'").alias("created_at"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a useful id of their own; some have no product."""
    known = F.col("l_linestatus") == "O"
    return table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("id"),
        F.col("l_orderkey").alias("invoice_id"),
        F.when(known, F.col("l_partkey")).alias("product_id"),
        F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("item "), F.col("l_suppkey"))).alias("description"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("line_total"),
    )


def waybill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered waybill lines: keys repeat, the latest ship date is the latest sync."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("0"), F.col("l_orderkey")).alias("invoice_id"),
        F.concat(F.lit("part "), F.col("l_linenumber")).alias("product_name"),
        F.col("l_returnflag").alias("buyer_barcode"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("line_total"),
        F.col("l_partkey").alias("line_no"),
        F.col("l_shipdate").alias("synced_at"),
    )


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waybill lines with their header, for the import into stores, invoices and items."""
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.format_string("%010d", "o_orderkey").alias("invoice_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.col("c_name").alias("buyer_name"),
        F.concat(F.lit("ქუჩა "), F.col("c_nationkey")).alias("buyer_address"),
        F.col("c_mktsegment").alias("buyer_barcode"),
        F.concat(F.lit("part "), F.col("l_partkey")).alias("product_name"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("line_total"),
        F.col("l_linenumber").alias("line_no"),
    )


def waybill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML text per order, in three layouts; some lines have a quantity that is no number.

    The first layout nests containers of one name, and the names of its products are CDATA
    that holds a closing tag.
    """
    known = F.col("l_partkey") % 97 != 0
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("place"),
        F.concat(
            F.lit("<name>"),
            F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("<![CDATA[part "), "l_partkey", F.lit(" </Product> & co]]>")))
            .otherwise(F.concat(F.lit("part "), "l_partkey", F.lit(" &amp; co"))),
            F.lit("</name><quantity>"),
            F.when(known, F.col("l_quantity").cast("long").cast("string")).otherwise(F.lit("many")),
            F.lit("</quantity><price>"), F.format_string("%.2f", "l_extendedprice"), F.lit("</price>"),
        ).alias("fields"),
    )
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    grouped = joined.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(
        F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "fields")))).alias("products")
    )
    layout, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")

    def elements(tag: str, start: int = 1, size: Column | None = None) -> Column:
        part = F.slice("products", start, F.size("products") if size is None else size)
        each = F.transform(part, lambda p: F.concat(F.lit(f"<{tag}>"), p.fields, F.lit(f"</{tag}>")))
        return F.array_join(each, "")

    head = F.concat(F.lit("<buyer_name>buyer "), "o_custkey", F.lit("</buyer_name><date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</date>"))
    text = (
        F.when(
            layout == 0,
            F.concat(
                F.lit("<s:Waybill xmlns:s='u'><s:WaybillNumber>"), key, F.lit("</s:WaybillNumber>"), head,
                F.lit("<Products/><More><Products><Products>"), elements("Product", 2),
                F.lit("</Products>"), elements("Product", 1, F.lit(1)), F.lit("</Products></More></s:Waybill>"),
            ),
        )
        .when(layout == 1, F.concat(F.lit("<invoice><invoice_id>"), key, F.lit("</invoice_id>"), head, F.lit("<products>"), elements("product"), F.lit("</products></invoice>")))
        .otherwise(F.concat(F.lit("<Invoice>"), head, elements("Product"), F.lit("<InvoiceId>"), key, F.lit("</InvoiceId></Invoice>")))
    )
    return grouped.select(F.concat(F.lit("<r>"), text, F.lit("</r>")).alias("value"))


# --- documents -----------------------------------------------------------

def waybill_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A waybill page per document: its lines become items under a waybill header.

    The language decides the form of the number, the address and the item lines.
    """
    key = F.format_string("%010d", "doc_id")
    lang, source = F.col("lang"), F.col("source")
    number = (
        F.when(lang == "en", F.concat(F.lit("სასაქონლო ზედნადები\nელ- "), key))
        .when(lang == "de", F.concat(key, F.lit(" სასაქონლო ზედნადებ\nდანართი")))
        .when(lang == "fr", F.concat(F.lit("Waybill: W-"), key))
        .otherwise(F.lit("ფორმა"))
    )
    day, month = F.col("n_chars") % 28 + 1, F.col("doc_id") % 12 + 1
    dated = F.when(
        lang == "de", F.concat(F.lit("თარიღი (დღე): "), day, F.lit("."), month, F.lit(".2026"))
    ).otherwise(F.format_string("2026-%02d-%02d", month, day))
    timed = F.format_string("დრო: %02d:%02d:00", F.col("n_chars") % 24, F.col("doc_id") % 60)
    seller = F.when(lang == "fr", F.lit("შპს ელთი დისტრიბუცია 200249043 ")).otherwise(F.lit(""))
    buyer = F.concat(seller, F.lit("შპს მაღაზია "), source)
    origin = F.concat(F.lit("ქუთაისი, გამზირი "), day, F.lit(" #"), F.col("doc_id"))
    operation = F.when(lang == "es", F.lit("უკან დაბრუნება")).otherwise(F.lit("მიწოდება"))
    destination = F.concat(F.lit("თბილისი, ქუჩა "), source, F.lit(" #"), F.col("n_chars"))
    bundled = lang.isin("en", "fr")

    def item(x: Column, i: Column) -> Column:
        qty, price = F.pmod(F.length(x), F.lit(97)) + 1, F.pmod(i, F.lit(50)) + 1
        code = F.format_string("%013d", F.col("doc_id") * 1000 + i)
        packed = F.concat(
            (i + 1).cast("string"), F.lit(" "), x, F.lit(" "), code, F.lit(" ცალი "), qty, F.lit(".00 "),
            price, F.lit(".25 "), qty * price, F.lit(".00"),
        )
        plain = F.concat(x, F.lit(" "), qty, F.lit(" "), price, F.lit(",5"))
        return F.when(bundled, packed).otherwise(plain)

    items = F.array_join(F.transform(F.split("text", "\n"), item), "\n")
    text = F.concat_ws(
        "\n",
        number,
        F.concat_ws(" ", dated, timed),
        buyer,
        F.lit("მყიდველის (მიმღების) დასახელება"),
        F.lit("საიდენტიფიკაციო / პირადი ნომერი"),
        F.lit("400111222"),
        F.concat(origin, F.lit(" ტრანსპორტირების დაწყების ადგილი")),
        operation,
        F.concat(F.lit("ტრანსპორტირების დასრულების ადგილი: "), destination),
        F.lit("სასაქონლო ზედნადების ცხრილი"),
        items,
    )
    # Extraction costs far more than the shuffle that deals the documents to all cores.
    return table(spark, sf_dir, "documents").repartition("doc_id").select(
        "doc_id", F.concat(F.lit("/in/invoice_"), F.col("doc_id"), F.lit(".pdf")).alias("file"), text.alias("text")
    )


# --- stitching -----------------------------------------------------------

def stitch_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stores, invoices, items) where open orders are appendices of an unknown buyer.

    The waybill number is the customer and clerk-independent part of the order: all
    orders of one customer share it, appendices write it with a page suffix or
    only in their text.
    """
    customers = table(spark, sf_dir, "customer")
    stores = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(
        customers.agg((F.max("c_custkey") + 1).alias("id"), F.lit("(უცნობი მყიდველი)").alias("name"))
    )
    unknown_id = customers.agg(F.max("c_custkey") + 1).scalar()
    appendix, style = F.col("o_orderstatus") == "O", F.col("o_orderpriority")
    waybill = F.format_string("%010d", "o_custkey")
    number = (
        F.when(appendix & (style < "3"), F.concat(waybill, F.lit("/"), F.col("o_orderkey")))
        .when(appendix & (style < "5"), F.concat(F.lit("invoice_"), F.col("o_orderkey")))
        .when(appendix, F.concat(F.lit("A"), F.col("o_orderkey")))
        .otherwise(waybill)
    )
    raw = F.when(appendix & (style >= "3") & (style < "5"), F.concat(waybill, F.lit(" სასაქონლო ზედნადების დანართი")))
    invoices = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        number.alias("invoice_number"),
        F.when(appendix, unknown_id).otherwise(F.col("o_custkey")).alias("store_id"),
        F.col("o_totalprice").alias("subtotal"),
        F.col("o_totalprice").alias("total"),
        F.when(appendix & (style < "2"), F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".pdf"))).alias("source_file"),
        raw.alias("raw_text"),
        F.when(style < "3", F.concat(F.lit("note "), F.col("o_orderkey"))).alias("notes"),
    )
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("line_total"),
        F.sum("l_quantity").alias("quantity"),
    ).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("invoice_id"),
        F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("line_no"),
        "quantity",
        "line_total",
    )
    return stores, invoices, items


def scattered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A waybill page per document in one of six layouts, none with its fields at the usual place.

    Between them the layouts need every fallback for names and addresses: names around or far
    above their label or without one, addresses above, below or across broken captions, under
    an id label, or anywhere. The document's whole text stands below the item caption.
    """
    key, n, source = F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.col("source")
    label = F.lit("მყიდველის (მიმღების) დასახელება")
    done, start = F.lit("ტრანსპორტირების დასრულების ადგილი"), F.lit("ტრანსპორტირების დაწყების ადგილი")
    seller = F.lit("შპს ელთი დისტრიბუცია")

    def say(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    # A caption's value runs on over the next line.
    flat = say("ბინა ", key)
    pages = (
        (
            label, F.lit("სახელი"), say("შპს მაღაზია ", source), say("ბათუმი #", key), F.lit("111"), start,
            say("გორი, ქუჩა ", n), F.lit("12345678"), done, F.lit("შემდეგი"),
        ),
        (
            F.lit("სათაური"), seller, say("შპს სმარტ ", source), say("სენაკი, ქუჩა ", key), start,
            F.lit("ტრანსპორტირების"), say("დასრულების ადგილი: ფოთი, ქუჩა ", n), flat,
        ),
        (
            start, say("| 12, თბილისი, სადღაც #", key), say("სს ბაზარი ", source), F.lit("\n".join("x" * 31)),
            label, seller, F.lit("ტრანსპორტირების დასრუულების"), F.lit("ადგილი"), say("ზესტაფონი, ქუჩა ", n),
        ),
        (
            say("გამყიდველის დასახელება თბილისი #", key), start,
            say("შპს გამყიდველი 200200200 სს ზღაპარი ", source), label,
            F.lit("საიდენტიფიკაციო / პირადი ნომერი"), F.lit("400 111 222"), say("ნაკვეთი ", n),
        ),
        (
            say("| 7 ოპერაციის ქუთაისი, ქუჩა 1 #", key, " ", start), F.lit("x"), done,
            F.lit("ოპერაციის შინაარსი"), say("ქუთაისი, გამზირი ", n),
        ),
        (say("შპს ერთი შპს ორი ", source), say(done, ": ბათუმი, ქუჩა 1"), label, say(done, ": თბილისი, ქუჩა ", n), flat),
    )
    layout = F.col("doc_id") % len(pages)
    page = F.concat_ws("\n", *pages[0])
    for i, lines in enumerate(pages[1:], start=1):
        page = F.when(layout == i, F.concat_ws("\n", *lines)).otherwise(page)
    whole = F.concat_ws("\n", page, F.lit("სასაქონლო ზედნადების ცხრილი"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", whole.alias("text"))
    return docs.repartition("doc_id")
