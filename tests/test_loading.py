"""Waybill XML, upsert, import, document ingest, stream and audit."""

import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tradewind.operators import ingest as I
from tradewind.operators.documents import extract_documents
from tradewind.operators.entities import resolve_stores
from tradewind.schema import table_schema
from tradewind.sources.usage_log import read_usage_log, usage_by_user_model, usage_costs
from tradewind.sources.waybills import read_waybill_errors, read_waybill_xml, stream_waybill_xml
from tradewind.streaming import waybill_stream as WS


def waybill(number, products, tag="invoice_id", buyer="შპს მაღაზია"):
    lines = "".join(
        f"<Product><product_name>{n}</product_name><quantity>{q}</quantity><price>{p}</price></Product>"
        for n, q, p in products
    )
    return (
        f"<Waybill><{tag}>{number}</{tag}><date>2026-05-14T11:22:00</date><buyer_name>{buyer}</buyer_name>"
        f"<buyer_address>ქუჩა 1</buyer_address><buyer_barcode>#44</buyer_barcode><Products>{lines}</Products></Waybill>"
    )


def envelope(*waybills):
    body = "".join(waybills)
    return (
        '<?xml version="1.0" encoding="utf-8"?><soap:Envelope xmlns:soap="http://schemas.xmlsoap.org/soap/envelope/">'
        f'<soap:Body><R xmlns="http://tempuri.org/"><Waybills>{body}</Waybills></R></soap:Body></soap:Envelope>'
    )


THREE = [
    waybill("0968606515", [("a", 24, 2.40), ("b", 12, 3.10)]),
    waybill("0968712044", [("a", 18, 2.85), ("b", 30, 1.95), ("c", 8, 4.20)], buyer="სს სხვა"),
    waybill("0968830192", [("a", 20, 3.25), ("d", 10, 5.50)]),
]


@pytest.fixture
def xml(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.xml").write_text(envelope(*THREE), encoding="utf-8")
    return folder


def test_waybill_xml(spark, xml):
    df = read_waybill_xml(spark, str(xml))
    sums = {r.invoice_id: (r.n, round(r.s, 2)) for r in df.groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum("line_total").alias("s")).collect()}
    assert sums == {"0968606515": (2, 94.8), "0968712044": (3, 143.4), "0968830192": (2, 120.0)}
    first = df.filter("invoice_id = '0968606515' AND line_no = 0").first()
    assert (first.buyer_name, first.date, first.seller_name) == ("შპს მაღაზია", "2026-05-14T11:22:00", "")


def test_waybill_xml_edge_shapes(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        envelope(
            waybill("01", []),
            waybill("02", [("x", 1, 1)], tag="WaybillNumber"),
            "<Waybill><InvoiceId> 03 </InvoiceId><Products><Product><name>n</name><Quantity>2</Quantity>"
            "<UnitPrice>1.005</UnitPrice></Product><Product><ProductName>m</ProductName></Product></Products></Waybill>",
            "<Waybill><invoice_id>04</invoice_id><Product><name>direct</name><quantity>3</quantity><price>2</price></Product></Waybill>",
        ),
        encoding="utf-8",
    )
    (tmp_path / "b.xml").write_text(
        "<waybills><invoice><invoice_id>05</invoice_id><products><product><product_name>p</product_name>"
        "<quantity>2</quantity><price>3</price></product></products></invoice></waybills>",
        encoding="utf-8",
    )
    rows = {
        (r.invoice_id, r.line_no): (r.product_name, r.quantity, r.price, r.line_total)
        for r in read_waybill_xml(spark, str(tmp_path)).collect()
    }
    assert rows == {
        ("01", 0): ("", 0.0, 0.0, 0.0),
        ("02", 0): ("x", 1.0, 1.0, 1.0),
        ("03", 0): ("n", 2.0, 1.005, 2.01),
        ("03", 1): ("m", 0.0, 0.0, 0.0),
        ("04", 0): ("direct", 3.0, 2.0, 6.0),
        ("05", 0): ("p", 2.0, 3.0, 6.0),
    }


def test_upsert_is_idempotent_and_the_last_row_wins(spark):
    kind = "invoice_id string, product_name string, buyer_barcode string, quantity double, synced_at timestamp, line_no int"
    t1, t2 = datetime(2026, 5, 1), datetime(2026, 5, 2)
    old = spark.createDataFrame([("1", "a", "x", 1.0, t1, 0), ("1", "b", None, 1.0, t1, 1), ("2", "a", "x", 1.0, t1, 0)], kind)
    new = spark.createDataFrame([("1", "a", "x", 2.0, t2, 0), ("1", "a", "x", 3.0, t2, 5), ("1", "b", "", 7.0, t2, 1)], kind)
    once = I.upsert_waybills(old, new)
    key = lambda df: sorted((r.invoice_id, r.product_name, r.buyer_barcode, r.quantity) for r in df.collect())
    assert key(once) == [("1", "a", "x", 3.0), ("1", "b", "", 7.0), ("2", "a", "x", 1.0)]
    assert key(I.upsert_waybills(once, new)) == key(once)
    both = old.unionByName(new)
    assert key(I.latest_per_key(both)) == key(once)


def empty(spark, kind):
    return spark.createDataFrame([], kind)


def test_waybill_xml_containers_at_any_depth_and_bad_numbers(spark, tmp_path):
    p = lambda n, q="1", x="2": f"<Product><name>{n}</name><quantity>{q}</quantity><price>{x}</price></Product>"
    wrap = lambda i, body: f"<n:Waybill xmlns:n='u' n:k='v'><n:invoice_id>{i}</n:invoice_id>{body}<date>d</date></n:Waybill>"
    (tmp_path / "a.xml").write_text(
        "<r>"
        + wrap("1", f"<Products>{p('a')}</Products><Products></Products><Products/>")
        + wrap("2", f"<Extra><Products><Products>{p('b')}</Products></Products></Extra><Products>{p('c')}{p('d')}</Products>")
        + wrap("3", f"<Products><!-- <Product><name>no</name></Product> --></Products>{p('e')}")
        + wrap("4", f"<Products>{p('f', 'two')}{p('g &amp; h', ' 3 ', '1e2')}</Products>")
        + f"<Invoice><WaybillNumber>5</WaybillNumber><products><product><name>i</name></product></products></Invoice>"
        + "<invoice><invoice_id>6</invoice_id><Products><Product/></Products></invoice></r>",
        encoding="utf-8",
    )
    rows = read_waybill_xml(spark, str(tmp_path)).collect()
    got = sorted((r.invoice_id, r.line_no, r.product_name, r.quantity, r.price, r.date) for r in rows)
    assert got == [
        ("1", 0, "a", 1.0, 2.0, "d"),
        ("2", 0, "b", 1.0, 2.0, "d"),
        ("2", 1, "c", 1.0, 2.0, "d"),
        ("2", 2, "d", 1.0, 2.0, "d"),
        ("3", 0, "e", 1.0, 2.0, "d"),
        ("4", 1, "g & h", 3.0, 100.0, "d"),
        ("5", 0, "i", 0.0, 0.0, ""),
        ("6", 0, "", 0.0, 0.0, ""),
    ]
    errors = [tuple(r) for r in read_waybill_errors(spark, str(tmp_path)).collect()]
    assert errors == [("4", "f", 0, "two")]


def test_import_without_buyer_or_number_keeps_everything(spark):
    lines = spark.createDataFrame(
        [("1", None, "x", "d", 0, "p", 1.0, 2.0, 2.0), (None, "b", "y", "d", 0, "q", 1.0, 3.0, 3.0), (None, "b", "y", "d", 1, "r", 2.0, 3.0, 6.0)],
        "invoice_id string, buyer_name string, buyer_address string, date string, line_no int, product_name string, "
        "quantity double, price double, line_total double",
    )
    loaded = I.import_waybills(
        lines, empty(spark, "id long, name string"), empty(spark, "id long, invoice_number string"), empty(spark, "id long")
    )
    stores = {r.id: r.name for r in loaded.stores.collect()}
    assert sorted(stores.values()) == ["", "b"]
    invoices = {r.id: (stores[r.store_id], r.invoice_number, r.total) for r in loaded.invoices.collect()}
    assert sorted(invoices.values()) == [("", "1", 2.0), ("b", "", 9.0)]
    assert sorted((invoices[r.invoice_id][1], r.description) for r in loaded.items.collect()) == [("", "q"), ("", "r"), ("1", "p")]


def test_import_twice_adds_nothing_the_second_time(spark, xml):
    lines = read_waybill_xml(spark, str(xml))
    stores = spark.createDataFrame([(5, "სს სხვა")], "id long, name string")
    invoices = empty(spark, "id long, invoice_number string")
    items = empty(spark, "id long")
    first = I.import_waybills(lines, stores, invoices, items)
    assert tuple(I.loaded_counts(first).first()) == (3, 7, 1)
    assert [(r.id, r.name, r.address) for r in first.stores.collect()] == [(6, "შპს მაღაზია", "ქუჩა 1")]
    totals = {r.invoice_number: (r.store_id, r.total, r.subtotal) for r in first.invoices.collect()}
    assert totals["0968712044"] == (5, 143.4, 143.4) and totals["0968606515"] == (6, 94.8, 94.8)
    assert sorted(r.id for r in first.items.collect()) == list(range(1, 8))
    again = I.import_waybills(
        lines, stores.unionByName(first.stores.select("id", "name")), first.invoices, first.items
    )
    assert tuple(I.loaded_counts(again).first()) == (0, 0, 0)


DOC = """სასაქონლო ზედნადები ელ- 0968606515
თარიღი: 14.05.2026 დრო: 11:22:33
შპს ლაქი
მყიდველის (მიმღების) დასახელება
ტრანსპორტირების დასრულების ადგილი: თბილისი, ქუჩა 5
სასაქონლო ზედნადების ცხრილი
1 პური თეთრი 700გ 4860001234567 ცალი 24.00 2.40 57.60
2 პური შავი 500გ 4860001234568 ცალი 12.00 3.10 37.20
"""


def test_ingest_documents(spark):
    docs = spark.createDataFrame(
        [(1, "/in/a.b.pdf", DOC), (2, "in\\x.pdf", "პური 2 1,5\nსულ 2 3\nრძე 1 x"), (3, "again.pdf", DOC), (4, "known.pdf", "")],
        "doc_id long, file string, text string",
    )
    full = extract_documents(docs).withColumn("store_id", F.lit(1).cast("long"))
    invoices = spark.createDataFrame([(10, 1, "known")], "id long, store_id long, invoice_number string")
    products = spark.createDataFrame([(3, "პური")], "id long, name string")
    loaded = I.ingest_documents(full, invoices, empty(spark, "id long"), products)
    got = {r.doc_id: r for r in loaded.invoices.collect()}
    assert set(got) == {1, 2}
    assert (got[1].id, got[1].invoice_number, got[1].subtotal, got[1].total) == (11, "0968606515", 94.8, 94.8)
    assert got[1].notes == "time=11:22:33" and got[1].invoice_date == "14.05.2026" and got[1].currency == "GEL"
    assert (got[2].id, got[2].invoice_number, got[2].subtotal) == (12, "x", 3.0)
    assert got[2].notes == "warnings: store_name unresolved"
    new = [(r.id, r.name, r.unit, r.default_unit_price) for r in loaded.products.orderBy("id").collect()]
    assert new == [(4, "პური თეთრი 700გ", "ცალი", 2.4), (5, "პური შავი 500გ", "ცალი", 3.1)]
    items = [(r.id, r.invoice_id, r.product_id, r.line_no, r.quantity, r.line_total) for r in loaded.items.orderBy("id").collect()]
    assert items == [(1, 11, 4, 1, 24.0, 57.6), (2, 11, 5, 2, 12.0, 37.2), (3, 12, 3, 1, 2.0, 3.0)]


def test_items_without_a_price_have_no_total(spark):
    line = "array<struct<name:string,quantity:string,price:string>>"
    docs = spark.createDataFrame(
        [(1, "f.pdf", 1, "1", None, None, [f"w{i}" for i in range(7)], "", [("a", "x", "")])],
        f"doc_id long, file string, store_id long, waybill_number string, invoice_date string, invoice_time string, "
        f"warnings array<string>, raw_text string, lines {line}",
    )
    known = (empty(spark, "id long, store_id long, invoice_number string"), empty(spark, "id long"), empty(spark, "id long, name string"))
    loaded = I.ingest_documents(docs, *known)
    inv, item = loaded.invoices.first(), loaded.items.first()
    assert (inv.subtotal, inv.total, inv.raw_text) == (None, None, None)
    assert inv.notes == "warnings: w0; w1; w2; w3; w4; w5; w6"
    cut = I.ingest_documents(docs.withColumn("raw_text", F.lit("abcdef")), *known, max_warnings=2, raw_text_limit=4)
    assert [(r.notes, r.raw_text) for r in cut.invoices.collect()] == [("warnings: w0; w1", "abcd")]
    assert (item.quantity, item.unit_price, item.line_total) == (0.0, None, None)


def test_resolve_stores(spark):
    stores = spark.createDataFrame([(1, "A", "x "), (2, "A", "y"), (3, "B", None)], "id long, name string, address string")
    docs = spark.createDataFrame(
        [
            (1, "A", "x", None, 1), (2, "A", "y", None, 1), (3, "A", "z", None, 1), (4, "B", " ", None, 3),
            (5, "C", None, "home", None), (6, None, None, None, None), (7, "C", None, "home", None),
        ],
        "doc_id long, store_name string, branch_address string, buyer_address string, matched_store_id long",
    )
    linked, new = resolve_stores(docs, stores)
    got = {r.doc_id: (r.outcome, r.store_id) for r in linked.collect()}
    ids = {(r.name, r.address): r.id for r in new.collect()}
    assert set(ids) == {("A", "z"), ("C", "home"), ("(უცნობი მყიდველი)", None)} and set(ids.values()) == {4, 5, 6}
    assert got[1] == ("same_id_address", 1) and got[2] == ("same_name_address", 2)
    assert got[3] == ("new_branch", ids["A", "z"]) and got[4] == ("matched_name", 3)
    assert got[5] == got[7] == ("new_store", ids["C", "home"])
    assert got[6] == ("new_store", ids["(უცნობი მყიდველი)", None])


def test_stream_loads_new_files_only(spark, xml, tmp_path):
    log, runs, checkpoint = (str(tmp_path / n) for n in ("log", "runs", "checkpoint"))

    def once():
        WS.waybill_stream(stream_waybill_xml(spark, str(xml)), log, runs, checkpoint).awaitTermination()
        return WS.current_waybills(WS.read_log(spark, log))

    assert WS.read_sync_runs(spark, runs).count() == 0
    assert once().count() == 7
    assert once().count() == 7
    (xml / "2.xml").write_text(envelope(waybill("0968606515", [("a", 30, 2.40), ("z", 1, 1)])), encoding="utf-8")
    table = once()
    assert table.count() == 8
    assert table.filter("invoice_id = '0968606515' AND product_name = 'a'").first().quantity == 30.0
    audit = {r.run_id: r for r in WS.read_sync_runs(spark, runs).collect()}
    assert [(audit[i].status, audit[i].rows_written, audit[i].waybills_count) for i in sorted(audit)] == [
        ("success", 7, 3), ("success", 2, 1),
    ]
    for _ in range(2):
        WS.compact_log(spark, log)
    assert sorted(map(str, WS.current_waybills(WS.read_log(spark, log)).collect())) == sorted(map(str, table.collect()))
    # Batches up to the snapshot may go; a later load goes on from it.
    for folder in (tmp_path / "log").glob("batch_id=*"):
        shutil.rmtree(folder)
    assert WS.current_waybills(WS.read_log(spark, log)).count() == 8
    (xml / "3.xml").write_text(envelope(waybill("0968606515", [("a", 99, 1)]), waybill("07", [("k", 1, 1)])), encoding="utf-8")
    table = once()
    assert table.count() == 9
    assert table.filter("invoice_id = '0968606515' AND product_name = 'a'").first().quantity == 99.0


def test_failed_batch_is_recorded_raised_and_retried(spark, xml, tmp_path):
    log, runs = str(tmp_path / "log"), str(tmp_path / "runs")
    batch = read_waybill_xml(spark, str(xml))

    def broken(df):
        raise RuntimeError("x" * 5000)

    with pytest.raises(RuntimeError):
        WS.sync_batch(log, runs, broken)(batch, 3)
    run = WS.read_sync_runs(spark, runs).first()
    assert run.status == "failed" and len(run.error_message) == 5000 and run.finished_at is not None
    for _ in range(2):
        WS.sync_batch(log, runs)(batch, 3)
    assert WS.read_log(spark, log).count() == 7
    assert WS.read_sync_runs(spark, runs).first().status == "success"


def test_usage_log(spark, tmp_path):
    path = tmp_path / "ai.log"
    path.write_text(
        '{"ts":"2026-05-01T00:00:00","user_id":1,"model":"m","input_tokens":10,"output_tokens":5,"cache_creation_input_tokens":1234}\n'
        '{"user_id":1,"model":"m","input_tokens":1}\n',
        encoding="utf-8",
    )
    costs = usage_costs(read_usage_log(spark, str(path)))
    assert sorted((r.tokens_used, r.cache_creation_cost_usd_est) for r in costs.collect()) == [(1, 0.0), (15, 0.001234)]
    assert tuple(usage_by_user_model(read_usage_log(spark, str(path))).first()) == (1, "m", 2, 16, 0.001234)


def test_table_schemas_parse():
    schema = table_schema("invoices")
    assert not schema["invoice_number"].nullable and schema["notes"].nullable
