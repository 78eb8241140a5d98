from pyspark.sql import functions as F

from tradewind import fixed_values as V
from tradewind.functions import text
from tradewind.functions.returns import is_return_document, not_return_by_phrases
from tradewind.sources.tables import enrich_stores

HQ = "თბილისი,თ.ერისთავის 1"


def test_branch_code(evaluate):
    cases = {
        "თბილისი #317": "317",
        "#1 ქუჩა # 22": "22",
        "ქუთაისი ＃45": "45",
        HQ: None,
        HQ + ", გლდანი #12": "12",
        "#9, თბილისი , თ. ერისთავის_ 1 ,": "9",
        "ქუჩა 5": None,
        "": None,
        None: None,
    }
    assert evaluate(text.branch_code, list(cases)) == list(cases.values())


def test_supplier_hq_is_cut_once_with_its_commas(evaluate):
    got = evaluate(lambda c: text.strip_supplier_hq(c)["rest"], [HQ + ", ბათუმი, ქუჩა 1", V.MISSING_ADDRESS, "ბათუმი, თბილისი, თ.ერისთავის 1"])
    assert got == ["ბათუმი, ქუჩა 1", V.MISSING_ADDRESS, "ბათუმი"]


def test_store_names(spark):
    rows = [
        (1, "წიკორა ", "თბილისი #317"),
        (2, "ორი ნაბიჯი", None),
        (3, "", "  "),
        (4, "ლაქი #5", HQ),
        (5, "ლაქი", HQ),
        (6, "სმარტი", "ბათუმი, ძალიან გრძელი ქუჩის სახელი 123"),
        (7, None, "გორი #3"),
        (8, "0რი ნაბიჯი", "ქუჩა 5"),
    ]
    df = enrich_stores(spark.createDataFrame(rows, "id long, name string, address string"))
    got = {r.store_id: r.store_display_name for r in df.collect()}
    assert got == {
        1: "ნიკორა (#317)",
        2: "ორი ნაბიჯი (მისამართი_ბაზაში_არაა) · ID: 2",
        3: "(უცნობი მაღაზია) (მისამართი_ბაზაში_არაა) · ID: 3",
        4: "ლაქი #5 (#5)",
        5: "ლაქი (ლოკაცია დაუზუსტებელია)",
        6: "სმარტი (ბათუმი,_ძალიან_გრძელი_ქუჩის…)"[:7] + "(" + "ბათუმი,_ძალიან_გრძელი_ქუჩის_სახელი_123"[:27] + "…)",
        7: "(უცნობი მაღაზია) (#3)",
        8: "ორი ნაბიჯი (ქუჩა_5)",
    }


def test_store_without_address_text_gets_its_id(spark):
    df = spark.createDataFrame([(9, "x")], "id long, name string")
    name = text.store_display_name(F.col("name"), F.lit(None).cast("string"), F.lit(" "), F.col("id"))
    assert df.select(name).first()[0] == "x (ID: 9)"


def test_clean_store_name(evaluate):
    cases = {
        "12. შ პ ს  ორი წაბიჯი (ფილიალი)": "შპს ორი ნაბიჯი",
        "შპს ელთი დისტრიბუცია 200249043 სსზღაპარი": "სს ზღაპარი",
        "შპს ლაქი 404040404": "შპს ლაქი",
        "404040404 | შპს ლაქი": "შპს ლაქი",
        "შპს მაღაზია 1ო5 2ო": "შპს მაღაზია 105 20",
        "წპს მოტოოოორი": "შპს მოტოორი",
        "ლაქი (ფილიალი)": "ლაქი (ფილიალი)",
        "200249043": None,
        "": None,
        None: None,
    }
    assert evaluate(text.clean_store_name, list(cases)) == list(cases.values())


def test_addresses(evaluate):
    cases = {"თბილისი,  გელდანი ": "თბილისი, გლდანი", "ისნი 5": "ისანი 5", "  ": None, None: None}
    assert evaluate(text.fix_address_ocr, list(cases)) == list(cases.values())
    sites = [HQ, "თბილისი, თ.ერისთავის_1 x", "გორი", "", None]
    assert evaluate(text.reset_hq_address, sites) == [None, None, "გორი", "", None]
    assert evaluate(text.address_status, sites) == ["bad", "bad", "ok", "bad", "bad"]


def test_labels(evaluate):
    assert evaluate(text.norm_label, [" a|b  47036      c ", None]) == ["a b 470 c", ""]
    cases = {
        "მაღაზია (#1) · პური · შავი": "პური · შავი",
        "a·b·| 12 | პური": "პური",
        "3. პური": "პური",
        "პური": "პური",
        None: "",
    }
    assert evaluate(text.product_from_label, list(cases)) == list(cases.values())
    assert evaluate(text.shelf_life, ["შავი პური", "DARK rye", "თეთრი"]) == [7, 7, 6]
    assert evaluate(lambda c: text.truncate(c, 4), ["abcd", "abcde", None]) == ["abcd", "abc…", ""]


def test_parse_number(evaluate):
    cases = {"1 234,50": 1234.5, "3.10": 3.1, " 7": 7.0, "x": None, "": None, None: None, "12d": None, "-2": -2.0}
    assert evaluate(text.parse_number, list(cases)) == list(cases.values())


def test_return_documents(spark):
    rows = [
        (1, "CR-12", None, None, True),
        (2, "RET 5", None, None, True),
        (3, "CREDIT", None, None, True),
        (4, "xReturny", None, None, False),
        (5, "CRATE-1", "Creditors", "return", False),
        (6, "1", "საკრედიტო ნოტა", None, True),
        (7, "1", "უკან   დაბრუნება", None, True),
        (8, "1", None, "ტიპი უკანდაბრუნება", True),
        (9, "1", None, "ჩაბარება", False),
        (10, "1", "ჩაბარება", None, True),
        (11, None, None, None, False),
        (12, "a Return b", None, None, True),
    ]
    df = spark.createDataFrame(rows, "id int, n string, notes string, raw string, want boolean")
    got = df.withColumn("got", is_return_document(F.col("n"), F.col("notes"), F.col("raw")))
    assert got.filter("got IS NULL OR got <> want").collect() == []


def test_order_history_phrases_are_null_safe(spark):
    rows = [
        (1, None, None, True),
        (2, "უკან დაბრუნება", None, False),
        (3, "x საკრედიტო", "1", False),
        (4, None, "CREDIT-1", False),
        (5, "ok", "უკანა", False),
        (6, "ok", "CR-1", True),
    ]
    df = spark.createDataFrame(rows, "id int, notes string, n string, want boolean")
    got = df.withColumn("got", not_return_by_phrases(F.col("notes"), F.col("n")))
    assert got.filter("got <> want").collect() == []
