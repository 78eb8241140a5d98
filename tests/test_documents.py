"""Field extraction on small hand-made pages."""

import pytest
from pyspark.sql import functions as F

from tradewind.functions import documents as D
from tradewind.functions import text as T
from tradewind.operators import documents as O

LABEL = "მყიდველის (მიმღების) დასახელება"
DONE = "ტრანსპორტირების დასრულების ადგილი"
START = "ტრანსპორტირების დაწყების ადგილი"
ID = "საიდენტიფიკაციო / პირადი ნომერი"
TABLE = "სასაქონლო ზედნადების ცხრილი"
HQ = "თბილისი, თ.ერისთავის 1"


@pytest.fixture
def field(spark):
    """Evaluate a function of (text, lines) on several pages."""

    def run(fn, pages):
        rows = [(i, p if isinstance(p, str) else "\n".join(p)) for i, p in enumerate(pages)]
        df = spark.createDataFrame(rows, "i int, text string").withColumn("lines", D.clean_lines(F.col("text")))
        return [r.r for r in df.select("i", fn(F.col("text"), F.col("lines")).alias("r")).orderBy("i").collect()]

    return run


def test_clean_lines(field):
    assert field(lambda t, n: n, [" a  \t b \r\n\r\n\n \nc"]) == [["a b", "c"]]


def test_waybill_number(evaluate):
    cases = {
        "x\n0968606515/5 სასაქონლო ზედნადებ": "0968606515/5",
        "ელ-0968606515 / 3": "0968606515/3",
        "სასაქონლო ზედნადები # AB-1/2.": "AB-1/2.",
        "waybill: Z9": "Z9",
        "№ AB-12345": "AB-12345",
        "  12345678 დანართი": "12345678",
        "12345678 " + "x" * 250 + " დანართი": None,
        "nothing": None,
    }
    assert evaluate(D.waybill_number, list(cases)) == list(cases.values())


def test_text_quality(evaluate):
    got = evaluate(D.needs_reextraction, ["x " * 47, "x " * 48, "y" * 60 + "(CID:12)", "", None])
    assert got == [True, False, True, True, True]


def test_buyer_name(field):
    pages = [
        ["შპს გამყიდველი", "შპს ლაქი", "123 456", LABEL],
        ["შპს გამყიდველი 200200200 სს ზღაპარი", LABEL],
        ["შპს ერთი შპს ორი", LABEL],
        ["სსზღაპარი", "მყიდველის და მიმღების დასახელება"],
        # Nothing above: the best line around the label counts.
        [LABEL, "სახელი", "შპს ლაქი"],
        # More than 30 lines above, and the seller below: the header decides.
        ["სს ბ"] + ["x"] * 31 + [LABEL, "შპს ელთი დისტრიბუცია"],
        # No label: the header above the item table.
        ["სათაური", "შპს ელთი დისტრიბუცია", "შპს სმარტ რითეილი", TABLE, "შპს პროდუქტი და სხვა საქონელი"],
        ["სათაური", TABLE, "შპს ლაქი"],
    ]
    assert field(lambda t, n: D.buyer_name(n), pages) == [
        "შპს ლაქი", "სს ზღაპარი", "შპს ორი", "სსზღაპარი", "შპს ლაქი", "სს ბ", "შპს სმარტ რითეილი", None,
    ]


def test_destination(field):
    pages = [
        [LABEL, f"{START}: ბათუმი, ქუჩა 1", f"{DONE}: თბილისი, ქუჩა 5"],
        ["გორი, ქუჩა 9", "12345678", DONE, "შემდეგი"],
        ["x", DONE, "ოპერაციის შინაარსი", "ქუთაისი, გამზირი 2"],
        ["ტრანსპორტირების", "დასრულების ადგილი: ფოთი, ქუჩა 3"],
        [LABEL, ID, "400 111 222", "ნაკვეთი 17"],
        ["არაფერი აქ"],
    ]
    assert field(lambda t, n: D.destination_address(t, n), pages) == [
        "თბილისი, ქუჩა 5", "გორი, ქუჩა 9", "ქუთაისი, გამზირი 2", "ფოთი, ქუჩა 3", "ნაკვეთი 17", None,
    ]


def test_destination_prefers_the_caption_after_the_buyer_label(field):
    page = [f"{DONE}: ბათუმი, ქუჩა 1", LABEL, f"{DONE}: თბილისი, ქუჩა 5"]
    assert field(lambda t, n: D.destination_address(t, n), [page]) == ["თბილისი, ქუჩა 5"]


def test_destination_window_reads_the_raw_text(field):
    # The completion word is doubled by the scanner, so no line carries it literally.
    page = ["ტრანსპორტირების დასრუულების", "ადგილი", "ზესტაფონი, ქუჩა 4", TABLE, "თბილისი"]
    assert field(lambda t, n: D.destination_by_lines(n), [page]) == [None]
    assert field(lambda t, n: D.destination_by_window(t), [page]) == ["ზესტაფონი, ქუჩა 4"]


def test_origin(field):
    pages = [
        [f"| 7 ოპერაციის ქუთაისი, ქუჩა 1 #7 {START}"],
        ["გორი #12", "111", START],
        ["გამყიდველის დასახელება თბილისი #9", START],
        ["x", "სენაკი, ქუჩა 8", START],
        [START, "| 12, თბილისი, სადღაც #3"],
        [START],
    ]
    assert field(lambda t, n: D.origin_address(n), pages) == [
        "ქუთაისი, ქუჩა 1 #7", "გორი #12", "თბილისი #9", "სენაკი, ქუჩა 8", "თბილისი, სადღაც #3", None,
    ]


def test_branch_address(spark):
    rows = [
        ("მიწოდება", "გორი #1", "თბილისი #2", "თბილისი #2"),
        ("უკან დაბრუნება", "გორი #1", "თბილისი #2", "გორი #1"),
        ("მიწოდება", "გორი #1", HQ, "გორი #1"),
        ("საკრედიტო", HQ, None, None),
        ("საკრედიტო", None, "თბილისი #2", "თბილისი #2"),
    ]
    df = spark.createDataFrame(rows, "t string, o string, d string, want string")
    got = df.withColumn("got", D.store_branch_address(F.col("t"), F.col("o"), F.col("d")))
    assert got.filter("NOT got <=> want").collect() == []


def test_addresses(evaluate):
    cases = {
        "ოპერაციის მიზანი თბილისი,  ქუჩა 1": "თბილისი, ქუჩა 1",
        "ოპერაციის მიზანი": None,
        "სახლი, სოფელი დიღომი": "სოფელი დიღომი",
        "ქ. გორი": "ქ. გორი",
        "x": None,
    }
    assert evaluate(D.trim_to_address_start, list(cases)) == list(cases.values())
    block = f"ბათუმი, ძველი\n{DONE}: \nთბილისი, ქუჩა 1\nგორი\nთბილისი, ქუჩა 1\nსხვა რამ"
    assert evaluate(D.collect_addresses, [block, "გორი\nxyzw", "none here"]) == [
        "თბილისი, ქუჩა 1 | გორი", "გორი", None,
    ]
    assert evaluate(D.looks_like_address, ["გზა ჩემი სახლისკენ", "გზა", "ტრანსპორტირების სახე გზა"]) == [True, False, False]


def test_regions(evaluate):
    page = f"a მყიდველის დასახელება x\nერთი\n{START} ორი\n{TABLE} z"
    assert evaluate(D.buyer_block, [page, "none"]) == ["ერთი", None]
    assert evaluate(D.header_region, [page]) == [f"დასახელება x\nერთი\n{START} ორი"]
    assert evaluate(D.buyer_header_preview, [page]) == [f"მყიდველის დასახელება x\nერთი\n{START} ორი\n"]
    assert evaluate(lambda c: D.buyer_header_preview(c, 9), [page]) == ["მყიდველის"]


def test_line_items(spark):
    pages = {
        1: "1 პური თეთრი 700გ 4860001234567 ცალი 24.00 2.40 57.60\n# 22 რძე ახალი მთელი 4860001234568 5.00\nსულ ჯამი რაც არის 4860001234569 x\n"
           "საქონლის დასახელება 4860001234567 1.00 2.00\na 10 20",
        2: "პური შავი 2 1,5\nსულ 5 6\nrow name 3 4\nab 1\nრძე 1.25 3",
        3: "არაფერი",
        4: "პროდუქტი ნომერი 1 4860001234567 1.00 2.00",
    }
    docs = spark.createDataFrame(list(pages.items()), "doc_id long, text string")
    got = [(r.doc_id, r.line_no, r.name, r.quantity, r.price) for r in O.extract_line_items(docs).orderBy("doc_id", "line_no").collect()]
    assert got == [
        (1, 1, "პური თეთრი 700გ", "24.00", "2.40"),
        (1, 2, "რძე ახალი მთელი", "5.00", ""),
        (2, 1, "პური შავი", "2", "1.5"),
        (2, 2, "რძე", "1.25", "3"),
    ]
    plain = O.extract_line_items(docs, "plain").filter("doc_id = 1").collect()
    assert [r.name for r in plain] == [
        "1 პური თეთრი 700გ 4860001234567 ცალი 24.00", "# 22 რძე ახალი მთელი", "a",
    ]


def test_whole_texts_are_read(spark):
    """Nothing is cut: an item behind a million characters is found."""
    text = "x" * 1_000_000 + "\n" + "\n".join(f"ნივთი{i} {i} 2" for i in range(500))
    docs = spark.createDataFrame([(1, text.replace("ნივთი", "რძე"))], "doc_id long, text string")
    assert O.extract_line_items(docs).count() == 500


def test_values_are_made_once(spark):
    """The unloading place and the captions are looked for once, though several steps read them."""
    docs = spark.createDataFrame([("a", ["a"])], "text string, lines array<string>")
    found = docs.select(D.destination_address(F.col("text"), F.col("lines")).alias("x"), T.find(F.col("text"), "(y+)").alias("y"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("დასრ)") == 1 and plan.count("y+") == 1
