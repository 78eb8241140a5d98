"""Appendices merged into their parents, compared with a sequential restatement."""

import random

from tradewind.operators import stitching as ST

UNKNOWN = "(უცნობი მყიდველი)"
INV = (
    "id long, invoice_number string, store_id long, subtotal double, total double, "
    "source_file string, raw_text string, notes string"
)
ITEM = "id long, invoice_id long, line_no int, line_total double"


def test_hand_made_case(spark):
    stores = spark.createDataFrame([(1, "a"), (2, f" {UNKNOWN} "), (3, UNKNOWN), (4, "b")], "id long, name string")
    invoices = spark.createDataFrame(
        [
            (1, "0964437553", 1, 5.0, 5.0, "m.pdf", None, "own"),
            (2, "x", 4, 1.0, 1.0, None, None, None),
            (10, "0964437553/5", 2, 9.0, 9.0, "it's.pdf", None, "note"),
            (11, "invoice_19_1", 2, 9.0, 9.0, "b.pdf", "0964437553 სასაქონლო ზედნადები", None),
            (12, "x", 2, 9.0, 9.0, None, None, None),
            (13, "none", 2, 9.0, 9.0, "c.pdf", None, None),
        ],
        INV,
    )
    items = spark.createDataFrame(
        [(1, 1, 7, 5.0), (2, 11, None, 1.0), (3, 10, 2, 2.0), (4, 10, 1, 3.0), (5, 10, None, 4.0), (6, 12, 1, None), (7, 13, 1, 8.0)],
        ITEM,
    )
    got = ST.stitch_appendices(stores, invoices, items)
    assert {(r.appendix_id, r.parent_id) for r in got.links.collect()} == {(10, 1), (11, 1), (12, 2)}
    assert {r.id: (r.invoice_id, r.line_no) for r in got.items.collect()} == {
        1: (1, 7), 4: (1, 8), 3: (1, 9), 5: (1, 10), 2: (1, 11), 6: (2, 1), 7: (13, 1),
    }
    inv = {r.id: r for r in got.invoices.collect()}
    assert set(inv) == {1, 2, 13}
    assert (inv[1].total, inv[1].subtotal) == (15.0, 15.0)
    assert (inv[2].total, inv[2].notes) == (None, None)
    assert inv[1].notes == (
        "own | merged appendix source_file=\"it's.pdf\" | appendix notes: note | merged appendix source_file='b.pdf'"
    )
    assert inv[13].total == 9.0
    assert sorted(r.id for r in got.stores.collect()) == [1, 2, 4]
    assert tuple(got.summary.first()) == (4, 3, 1, 1, 1)
    skipped = ST.skipped_appendices(invoices, stores, got.links).first()
    assert (skipped.id, skipped["keys"]) == (13, "")


def test_long_notes_are_cut_like_a_sequential_merge(spark):
    limit = 200
    rng = random.Random(1)
    parts = {i: "n" * rng.randint(1, 30) for i in range(100, 160)}
    invoices = spark.createDataFrame(
        [(1, "p", 1, None, None, None, None, "start")]
        + [(i, "q", 2, None, None, f"{i}.pdf" if i % 3 else None, None, t) for i, t in parts.items()],
        INV,
    )
    links = spark.createDataFrame([(i, 1) for i in parts], "appendix_id long, parent_id long")
    want = "start"
    for i, t in parts.items():
        extra = [f"merged appendix source_file='{i}.pdf'"] if i % 3 else []
        want = " | ".join([want, *extra, f"appendix notes: {t}"])[:limit]
    assert ST.merged_notes(invoices, links, limit).first().notes == want


def test_line_numbers_of_a_hot_parent(spark):
    """Most items belong to one parent; numbering crosses many blocks."""
    rng = random.Random(5)
    items, appendix_of = [], {}
    for a in range(20):
        appendix_of[100 + a] = 1 if a % 4 else 2
        for _ in range(200):
            line = rng.choice([None, None, rng.randint(1, 20_000), 999_999, 1_200_000])
            items.append((len(items) + 1, 100 + a, line, 1.0))
    rng.shuffle(items)
    items += [(9001, 1, 3, 1.0), (9002, 1, 4, 1.0), (9003, 2, None, 1.0)]
    links = spark.createDataFrame(list(appendix_of.items()), "appendix_id long, parent_id long")
    moved = ST.move_items(spark.createDataFrame(items, ITEM), links)
    got = {r.id: (r.invoice_id, r.line_no) for r in moved.collect()}
    want = {9001: (1, 3), 9002: (1, 4), 9003: (2, None)}
    for parent, last in ((1, 4), (2, 0)):
        mine = [i for i in items if appendix_of.get(i[1]) == parent]
        mine.sort(key=lambda i: (i[1], i[2] if i[2] is not None else 999_999, i[0]))
        want.update({i[0]: (parent, last + n) for n, i in enumerate(mine, start=1)})
    assert got == want


def test_totals_and_counts(spark):
    invoices = spark.createDataFrame([(1, "a", 1, 7.0, 7.0, None, None, None), (2, "b", 1, 7.0, 7.0, None, None, None)], INV)
    items = spark.createDataFrame([(1, 1, 1, 0.1), (2, 1, 2, 0.2)], ITEM)
    got = {r.id: (r.subtotal, r.total) for r in ST.recompute_totals(invoices, items).collect()}
    assert got == {1: (0.3, 0.3), 2: (None, None)}
    only = spark.createDataFrame([(1,)], "id long")
    got = {r.id: r.total for r in ST.recompute_totals(invoices, items, only).collect()}
    assert got == {1: 0.3, 2: 7.0}
    stores = spark.createDataFrame([(1, "b"), (2, "A")], "id long, name string")
    assert [(r.id, r.n_invoices) for r in ST.store_invoice_counts(stores, invoices).collect()] == [(2, 0), (1, 2)]
