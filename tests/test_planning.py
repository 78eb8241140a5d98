"""Order planning against a direct restatement of the rules in plain Python."""

import random
import statistics
from collections import defaultdict
from datetime import date, timedelta

import pytest

from tradewind.plans import planning as P

AS_OF = date(2026, 6, 1)


def make(seed):
    rng = random.Random(seed)
    invoices, lines = [], []
    for store, visits in ((1, 1), (2, 2), (3, 6), (4, 10), (5, 20)):
        for _ in range(visits):
            iid = len(invoices) + 1
            day = AS_OF - timedelta(days=rng.randint(0, 59))
            invoices.append((iid, store, day, False))
            for product in rng.sample([1, 2, 3, 4], 3):
                steady = 10.0 if product == 1 else float(rng.randint(1, 40))
                lines.append((iid, product, steady, 1.5, steady * 1.5))
    invoices += [(900, 5, AS_OF - timedelta(days=61), False), (901, 5, AS_OF, True)]
    lines += [(900, 1, 500.0, 1.0, 500.0), (901, 1, 500.0, 1.0, 500.0), (1, 2, -3.0, 1.0, -3.0)]
    return invoices, lines


NAMES = {1: "შავი პური", 2: "თეთრი", 3: "x", 4: "Dark rye"}


def expected(invoices, lines):
    by_id = {i: (s, d) for i, s, d, ret in invoices if not ret and d >= AS_OF - timedelta(days=60)}
    history = [(*by_id[i], NAMES[p], q) for i, p, q, _, _ in lines if i in by_id and q > 0]
    out = {}
    for store in {h[0] for h in history}:
        dates = sorted({h[1] for h in history if h[0] == store})
        gaps = [(b - a).days for a, b in zip(dates, dates[1:])]
        freq = round(sum(gaps) / len(gaps), 1) if gaps else 2.0
        n_days = max(1, (dates[-1] - dates[0]).days + 1)
        per = defaultdict(lambda: defaultdict(float))
        for s, d, name, q in history:
            if s == store:
                per[name][d] += q
        for name, days in per.items():
            if len(name) < 2:
                continue
            total = sum(days.values())
            c = 85 if len(dates) >= 15 else 75 if len(dates) >= 8 else 65 if len(dates) >= 4 else 50
            if len(days) > 2:
                cv = statistics.stdev(days.values()) / (statistics.mean(days.values()) + 0.001)
                c = min(c + 10, 90) if cv < 0.3 else max(c - 15, 40) if cv > 0.7 else c
            out[store, name] = (
                round(total / len(dates), 1), max(1, round(total / n_days * freq * 1.1)), c,
                7 if "შავი" in name or "dark" in name.lower() else 6, len(dates), freq,
            )
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recommendations_follow_the_rules(spark, seed):
    invoices, lines = make(seed)
    inv = spark.createDataFrame(invoices, "invoice_id long, store_id long, effective_date date, is_return boolean")
    li = spark.createDataFrame(lines, "invoice_id long, product_id long, quantity double, unit_price double, line_total double")
    products = spark.createDataFrame(list(NAMES.items()), "product_id long, product_name string")
    history = P.order_history(inv, li, AS_OF)
    got = {
        (r.store_id, r["product"]): (r.avg_per_visit, r.recommended_qty, r.confidence_pct, r.shelf_life_days, r.n_visits, r.visit_freq_days)
        for r in P.product_recommendations(history, products).collect()
    }
    assert got == expected(invoices, lines)

    stores = spark.createDataFrame([(i, f"s{i}") for i in range(1, 8)], "store_id long, store_display_name string")
    plan = {r.store_id: r for r in P.order_plan(history, products, stores, AS_OF).collect()}
    assert len(plan) == 7
    assert plan[7].visit_freq_days == 2.0 and plan[7].next_visit == AS_OF + timedelta(days=2)
    for store, row in plan.items():
        mine = [v for (s, _), v in got.items() if s == store]
        assert row.total_pieces == sum(v[1] for v in mine) and row.n_products == len(mine)
        assert row.n_high == sum(v[2] >= 80 for v in mine)
        if mine:
            assert row.next_visit == AS_OF + timedelta(days=round(mine[0][5]))
    mean = P.order_plan_summary(P.order_plan(history, products, stores, AS_OF)).first()
    assert mean.n_stores == 7
    assert mean.mean_visit_freq == pytest.approx(sum(r.visit_freq_days for r in plan.values()) / 7, abs=0.051)


def test_scope_limits_history(spark):
    invoices, lines = make(3)
    inv = spark.createDataFrame(invoices, "invoice_id long, store_id long, effective_date date, is_return boolean")
    li = spark.createDataFrame(lines, "invoice_id long, product_id long, quantity double, unit_price double, line_total double")
    assert {r.store_id for r in P.order_history(inv, li, AS_OF, 60, [2, 3]).collect()} == {2, 3}
