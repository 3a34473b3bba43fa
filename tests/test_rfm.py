import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from order_rows import REF, ago, by_key
from custscope.operators import rfm


@pytest.fixture
def simple(make_orders):
    days = {"C001": [(10, 5000), (40, 4500), (70, 6000), (100, 5500)],
            "C002": [(200, 2000), (260, 1800), (320, 2200)], "C003": [(30, 1500)]}
    return make_orders([(c, ago(d), p) for c, rows in days.items() for d, p in rows])


def test_features_by_hand(simple, ref):
    got = by_key(rfm.rfm_complete(simple, ref))
    assert {c: (r.recency, r.frequency, r.monetary) for c, r in got.items()} == {
        "C001": (10, 4, 21000.0), "C002": (200, 3, 6000.0), "C003": (30, 1, 1500.0)}
    assert got["C001"].dias_entre_compras == 30
    assert got["C003"].es_single_buyer == 1 and got["C001"].es_single_buyer == 0
    assert got["C003"].dias_entre_compras == pytest.approx(58.5)


def test_only_single_buyers_fall_back(make_orders, ref):
    got = by_key(rfm.rfm_complete(make_orders([("C1", ago(10), 100), ("C2", ago(20), 200)]), ref))
    assert [(r.es_single_buyer, r.dias_entre_compras) for r in got.values()] == [(1, 365.0)] * 2


def test_window_drops_old_orders(make_orders, ref):
    got = by_key(rfm.rfm_complete(make_orders([
        ("C1", ago(30), 1000), ("C1", ago(1800), 2000), ("C2", ago(1800), 2000)]), ref))
    assert set(got) == {"C1"}
    assert (got["C1"].frequency, got["C1"].monetary, got["C1"].es_single_buyer) == (1, 1000.0, 1)


def test_reference_time_without_zone_and_shift(simple):
    naive = by_key(rfm.rfm_complete(simple, datetime(2026, 1, 1)))
    later = by_key(rfm.rfm_complete(simple, REF + timedelta(days=100)))
    assert all(later[c].recency == naive[c].recency + 100 for c in naive)


def test_orders_after_reference_clip_recency_and_can_be_capped(make_orders, ref):
    orders = make_orders([("C1", ago(-5), 10), ("C1", ago(5), 20)])
    assert by_key(rfm.rfm_complete(orders, ref))["C1"].recency == 0
    capped = by_key(rfm.rfm_complete(orders, ref, cap_at_ref=True))["C1"]
    assert (capped.recency, capped.frequency) == (5, 1)


def test_missing_column_and_null_customer(spark, ref):
    frame = spark.createDataFrame([("C1", ago(1))], "cliente_id string, fecha timestamp")
    with pytest.raises(ValueError, match="pago_total"):
        rfm.rfm_complete(frame, ref)
    orders = spark.createDataFrame(
        [(None, ago(1), 1.0), ("C1", ago(1), None)], "cliente_id string, fecha timestamp, pago_total double")
    assert [(r.cliente_id, r.monetary) for r in rfm.rfm_complete(orders, ref).collect()] == [("C1", 0.0)]


def test_cadence_equals_brute_force_with_a_hot_customer(make_orders, ref):
    """Many orders within a day, and one customer with a third of all rows."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        customer = "HOT" if i % 3 == 0 else f"C{rng.randrange(60)}"
        rows.append((customer, REF - timedelta(seconds=rng.randrange(200 * 86400)), 1.0))
    times = {}
    for c, t, _ in rows:
        times.setdefault(c, []).append(t)
    expected = {}
    for c, ts in times.items():
        ts.sort()
        gaps = [(b - a) // timedelta(days=1) for a, b in zip(ts, ts[1:])]
        expected[c] = float(median(gaps)) if gaps else None
    got = {r.cliente_id: r.dias_entre_compras for r in rfm.purchase_cadence(make_orders(rows), ref).collect()}
    assert got == expected


def test_shuffle_partitions_do_not_change_results(spark, simple, ref):
    first = sorted(rfm.rfm_complete(simple, ref).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(rfm.rfm_complete(simple, ref).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
