import random
import re
from datetime import date, datetime, timezone

import pytest

from order_rows import ago
from custscope.operators import season
from custscope.operators import serve_rules as rules
from custscope.operators import serve_time as when

RULES = [("MVPs", "CAMARA", "DISCO", 50.0), ("MVPs", "LAPTOP", "MOUSE", 30.0), ("Alto Valor", "CAMARA", "DISCO", 45.0)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(42)
    orders, items = [], []
    for i in range(150):
        days = rng.randrange(1, 180) if i < 100 else rng.randrange(1100, 1500)
        orders.append((f"O{i:05d}", f"C{i % 20:04d}", ago(days, rng.randrange(24)), rng.uniform(500, 5000)))
        fams = ["VIEJO"] if i >= 100 else ["CAMARA", "DISCO"] if i % 2 == 0 else ["LAPTOP", "MOUSE"]
        items += [(f"O{i:05d}", f) for f in fams]
    return {
        "orders": spark.createDataFrame(orders, "order_id string, cliente_id string, fecha timestamp, pago_total double"),
        "items": spark.createDataFrame(items, "order_id string, familia string"),
        "segments": spark.createDataFrame(
            [(f"C{i:04d}", "MVPs" if i < 12 else "Alto Valor") for i in range(20)],
            "cliente_id string, segmento_cluster string"),
        "rules": spark.createDataFrame(RULES, "segmento string, antecedents string, consequents string, lift double"),
    }


def run(data, ref, **kwargs):
    out = season.seasonality(data["orders"], data["segments"], data["items"], data["rules"], ref, **kwargs)
    return {k: v.collect() for k, v in out.items()}


def test_totals_and_labels(data, ref):
    got = run(data, ref, months=12)
    assert sum(r.pedidos for r in got["hora_dia"]) == sum(r.pedidos for r in got["mensual"]) == 100
    assert all(re.fullmatch(r"\d{4}-\d{2}", r["año_mes"]) for r in got["mensual"])
    assert {r.dia_nombre for r in got["hora_dia"] if r.dia_semana == 0} == {"Lunes"}
    assert all(0 <= r.hora <= 23 and 0 <= r.dia_semana <= 6 for r in got["hora_dia"])
    # A rule is counted over all segments, so both segments of CAMARA see the same 50 orders.
    assert sum(r.pedidos for r in got["bundles"]) == 150
    assert {(r.segmento_regla, r.regla) for r in got["bundles"]} == {(s, f"{a} → {c}") for s, a, c, _ in RULES}


def test_top_rule_per_segment_and_no_rules(data, ref):
    got = run(data, ref, top_bundles=1)["bundles"]
    assert {(r.segmento_regla, r.regla) for r in got} == {("MVPs", "CAMARA → DISCO"), ("Alto Valor", "CAMARA → DISCO")}
    none = season.seasonality(data["orders"], data["segments"], data["items"], data["rules"].limit(0), ref)
    assert none["bundles"].count() == 0 and "revenue" in none["bundles"].columns


def test_local_time(spark):
    # 05:30 UTC on Monday 2026-01-05 is still Sunday 23:30 in Mexico City.
    moment = datetime(2026, 1, 5, 5, 30, tzinfo=timezone.utc)
    orders = spark.createDataFrame([("o", "c", moment, 1.0)], "order_id string, cliente_id string, fecha timestamp, pago_total double")
    row = season.orders_in_window(orders, moment).first()
    assert (row.dia_nombre, row.dia_semana, row.hora, row["año_mes"]) == ("Domingo", 6, 23, "2026-01")


def test_daily_window(spark):
    ref = datetime(2026, 6, 9, 12, tzinfo=timezone.utc)
    days = [("a", "C1", 6, 8), ("b", "C1", 2, 1), ("c", "C2", 6, 1)]
    orders = spark.createDataFrame(
        [(o, c, datetime(2026, m, d, 12, tzinfo=timezone.utc), 10.0) for o, c, m, d in days],
        "order_id string, cliente_id string, fecha timestamp, pago_total double")
    segments = spark.createDataFrame([("C1", "MVPs"), ("C2", "Alto Valor")], "cliente_id string, segmento_cluster string")
    rows = season.daily(orders, segments, ref).collect()
    assert [(r.fecha_dia, r.segmento) for r in rows] == [(date(2026, 6, 1), "Alto Valor"), (date(2026, 6, 8), "MVPs")]


def test_shares_sum_to_one(data, ref):
    shares = when.hour_weekday_share(season.hour_by_weekday(season.orders_in_window(data["orders"], ref), data["segments"]))
    for marginal, size in ((when.share_by_hour(shares), 24), (when.share_by_weekday(shares), 7)):
        rows = marginal.collect()
        assert len(rows) == 2 * size
        assert sum(r.pct for r in rows if r.segmento == "MVPs") == pytest.approx(100)
    assert {r.segmento for r in when.hour_weekday_share(
        season.hour_by_weekday(season.orders_in_window(data["orders"], ref), data["segments"]), "MVPs").collect()} == {"MVPs"}


DAYS = [("MVPs", date(2026, 3, 30), 4), ("MVPs", date(2026, 2, 28), 2), ("MVPs", date(2026, 2, 10), 3),
        ("Alto Valor", date(2026, 3, 1), 5), ("Hibernando", date(2026, 2, 1), 7)]


def test_month_against_month(spark):
    daily = spark.createDataFrame([(d, s, n, 1.0) for s, d, n in DAYS], "fecha_dia date, segmento string, pedidos bigint, revenue double")
    as_of = "2026-03-31"
    assert {r.fecha_dia for r in when.current_month(daily, as_of).collect()} == {"2026-03-30", "2026-03-01"}
    # The 31st falls back to the last day of February.
    assert when.previous_month_same_days(daily, as_of).count() == 3
    change = {r.segmento: (r.pedidos_actual, r.pedidos_anterior, r.variacion_pct) for r in when.monthly_change(daily, as_of).collect()}
    assert change == {"MVPs": (4, 5, -20.0), "Alto Valor": (5, 0, None), "Hibernando": (0, 7, -100.0)}
    assert tuple(when.total_change(daily, as_of).first()) == (9, 12, -25.0)
    assert when.aligned_months(daily, as_of).count() == 5
    # A month without orders yet still shows the one before.
    assert when.aligned_months(daily, "2026-04-15").where("pedidos_actual IS NULL").count() == 1


def test_bundle_series(spark):
    monthly = spark.createDataFrame(
        [("r1", "MVPs", "2026-01", 2, 10.0), ("r1", "MVPs", "2026-02", 6, 30.0), ("r2", "MVPs", "2026-01", 1, 99.0)],
        "regla string, segmento_regla string, `año_mes` string, pedidos bigint, revenue double")
    assert [r.regla for r in rules.bundles_over_time(monthly, "MVPs", 1).collect()] == ["r2"]
    peak = rules.peak_month(monthly, "MVPs").first()
    assert (peak.regla, peak.mes_pico, peak.pct_concentracion) == ("r1", "2026-02", 0.75)
    assert rules.active_bundles(monthly, "MVPs", 1).first().regla == "r2"
    with pytest.raises(ValueError, match="top_n"):
        rules.bundles_over_time(monthly, "MVPs", 31)
