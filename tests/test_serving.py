import random
from itertools import combinations

import pytest

from order_rows import ago
from custscope.operators import serve_customer as customer
from custscope.operators import serve_moves as moves
from custscope.operators import serve_rules as rules
from custscope.operators import serve_segments as segs
from custscope.sources import tables
from custscope.testbed import catalog as c
from custscope.testbed import mapping as m

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    return c.segments(spark, DATA).cache()


def test_segment_figures_add_up(scored):
    total = segs.global_kpis(scored).first()
    shares = segs.customers_per_segment(scored).collect()
    assert sum(r.n_clientes for r in shares) == total.n_clientes
    assert sum(r.pct for r in shares) == pytest.approx(1)
    assert sum(r.revenue for r in segs.revenue_per_segment(scored).collect()) == pytest.approx(total.revenue_total)
    assert segs.segment_metrics(scored, "Nadie").count() == 0


def test_alerts(scored):
    rows = segs.urgent_customers(scored).collect()
    assert rows and {r.segmento for r in rows} <= {"MVPs", "Alto Valor"}
    assert all(r.ratio > 1.5 for r in rows)
    assert segs.urgent_kpis(scored).first().n_total == len(rows)
    assert [r.monetary for r in rows] == sorted((r.monetary for r in rows), reverse=True)
    assert segs.reactivation_kpis(scored).first().n_total == segs.reactivation_customers(scored).count()


def test_radar_is_between_zero_and_one(scored):
    rows = segs.radar(scored).collect()
    for f in ("recency", "frequency", "monetary", "cadencia"):
        assert min(r[f] for r in rows) == 0 and max(r[f] for r in rows) == 1


def test_movements(scored):
    frontier = moves.frontier_customers(scored)
    assert all(r.razon_distancias >= 0.7 for r in frontier.collect())
    past = tables.snapshot_rows(scored, m.SNAPSHOT_AS_OF)
    assert moves.changed_since(scored, past, m.AS_OF).count() == 0
    kpis = moves.movement_kpis(frontier, moves.changed_since(scored, past, m.AS_OF)).first()
    assert (kpis.n_en_frontera, kpis.n_total_cambios) == (frontier.count(), 0)


@pytest.mark.parametrize("before, after, way", [
    ("Hibernando", "En Riesgo", "subida"), ("Ocasionales", "MVPs", "subida"), ("MVPs", "Alto Valor", "bajada"),
    ("En Riesgo", "Hibernando", "bajada"), ("Otro", "MVPs", "bajada")])
def test_direction(spark, before, after, way):
    now = spark.createDataFrame(
        [("a", after, 0, 1, 1, 1.0, 1.0)],
        "cliente_id string, segmento_cluster string, es_single_buyer int, recency bigint, frequency bigint, monetary double, dias_entre_compras double")
    then = spark.createDataFrame([("a", before)], "cliente_id string, segmento_cluster string")
    assert moves.changed_segment(now, then).first().direccion == way


def test_months_back():
    assert tables.months_back("2026-01-31", 1) == "2025-12"
    assert tables.months_back("2026-03-31", 14) == "2025-01"


def test_parameters_are_checked(spark, scored):
    with pytest.raises(ValueError, match="limit"):
        customer.find_customers(scored, "1", 51)
    with pytest.raises(ValueError, match="empty"):
        customer.find_customers(scored, "")
    with pytest.raises(ValueError, match="mode"):
        rules.bundles_top(scored, scored, None, "todo")


def pair_facts(orders):
    """Per customer: order sets per family, repeated pairs and strong pairs, by enumeration."""
    facts = {}
    for o, cust, fams in orders:
        facts.setdefault(cust, {})[o] = set(fams)
    out = {}
    for cust, own in facts.items():
        holds = {}
        for o, fams in own.items():
            for f in fams:
                holds.setdefault(f, set()).add(o)
        pairs = {(a, b): holds[a] & holds[b] for a, b in combinations(sorted(holds), 2)}
        out[cust] = (own, holds, {p: s for p, s in pairs.items() if len(s) >= 2})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_customer_pairs_equal_brute_force(spark, seed):
    """One customer holds a third of all orders."""
    rng = random.Random(seed)
    orders = []
    for i in range(120):
        cust = "HOT" if i % 3 == 0 else f"C{rng.randrange(8)}"
        orders.append((f"O{i:03d}", cust, rng.sample("ABCDEF", rng.randrange(1, 4))))
    items = spark.createDataFrame(
        [(o, cust, f + "1", f, 1.0, 10.0, ago(1)) for o, cust, fams in orders for f in fams + [fams[0]]],
        "order_id string, cliente_id string, clave string, familia string, cantidad double, subtotal_mxn double, fecha timestamp")
    headers = spark.createDataFrame(
        [(o, cust, ago(i), float(i)) for i, (o, cust, _) in enumerate(orders)],
        "order_id string, cliente_id string, fecha timestamp, pago_total double")
    segments = spark.createDataFrame([("HOT", "MVPs")], "cliente_id string, segmento_cluster string")
    rule = spark.createDataFrame(
        [("MVPs", "B", "A", 0.5, 2.0), ("MVPs", "A", "B, C", 0.9, 9.0)],
        "segmento string, antecedents string, consequents string, confidence double, lift double")
    facts = pair_facts(orders)

    got = customer.own_bundles(items, segments, rule, limit=None).collect()
    want = {(cust, a, b): len(s) for cust, (_, _, pairs) in facts.items() for (a, b), s in pairs.items()}
    assert {(r.cliente_id, r.familia_a, r.familia_b): r.n_ordenes for r in got} == want
    hot = [r for r in got if (r.cliente_id, r.familia_a, r.familia_b) == ("HOT", "A", "B")]
    assert all((r.confidence_segmento, r.lift_segmento) == (0.5, 2.0) for r in hot)
    assert all(r.pct_aparicion == r.n_ordenes / len(facts[r.cliente_id][0]) for r in got)

    missed = customer.missed_opportunities(items, headers, limit=None).collect()
    expected = set()
    for cust, (own, holds, pairs) in facts.items():
        for (a, b), s in pairs.items():
            if len(s) / min(len(holds[a]), len(holds[b])) >= 0.30:
                for o, fams in own.items():
                    if (a in fams) != (b in fams):
                        expected.add((cust, o, a, b) if a in fams else (cust, o, b, a))
    assert {(r.cliente_id, r.order_id, r.compro, r.le_falto) for r in missed} == expected
    assert len(missed) == len(expected)
    top = customer.missed_opportunities(items, headers, "HOT", 3).collect()
    assert [r.pago_total for r in top] == sorted((r.pago_total for r in missed if r.cliente_id == "HOT"), reverse=True)[:3]
    assert customer.top_products(items, "HOT", 2).count() == 2


def test_position_and_unknown_customer(scored):
    row = scored.first()
    rows = customer.position_in_segment(scored, row.cliente_id).collect()
    assert sum(r.es_objetivo for r in rows) == 1
    assert customer.position_in_segment(scored, "nadie").count() == 0
