import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from custscope.operators import basket
from custscope.schema import RULES


def lines(spark, orders):
    """(order_id, cliente_id, families) as item rows."""
    return spark.createDataFrame(
        [(o, c, f, f) for o, c, fams in orders for f in fams],
        "order_id string, cliente_id string, clave string, familia string")


@pytest.fixture(scope="module")
def planted(spark):
    noise = [["CABLE", "ADAPTADOR"], ["CARGADOR", "BATERIA"], ["TECLADO_X", "MOUSE_X"], ["MEMORIA", "DISCOX"],
             ["IMPRESORA", "TINTA"], ["MONITOR_X", "HDMI"], ["AUDIFONO", "MICROFONO"], ["WEBCAM", "TRIPODE"]]
    rows, segs = [], {}

    def add(customer, fams, segment):
        rows.append((f"O{len(rows):05d}", customer, fams))
        segs.setdefault(customer, segment)

    def segment(i):
        return "MVPs" if i % 5 < 3 else "Alto Valor"

    for i in range(200):
        add(f"C{i % 50:04d}", ["CAMARA", "DISCO"], segment(i))
    for i in range(1000):
        add(f"C{i % 80 + 100:04d}", noise[i % 8], segment(i))
    for i in range(100):
        add(f"C{i % 30:04d}", ["LAPTOP", "MOUSE"], segment(i))
    for i in range(50):
        add(f"C{i + 3000:04d}", ["TECLADO", "MONITOR"], "Alto Valor")
    return {
        "items": lines(spark, rows),
        "orders": spark.createDataFrame([(o, 1000.0) for o, _, _ in rows], "order_id string, pago_total double"),
        "segments": spark.createDataFrame(list(segs.items()), "cliente_id string, segmento_cluster string"),
    }


@pytest.fixture(scope="module")
def found(planted):
    out = basket.basket_analysis(planted["items"], planted["segments"], planted["orders"])
    return {k: v.collect() for k, v in out.items()}


def test_planted_rules_with_default_thresholds(found):
    pairs = {(r.segmento, frozenset((r.antecedents, r.consequents))) for r in found["por_segmento"]}
    assert ("MVPs", frozenset(("CAMARA", "DISCO"))) in pairs
    assert len(pairs) == len(found["por_segmento"])
    monitors = {s for s, p in pairs if p == frozenset(("TECLADO", "MONITOR"))}
    assert monitors == {"Alto Valor"}


def test_metrics_follow_from_counts(found):
    for r in found["por_segmento"]:
        n = r.n_pedidos_segmento
        assert r.support == r.support_count / n
        assert math.isclose(r.confidence, r.support / r.antecedent_support)
        assert math.isclose(r.lift, r.confidence / r.consequent_support)
        assert r.lift >= 3 and r.confidence >= 0.2
        assert r.tamano_total == r.n_antecedents + r.n_consequents


def test_exclusive_rules_have_one_segment(found):
    seen = {}
    for r in found["por_segmento"]:
        seen.setdefault((r.antecedents, r.consequents), set()).add(r.segmento)
    assert {(r.antecedents, r.consequents) for r in found["exclusivas"]} == {k for k, v in seen.items() if len(v) == 1}


def test_actionable_rules(found):
    assert found["accionables"]
    for r in found["accionables"]:
        assert r.n_antecedents == 1 and r.n_consequents <= 2
        assert r.ticket_medio == r.ticket_mediano == 1000.0
        assert r.revenue_total == 1000.0 * r.n_pedidos > 0


def test_no_rules_keeps_the_schema(spark, planted):
    few = basket.basket_analysis(planted["items"].limit(6), planted["segments"], planted["orders"])
    assert few["por_segmento"].count() == 0
    assert few["por_segmento"].dtypes == basket.empty_rules(spark).dtypes
    assert RULES and set(few["accionables"].columns) >= {"ticket_medio", "revenue_total"}
    with pytest.raises(ValueError, match="familia"):
        basket.basket_analysis(planted["items"].drop("familia"), planted["segments"], planted["orders"])


def brute(baskets, min_count, min_conf, min_lift):
    """Frequent sets and one rule per unordered pair of sides, by enumeration."""
    n = len(baskets)
    items = sorted(set().union(*baskets))
    count = {}
    for k in range(1, len(items) + 1):
        for s in combinations(items, k):
            c = sum(set(s) <= b for b in baskets)
            if c >= min_count:
                count[s] = c
    rules = {}
    for s, c in count.items():
        for k in range(1, len(s)):
            for a in combinations(s, k):
                b = tuple(x for x in s if x not in a)
                confidence, lift = c / count[a], c * n / (count[a] * count[b])
                if confidence >= min_conf and lift >= min_lift:
                    key = frozenset((a, b))
                    best = rules.get(key)
                    if best is None or (-confidence, ", ".join(a)) < (-best[1], ", ".join(best[0])):
                        rules[key] = (a, confidence, lift)
    return count, rules


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sets_and_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = list("ABCDEFG")
    baskets = [frozenset(rng.sample(names, rng.randrange(2, 7))) for _ in range(90)]
    rows = [(f"O{i}", "C", sorted(b)) for i, b in enumerate(baskets)]
    segs = spark.createDataFrame([("C", "MVPs")], "cliente_id string, segmento_cluster string")
    count, rules = brute(baskets, 12, 0.4, 0.9)
    sets = basket.frequent_itemsets(basket.multi_family_baskets(lines(spark, rows), segs), 12, 0.0)
    assert {tuple(r["items"]): r.freq for r in sets.collect()} == count
    got = basket.one_rule_per_pair(sets, 0.4, 0.9).collect()
    assert {(r.antecedents, r.consequents) for r in got} == {
        (", ".join(a), ", ".join(next(iter(k - {a})))) for k, (a, _, _) in rules.items()}
    both = basket.association_rules(sets, 0.4, 0.9)
    assert both.count() >= len(got)
    deepest = max(len(s) for s in count)
    assert deepest >= 3


@pytest.mark.parametrize("seed", [1, 2])
def test_rule_value_equals_brute_force(spark, seed):
    """A third of the orders hold the same family pair, one rule matches nothing."""
    rng = random.Random(seed)
    names = list("ABCDEFGH")
    orders = {f"O{i}": frozenset("AB") if i % 3 == 0 else frozenset(rng.sample(names, rng.randrange(1, 5))) for i in range(150)}
    price = {o: round(rng.uniform(1, 900), 2) for o in orders}
    rules = [("A", "B"), ("B", "C, D"), ("E", "F"), ("A", "Z")]
    frame = spark.createDataFrame(rules, "antecedents string, consequents string")
    items = lines(spark, [(o, "C", sorted(f)) for o, f in orders.items()])
    paid = spark.createDataFrame(list(price.items()), "order_id string, pago_total double")
    got = {(r.antecedents, r.consequents): r for r in basket.rule_value(frame, items, paid).collect()}
    for a, c in rules:
        need = set(a.split(", ")) | set(c.split(", "))
        hit = sorted(price[o] for o, f in orders.items() if need <= f)
        r = got[a, c]
        assert r.n_pedidos == len(hit)
        assert math.isclose(r.revenue_total, sum(hit), abs_tol=1e-6)
        if hit:
            mid = len(hit) // 2
            want = hit[mid] if len(hit) % 2 else (hit[mid - 1] + hit[mid]) / 2
            assert math.isclose(r.ticket_mediano, want) and math.isclose(r.ticket_medio, sum(hit) / len(hit))
        else:
            assert (r.ticket_medio, r.ticket_mediano) == (0.0, 0.0)


def test_quadrants(spark):
    rules = spark.createDataFrame(
        [("a", 0.9, 9.0), ("b", 0.9, 1.0), ("c", 0.1, 9.0), ("d", 0.1, 1.0)], "k string, confidence double, lift double")
    assert [r.cuadrante for r in basket.rule_quadrants(rules).orderBy("k").collect()] == basket.QUADRANTS
    assert basket.quadrant_counts(rules).agg(F.sum("n_reglas")).first()[0] == 4


def test_a_planted_long_set_is_not_split_further_than_it_passes(spark, monkeypatch):
    """14 families in 2^14 frequent sets: where two consequents cannot pass, none of the 2^13 splits of the long set is built."""
    names = [f"f{i:02d}" for i in range(14)]
    rows = []
    for mask in range(1, 1 << 14):
        own = [x for i, x in enumerate(names) if mask >> i & 1]
        rows.append(("s", own, 30 if len(own) == 14 else 40 * 3 ** (13 - len(own)), 10**9))
    sets = basket.stage(spark.createDataFrame(rows, basket._ITEMSETS), "sets")
    counts, real = {}, basket.stage

    def counting(df, name, *more):
        table = real(df, name, *more)
        counts.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(basket, "stage", counting)
    got = {(r.antecedents, r.consequents): r.support_count for r in basket.association_rules(sets, 0.5, 0.0).collect()}
    assert got == {(", ".join(x for x in names if x != y), y): 30 for y in names}
    assert counts["rule-level"] == [14, 0]  # of 91 consequents of two none passes, and longer ones are not built


@pytest.mark.parametrize("parts", ["4", "32"])
def test_rules_of_a_hot_family_are_matched_in_parts(spark, monkeypatch, parts):
    """One family is in every order: rules that only hold it are dealt by order, all others by their rarest family."""
    rng = random.Random(3)
    orders = {f"o{i}": {"hot", *rng.sample([f"f{j}" for j in range(30)], rng.randint(0, 4))} for i in range(600)}
    lines = spark.createDataFrame([(o, f) for o, fams in orders.items() for f in fams], "order_id string, familia string")
    pairs = [("hot", "f1"), ("f1, f2", "hot"), ("f3", "f4"), ("hot", "none"), ("f5, f6", "f7"), ("hot", "hot")]
    rules = spark.createDataFrame(pairs, "antecedents string, consequents string")
    spread, real = [], basket.stage
    monkeypatch.setattr(basket, "stage", lambda df, name, *more: spread.append((name, real(df, name, *more))) or spread[-1][1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(tuple(r) for r in basket.orders_matching(rules, lines).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted((a, b, o) for a, b in pairs for o, fams in orders.items() if set(f"{a}, {b}".split(", ")) <= fams)
    assert got == want
    dealt = {r.antecedents + r.consequents: (r._anchor, r._parts) for r in dict(spread)["anchors"].collect()}
    assert dealt["hotf1"][0] == "f1" and dealt["hotnone"] == ("none", 1)
    anchor, cut = dealt["hothot"]
    share = sum(len(f & {"hot", *(f"f{j}" for j in range(1, 8))}) for f in orders.values()) // (4 * int(parts))
    assert anchor == "hot" and cut == -(-600 // share)


def test_equal_baskets_are_mined_as_one_row(spark, monkeypatch):
    kinds = [["A", "B", "C"], ["A", "B"], ["B", "C", "D"]]
    rows = [(f"O{i}", "C", "MVPs", kinds[i % 3]) for i in range(900)]
    frame = spark.createDataFrame(rows, "order_id string, cliente_id string, segmento string, familias array<string>")
    written = []

    def counted(df, name, *more):
        out = stage(df, name, *more)
        written.append(out.count())
        return out

    stage = basket.stage
    monkeypatch.setattr(basket, "stage", counted)
    found = {tuple(r["items"]): (r.freq, r.n_pedidos) for r in basket.frequent_itemsets(frame, 10, 0.0).collect()}
    assert {k: v[0] for k, v in found.items()} == brute([frozenset(kinds[i % 3]) for i in range(900)], 10, 0, 0)[0]
    assert {v[1] for v in found.values()} == {900}
    assert max(written) <= 11, "tables grow with the kinds of baskets and the item sets, not with the baskets"
    with pytest.raises(ValueError, match="twice"):
        basket.frequent_itemsets(frame.limit(1).withColumn("familias", F.array(F.lit("A"), F.lit("A"))), 1, 0.0)


def test_orders_with_equal_lists_are_matched_once(spark, monkeypatch):
    """400 orders of two kinds: rules meet two lists, and a rule's money is that of all its orders."""
    orders = [(f"O{i}", ["A", "B", "Z"] if i % 4 else ["A", "B", "C"], float(i)) for i in range(400)]
    items = spark.createDataFrame([(o, f) for o, fams, _ in orders for f in fams], "order_id string, familia string")
    paid = spark.createDataFrame([(o, p) for o, _, p in orders], "order_id string, pago_total double")
    rules = spark.createDataFrame([("A", "B"), ("A", "C"), ("C", "D")], "antecedents string, consequents string")
    sizes, stage = {}, basket.stage

    def counted(df, name, *more):
        out = stage(df, name, *more)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(basket, "stage", counted)
    got = {(r.antecedents, r.consequents): (r.n_pedidos, r.ticket_mediano, r.revenue_total) for r in basket.rule_value(rules, items, paid).collect()}
    some = [p for _, fams, p in orders if "C" in fams]
    assert got == {("A", "B"): (400, 199.5, sum(range(400))), ("A", "C"): (100, 198.0, sum(some)), ("C", "D"): (0, 0.0, 0.0)}
    assert sizes["rule-baskets"] == 2 and sizes["matched-lists"] == 3
