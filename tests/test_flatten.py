import json
from datetime import datetime, timezone

import pytest

from custscope.operators import flatten
from custscope.plans.ingest import run_ingest
from custscope.sources import documents as docs
from custscope.sources import tables, versions


def doc(i, fecha, status=("Facturado",), products=(), tipo="CTonline", errors=None, pago="100.5", tc="18"):
    body = {"_id": i, "estatus": {s: "x" for s in status}, "pedido": {
        "tipo": tipo, "fecha": fecha, "encabezado": {
            "cliente": "C1", "nombre": "Uno", "pago": pago, "tipodecambio": tc, "iva": "16", "plazo": "30",
            "tipoPago": "credito"},
        "detalle": {"producto": [dict(p) for p in products]}}}
    if errors is not None:
        body["errores"] = errors
    return body


LINE = {"clave": "PAQLOC010", "cantidad": "2", "precioFinal": "50", "moneda": "MXN", "promocion_id": "7", "promocion_tipo": "x"}
DOCS = [
    doc("1", "2026-01-01T10:00:00Z", products=[LINE, {**LINE, "clave": "CARGO100"}, {**LINE, "clave": None}]),
    doc("2", "2026-01-02T23:59:59Z", status=("Facturado", "Rechazado"), products=[LINE]),
    doc("3", "2026-01-03T00:00:00Z", status=(), products=[LINE]),
    doc("4", "2026-01-03T00:00:00Z", products=[{**LINE, "moneda": "USD", "cantidad": "dos"}, {**LINE, "moneda": "USD"}]),
    doc("5", "2026-01-04T00:00:00Z", products=[LINE], tipo="Mostrador"),
    doc("6", "2026-01-05T12:00:00Z", products=[], errors=["e"], pago="gratis"),
]


@pytest.fixture
def source(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join(json.dumps(d) for d in DOCS), "utf-8")
    return docs.read_documents(spark, str(tmp_path / "d.json"))


def ids(df):
    return sorted(r["_id"] for r in df.select("_id").collect())


def test_range_scan(source):
    assert ids(docs.scan_range(source, "2026-01-01", "2026-01-05")) == ["1", "4", "6"]
    assert ids(docs.scan_range(source, "2026-01-02", "2026-01-03")) == ["4"]


def test_incremental_scan_is_exclusive_at_the_mark(source):
    mark, end = datetime(2026, 1, 3, tzinfo=timezone.utc), datetime(2026, 1, 5, 12, tzinfo=timezone.utc)
    assert ids(docs.scan_incremental(source, mark, end)) == ["6"]
    assert ids(docs.scan_incremental(source, None, end)) == ["1", "4", "6"]
    assert docs.pending_count(source, mark, end).first()[0] == 1


def test_sample_keeps_documents_without_invoice(source):
    assert ids(docs.quick_sample(source, 10)) == ["1", "3", "4", "6"]
    assert docs.quick_sample(source, 2).count() == 2


def test_flatten(source):
    rows = {r.order_id: r for r in flatten.flatten_orders(source).collect()}
    assert (rows["1"].num_productos, rows["1"].pago_total, rows["1"].iva_aplicado) == (1, 100.5, 16.0)
    assert rows["6"].tiene_errores and not rows["1"].tiene_errores
    assert rows["6"].pago_total is None and rows["6"].num_productos == 0
    items = flatten.enrich_items(flatten.explode_items(source)).collect()
    assert len(items) == 8 and "6" not in {r.order_id for r in items}
    usd = sorted(((r.cantidad, r.precio_mxn, r.subtotal_mxn) for r in items if r.order_id == "4"), key=str)
    assert usd == [(2.0, 900.0, 1800.0), (None, 900.0, None)]
    assert {(r.promocion_id, r.promocion_tipo) for r in items} == {(7, None)}


@pytest.mark.parametrize("sku, family", [
    ("PAQLOC010", "PAQLOC"), ("MEMKGN3200", "MEMKGN"), ("CAMDAH", "CAMDAH"), ("CJNNTE3", "CJNNTE"),
    ("CAMDAH2MP", "CAMDAHMP"), ("", ""), ("12345", ""), (None, None)])
def test_family(spark, sku, family):
    df = spark.createDataFrame([(sku, "stale")], "clave string, familia string")
    assert flatten.add_family(df).first().familia == family


def test_family_needs_the_sku_and_counts(spark):
    with pytest.raises(ValueError, match="clave"):
        flatten.add_family(spark.createDataFrame([("x",)], "otra string"))
    df = flatten.add_family(spark.createDataFrame([("A1",), ("A2",), ("B",), (None,)], "clave string"))
    assert tuple(flatten.family_stats(df).first()) == (2, 1, 4)


def test_non_product_filters(spark):
    df = spark.createDataFrame([("A",), ("CARGO100",), (None,)], "clave string")
    assert flatten.drop_non_products(df).count() == 2
    assert flatten.drop_non_products(df, []).count() == 3
    assert flatten.known_products(df).count() == 1


def history(spark, root):
    orders = {r.order_id: r for r in tables.load_table(spark, root, tables.VIEWS["orders"]).collect()}
    return orders, tables.load_table(spark, root, tables.VIEWS["items"]).collect()


def test_ingest_runs(spark, source, tmp_path):
    root = str(tmp_path / "store")
    first = run_ingest(spark, root, source, datetime(2026, 1, 4, tzinfo=timezone.utc))
    assert (first.orders.n_new, first.items.n_new, first.marks[0]) == (2, 5, None)
    # The two lines of one SKU in order 4 merge into the last one.
    orders, items = history(spark, root)
    assert first.items.n_total == len(items) == 4
    assert [r.cantidad for r in items if r.order_id == "4"] == [2.0]
    second = run_ingest(spark, root, source, datetime(2026, 2, 1, tzinfo=timezone.utc))
    assert (second.orders.n_new, second.orders.n_total, second.empty) == (1, 3, False)
    third = run_ingest(spark, root, source, datetime(2026, 2, 1, tzinfo=timezone.utc))
    assert third.empty and third.marks[1] == second.marks[1] == datetime(2026, 1, 5, 12, tzinfo=timezone.utc)


def merge(spark, root, rows, schema, keys=("order_id",), position="p"):
    version = versions.Version(spark, root)
    result, changes = tables.upsert(version, "t", spark.createDataFrame(rows, schema), list(keys), position)
    changes = sorted((r.order_id, str(r.mes), r.signo) for r in changes.collect())
    version.publish()
    return result, changes


def test_upsert_moves_a_row_to_another_month(spark, tmp_path):
    root = str(tmp_path)
    schema = "order_id string, fecha timestamp, pago_total double, p bigint"
    day = lambda m: datetime(2026, m, 5, tzinfo=timezone.utc)
    merge(spark, root, [("a", day(1), 1.0, 0), ("b", day(2), 2.0, 0)], schema)
    result, changes = merge(spark, root, [("a", day(3), 9.0, 0), ("c", day(3), 3.0, 0)], schema)
    rows = {r.order_id: (r.pago_total, r.mes) for r in tables.load_table(spark, root, "t").collect()}
    assert rows == {"a": (9.0, "2026-03"), "b": (2.0, "2026-02"), "c": (3.0, "2026-03")}
    assert (result.n_new, result.n_total, result.n_duplicates) == (2, 3, 1)
    assert changes == [("a", "2026-01", -1), ("a", "2026-03", 1), ("c", "2026-03", 1)]
    stored = versions.manifest(spark, root).tables["t"]
    assert sorted(stored.parts) == ["2026-02", "2026-03"] and stored.rows == 3
    with pytest.raises(ValueError, match="falta"):
        merge(spark, root, [("a", day(1), 1.0, 0)], schema, ["falta"])


def test_keep_last_with_a_hot_key(spark):
    """A third of the rows are copies of one key; NULL keys are equal to each other."""
    rows = [("hot", i) for i in range(300)] + [(f"k{i % 200}", i) for i in range(500)] + [(None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, n bigint")
    want = {}
    for k, n in rows:
        want[k] = max(n, want.get(k, -1))
    assert {r.k: r.n for r in tables.keep_last(df, ["k"], ["n"]).collect()} == want


def test_views_and_counts(spark, tmp_path):
    root = str(tmp_path)
    assert tables.register_views(spark, root) == []
    tables.save_table(spark.range(3).withColumnRenamed("id", "order_id"), root, tables.VIEWS["orders"])
    assert tables.register_views(spark, root) == ["orders"]
    assert spark.sql("SELECT count(*) FROM orders").first()[0] == 3
    assert tables.stored_row_count(spark, root, "nada") is None
    assert tables.stored_high_water_mark(spark, root) is None


def test_lenient_casts_of_odd_numbers(spark):
    from pyspark.sql import functions as F

    from custscope.operators.flatten import lenient_double, lenient_long

    texts = ["3.0", "1e3", " 7 ", "NaN", "1.5d", "x", "", "2.5", "9007199254740993"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").orderBy("i")
    got = rows.select(lenient_double(F.col("t")).alias("d"), lenient_long(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [3, 1000, 7, None, None, None, None, None, 9007199254740993, None]
    assert [r.d for r in got] == [3.0, 1000.0, 7.0, None, None, None, None, 2.5, 9007199254740992.0, None]


def test_extended_json_dates_ids_and_numbers(spark, tmp_path):
    forms = [
        doc({"$oid": "a"}, {"$date": "2026-01-01T10:00:00Z"}, products=[{**LINE, "promocion_id": {"$numberLong": "3"}}]),
        doc({"$oid": "b"}, {"$date": 1767261600000}, pago={"$numberDouble": "2.5"}, products=[{**LINE, "promocion_id": 3.0}]),
        doc("c", {"$date": {"$numberLong": "1767261600000"}}, pago="NaN", products=[LINE]),
        doc("d", "2026-01-01T10:00:00Z", products=[LINE]),
        doc("e", "ayer", products=[LINE]),
    ]
    (tmp_path / "d.json").write_text("\n".join(json.dumps(d) for d in forms), "utf-8")
    source = docs.read_documents(spark, str(tmp_path / "d.json"))
    orders = {r.order_id: r for r in flatten.flatten_orders(docs.scan_range(source, "2026-01-01", "2026-01-01"))
              .selectExpr("order_id", "unix_seconds(fecha) AS t", "pago_total").collect()}
    assert sorted(orders) == ["a", "b", "c", "d"]
    assert {r.t for r in orders.values()} == {1767261600}
    assert (orders["b"].pago_total, orders["c"].pago_total) == (2.5, None)
    lines = flatten.explode_items(source).where("order_id IN ('a', 'b')").collect()
    assert [r.promocion_id for r in lines] == [3, 3]

    root = str(tmp_path / "lake")
    run_ingest(spark, root, source, datetime(2026, 2, 1, tzinfo=timezone.utc))
    rejects = tables.load_table(spark, root, "rechazados").collect()
    assert [(r.order_id, r.motivo, r.carga) for r in rejects] == [("e", "sin_fecha", "1")]
    assert tables.load_table(spark, root, "orders_historicos").count() == 4


def test_equal_positions_do_not_depend_on_row_order(spark):
    versions = [("a", 0, 1.0), ("a", 0, 2.0)]
    for found in (versions, versions[::-1]):
        kept = tables.keep_last(spark.createDataFrame(found, "k string, p int, v double"), ["k"], ["p"]).collect()
        assert [r.v for r in kept] == [2.0]


def test_keep_last_moves_each_value_once(spark):
    """Keys, sequence and other values go through the shuffle once per row, and come back in the columns' order."""
    df = spark.createDataFrame([("a", 2.0, 1, None), ("a", 1.0, 2, "x"), (None, 3.0, 1, "y")], "k string, payload double, n int, t string")
    kept = tables.keep_last(df, ["k"], ["n"])
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([("a", 1.0, 2, "x"), (None, 3.0, 1, "y")], key=str)
    aggregate = next(x for x in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
    assert aggregate.count("payload#") == 1, aggregate
