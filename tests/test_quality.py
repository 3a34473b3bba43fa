import pytest

from custscope.operators import quality as q
from custscope.schema import SEGMENT_ORDER

SCHEMA = (
    "cliente_id string, recency double, frequency double, monetary double, dias_entre_compras double, "
    "es_single_buyer int, cluster_id int, segmento_cluster string")


def healthy():
    return [[f"C{i:04d}", i + 1.0, i + 1.0, (i + 1) * 100.0, i + 5.0, 0, i % 5, SEGMENT_ORDER[i % 5]] for i in range(100)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


@pytest.mark.parametrize("after, before, ok", [(1000, None, True), (1100, 1000, True), (980, 1000, True), (800, 1000, False), (5, 0, True)])
def test_ingest(spark, after, before, ok):
    check = q.check_ingest_counts(spark, after, before)
    if ok:
        q.enforce(check)
    else:
        with pytest.raises(q.QualityCheckFailed, match="destruyó datos"):
            q.enforce(check)


def test_segments(spark):
    q.enforce(q.check_segments(frame(spark, healthy())))
    q.enforce(q.check_distribution(frame(spark, healthy())))


@pytest.mark.parametrize("column, value, text", [(7, None, "sin segmento"), (4, None, "nulos en features"), (6, 99, "fuera de rango")])
def test_broken_segments(spark, column, value, text):
    rows = healthy()
    rows[0][column] = value
    with pytest.raises(q.QualityCheckFailed, match=text):
        q.enforce(q.check_segments(frame(spark, rows)))


def test_empty_segments(spark):
    with pytest.raises(q.QualityCheckFailed, match="vacío"):
        q.enforce(q.check_segments(frame(spark, [])))


def test_distribution(spark):
    df = spark.createDataFrame([("MVPs" if i < 80 else "Hibernando",) for i in range(100)], "segmento_cluster string")
    with pytest.raises(q.QualityCheckFailed, match="MVPs absorbe 80.0%"):
        q.enforce(q.check_distribution(df))
    q.enforce(q.check_distribution(df, 80))


@pytest.mark.parametrize("monthly, rfm, ok", [([100, 150], 250, True), ([99], 100, True), ([50], 100, False), ([], 100, True), ([5], 0, False)])
def test_cross_check(spark, monthly, rfm, ok):
    months = spark.createDataFrame([(n,) for n in monthly], "pedidos bigint")
    check = q.check_monthly(months, spark.createDataFrame([(rfm,)], "frequency bigint"))
    if ok:
        q.enforce(check)
    else:
        with pytest.raises(q.QualityCheckFailed, match="Inconsistencia|frequency es 0"):
            q.enforce(check)


@pytest.mark.parametrize("rows, text", [([], "vacío"), ([("MVPs", 50)], "50 pedidos"), ([("MVPs", 90), ("Alto Valor", 90)], "2 segmentos")])
def test_daily(spark, rows, text):
    df = spark.createDataFrame(rows, "segmento string, pedidos bigint")
    with pytest.raises(q.QualityCheckFailed, match=text):
        q.enforce(q.check_daily(df))
    good = spark.createDataFrame([(s, 40) for s in SEGMENT_ORDER], "segmento string, pedidos bigint")
    q.enforce(q.check_daily(good))


def test_drift(spark):
    now = spark.createDataFrame([("a", "MVPs"), ("b", "MVPs"), ("c", "Hibernando")], "cliente_id string, segmento_cluster string")
    then = spark.createDataFrame([("a", "MVPs"), ("b", "Ocasionales"), ("z", "MVPs")], "cliente_id string, segmento_cluster string")
    row = q.drift_agreement(now, then).first()
    assert (row.n_comunes, row.coincidencia, row.alerta) == (2, 0.5, True)
    points = {r.segmento: round(r.cambio_pp, 6) for r in q.drift_points(now, then).collect()}
    assert points == {"MVPs": 0.0, "Hibernando": 33.333333, "Ocasionales": -33.333333}


def test_revenue(spark):
    items = spark.createDataFrame([("a", 60.0), ("a", 42.0), ("b", 1.0)], "cliente_id string, subtotal_mxn double")
    segments = spark.createDataFrame([("a", 100.0), ("b", 2.0)], "cliente_id string, monetary double")
    assert {r.cliente_id: r.ok for r in q.revenue_reconciliation(items, segments).collect()} == {"a": True, "b": False}


def test_checks_of_a_write_agree_with_checks_of_the_table(spark, tmp_path):
    names = ["MVPs", "En Riesgo"]
    rows = healthy()
    for name, broken in (("ok", rows), ("alone", [(r[0], *r[1:]) for r in rows[:1]]), ("empty", [])):
        df = frame(spark, broken)
        observed, seen = q.observe_segments(df, sorted({r.segmento_cluster for r in df.collect()} | set(names)))
        observed.write.parquet(str(tmp_path / name))
        own = q.check_observed_segments(spark, seen.get, sorted({r.segmento_cluster for r in df.collect()} | set(names)))
        for mine, theirs in zip(own, (q.check_segments(df), q.check_distribution(df)), strict=True):
            assert mine.select(theirs.columns).first() == theirs.first()
