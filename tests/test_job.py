import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from custscope.operators import season
from custscope.operators.quality import QualityCheckFailed
from custscope.plans import job, views
from custscope.plans.ingest import last_versions, split_documents
from custscope.schema import SNAPSHOT_COLUMNS
from custscope.sources import tables
from custscope.sources.documents import OTHER, OUTSIDE, PENDING, REJECTED, parse_documents
from custscope.streaming import daily as sd
from custscope.streaming import ingest as si
from custscope.testbed import catalog as c
from custscope.testbed import mapping as m

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """One weekly and one monthly run over the documents."""
    root = str(tmp_path_factory.mktemp("store"))
    docs = c.parsed(spark, DATA).cache()
    weekly = job.run_pipeline(spark, root, docs, "weekly", m.AS_OF)
    daily = job.run_pipeline(spark, root, docs, "daily", m.AS_OF)
    monthly = job.run_pipeline(spark, root, None, "monthly", m.AS_OF)
    return root, weekly, daily, monthly


def test_modes(spark, store):
    root, weekly, daily, monthly = store
    assert weekly.failure is None and weekly.names("done") == ["ingest", "segmentacion", "mba", "temporalidad"]
    assert daily.failure is None and daily.names("skipped") == ["mba"]
    assert monthly.failure is None and monthly.names("skipped") == ["ingest", "drift_check"]
    assert "snapshot" in monthly.names("done")
    snapshot = spark.read.parquet(tables.table_path(root, job.SNAPSHOTS))
    assert set(snapshot.columns) == {*SNAPSHOT_COLUMNS, "snapshot_month"}
    with pytest.raises(ValueError, match="mode"):
        job.run_pipeline(spark, root, None, "hourly")


def test_failed_check_is_reported(spark, store, monkeypatch):
    monkeypatch.setattr(job.quality, "enforce", lambda check: (_ for _ in ()).throw(QualityCheckFailed("mal")))
    summary = job.run_pipeline(spark, store[0], None, "daily", m.AS_OF)
    assert summary.failure == "QualityCheckFailed: mal"
    assert summary.to_frame(spark).orderBy("orden").collect()[-1].error == summary.failure


def test_views(spark, store):
    root = store[0]
    t = views.Tables.load(spark, root)
    known = t.segmentos.first().cliente_id
    params = {
        "estacionalidad": {"as_of": c.MONTH_DAY}, "ultimo_mes": {"as_of": c.MONTH_DAY},
        "comparador": {"a": "MVPs", "b": "Hibernando"}, "heatmap_bundles": {"segment": "MVPs"},
        "cliente": {"customer_id": known}, "movimientos": {"as_of": m.AS_OF + timedelta(days=31)},
    }
    for name in views.VIEW_BUILDERS:
        members = views.view(name, t, **params.get(name, {}))
        for df in members.values():
            df.count()
    assert len(tables.register_views(spark, root)) == 10
    assert views.view("cliente", t, customer_id=known)["perfil"].count() == 1
    with pytest.raises(views.CustomerNotFound):
        views.view("cliente", t, customer_id="nadie")
    with pytest.raises(ValueError, match="unknown view"):
        views.view("otra", t)
    dates = [r.fecha for r in views.view("cliente", t, customer_id=known)["pedidos"].collect()]
    assert dates == sorted(dates) and all(re.match(r"\d{4}-\d{2}-\d{2} ", d) for d in dates)


def test_stream_ingest_equals_batch(spark, tmp_path, store):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    parts = m.documents(spark, DATA).repartition(3)
    parts.write.text(str(folder))
    for _ in range(2):  # the second start finds nothing new
        si.start_ingest(si.document_stream(spark, str(folder), 1), root, str(tmp_path / "cp")).awaitTermination()
    columns = ["order_id", "cliente_id", "fecha", "pago_total", "num_productos"]
    for name, cols in (("orders", columns), ("items", ["order_id", "clave"])):
        got, want = (
            sorted(tables.load_table(spark, r, tables.VIEWS[name]).select(*cols).collect(), key=str) for r in (root, store[0]))
        assert got == want
    # An order older than everything loaded so far is still taken.
    late = json.dumps({
        "_id": "late", "estatus": {"Facturado": "x"}, "pedido": {
            "tipo": "CTonline", "fecha": "1990-01-01T00:00:00Z", "encabezado": {"cliente": "C", "pago": "5"},
            "detalle": {"producto": []}}})
    spark.createDataFrame([(late,)], "value string").write.mode("append").text(str(folder))
    before = tables.stored_row_count(spark, root, tables.VIEWS["orders"])
    si.start_ingest(si.document_stream(spark, str(folder)), root, str(tmp_path / "cp")).awaitTermination()
    assert tables.stored_row_count(spark, root, tables.VIEWS["orders"]) == before + 1


def test_stream_daily_equals_batch(spark, tmp_path):
    """Shuffled files, a third of them 90 days late and one batch that comes twice: every order counts once."""
    events, segments = m.event_orders(spark, DATA), m.event_segments(spark, DATA)
    folder, root, progress = str(tmp_path / "ev"), str(tmp_path / "days"), str(tmp_path / "cp")
    early = F.col("order_id").cast("bigint") % 3 == 0
    events = events.withColumn("fecha", F.when(early, F.col("fecha") - F.expr("INTERVAL 90 DAYS")).otherwise(F.col("fecha")))
    parts = [events.where(~early).repartition(2), events.where(early).repartition(2)]
    parts[1] = parts[1].unionByName(spark.createDataFrame([("x", "1", None, 5.0)], events.schema))
    for part in parts:
        part.write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        sd.start_daily(arriving, segments, root, progress, "60 days").awaitTermination()
    assert sd.merge_batch(spark, root, events, (progress, 0), segments, "60 days") == 0  # published before
    got = {(r.fecha_dia, r.segmento): (r.pedidos, round(r.revenue, 4)) for r in sd.read_daily(spark, root).collect()}
    batch = season.daily(events, segments, m.EVENTS_AS_OF, 400).collect()
    assert got == {(r.fecha_dia, r.segmento): (r.pedidos, round(r.revenue, 4)) for r in batch}
    late = {r.order_id for r in sd.late_orders(spark, root).collect()}
    assert late == {r.order_id for r in events.where(early).collect()} | {"x"} and sd.late_count(spark, root) == len(late) > 100


def test_an_empty_batch_of_days(spark, tmp_path):
    root, none = str(tmp_path), m.event_orders(spark, DATA).where("false")
    assert sd.merge_batch(spark, root, none, ("s", 0), m.event_segments(spark, DATA), "1 day") == 0
    assert sd.read_daily(spark, root).count() == 0 and sd.late_orders(spark, root) is None


def _documents(spark, *rows):
    """Sold documents of (id, time, lines)."""
    texts = [json.dumps({
        "_id": i, "errores": [], "estatus": {"Facturado": "si"},
        "pedido": {"tipo": "CTonline", "fecha": t, "encabezado": {"cliente": "c"}, "detalle": {"producto": [{"clave": k} for k in lines]}},
    }) for i, t, lines in rows]
    return parse_documents(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_a_load_behind_the_mark_reads_no_lines(spark):
    mark = datetime(2024, 1, 2, tzinfo=timezone.utc)
    docs = _documents(spark, ("1", "2024-01-01T00:00:00Z", ["A1"]), ("2", "2024-01-02T00:00:00Z", []))
    detail = F.raise_error(F.lit("lines were read"))
    unread = docs.withColumn("pedido", F.struct(
        F.col("pedido.tipo").alias("tipo"), F.col("pedido.fecha").alias("fecha"), F.col("pedido.encabezado").alias("encabezado"), detail.alias("detalle")))
    pending, rejected, counts = split_documents(unread, mark)
    assert counts == {"read": 2, PENDING: 0, OUTSIDE: 2, OTHER: 0, REJECTED: 0}
    assert pending.columns == docs.columns
    later = docs.unionByName(_documents(spark, ("3", "2024-01-03T00:00:00Z", ["B2", "C3"]), ("4", "n/d", ["D4"])))
    pending, rejected, counts = split_documents(later, mark)
    assert counts == {"read": 4, PENDING: 1, OUTSIDE: 2, OTHER: 0, REJECTED: 1}
    assert [(r["_id"], len(r["pedido"]["detalle"]["producto"])) for r in pending.collect()] == [("3", 2)]
    assert [(r["_id"], r["_motivo"]) for r in rejected.collect()] == [("4", "sin_fecha")]


def test_only_documents_of_repeated_ids_are_compared(spark):
    docs = _documents(spark, ("1", "2024-01-01T00:00:00Z", ["A1"]), ("2", "2024-01-01T00:00:00Z", ["B2"]))
    assert last_versions(docs) is docs
    more = docs.unionByName(_documents(spark, ("2", "2024-01-03T00:00:00Z", ["C3"]), ("2", "2024-01-02T00:00:00Z", ["D4"])))
    got = {r["_id"]: r["pedido"]["detalle"]["producto"][0]["clave"] for r in last_versions(more).collect()}
    assert got == {"1": "A1", "2": "C3"} and last_versions(more).count() == 2
