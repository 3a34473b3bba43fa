"""Loads that stop anywhere, rejects, accounts and the totals kept by changes."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from custscope.operators import season
from custscope.plans import ingest, totals
from custscope.sources import documents as docs
from custscope.sources import files, staging, tables, versions
from custscope.streaming import ingest as si

UNTIL = datetime(2026, 12, 1, tzinfo=timezone.utc)


def order(key, day, pay=10.0, skus=("A1",), **more):
    time = (datetime(2026, 1, 1) + timedelta(days=day, minutes=7 * day)).strftime("%Y-%m-%dT%H:%M:%SZ")
    doc = {"_id": key, "estatus": {"Facturado": "x"}, "pedido": {
        "tipo": "CTonline", "fecha": time, "encabezado": {"cliente": f"C{len(key) % 3}", "pago": pay},
        "detalle": {"producto": [{"clave": s, "cantidad": 1, "precioFinal": 2} for s in skus]}}}
    doc["pedido"].update(more)
    return json.dumps(doc)


def parsed(spark, *texts):
    return docs.parse_documents(spark.createDataFrame([(t,) for t in texts], "value string"))


def state(spark, root):
    """Orders and lines as a reader sees them."""
    of = versions.manifest(spark, root)
    orders = versions.read(spark, root, tables.VIEWS["orders"], of)
    items = versions.read(spark, root, tables.VIEWS["items"], of)
    if orders is None:
        return None
    return (
        {r.order_id: r.pago_total for r in orders.collect()}, sorted((r.order_id, r.clave) for r in items.collect()))


def test_a_load_that_stops_anywhere_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    first = parsed(spark, order("a", 1), order("bb", 40, skus=("A1", "B2")))
    ingest.run_ingest(spark, root, first, UNTIL)
    old = state(spark, root)
    assert old == ({"a": 10.0, "bb": 10.0}, [("a", "A1"), ("bb", "A1"), ("bb", "B2")])
    # Two overlapping deliveries: an order moves to another month and gets new lines, one is corrected, one is new.
    second = parsed(spark, order("a", 75, 3.0, ("A1", "C3")), order("bb", 76, 4.0, ("B2",)), order("new", 77), "{cut")
    reads = []

    def stopping_at(step):
        calls = []

        def before(real):
            def run(*a, **k):
                calls.append(1)
                if len(calls) == step:
                    raise RuntimeError("stopped")
                out = real(*a, **k)
                reads.append(state(spark, root))
                return out
            return run

        with monkeypatch.context() as patch:
            for owner, name in ((versions.Version, "replace"), (versions.files, "write_text"), (versions.files, "rename_new")):
                patch.setattr(owner, name, before(getattr(owner, name)))
            try:
                ingest.run_ingest(spark, root, second, UNTIL)
            except RuntimeError:
                return True
        return False

    step = 1
    while stopping_at(step):
        assert state(spark, root) == old, step
        step += 1
    new = ({"a": 3.0, "bb": 4.0, "new": 10.0}, [("a", "A1"), ("a", "C3"), ("bb", "A1"), ("bb", "B2"), ("new", "A1")])
    assert step > 6 and state(spark, root) == new
    assert reads[-1] == new and all(r == old for r in reads[:-1])
    gone = versions.vacuum(spark, root, keep=1)
    assert len(gone) > step and state(spark, root) == new


def test_a_reader_keeps_its_version_and_two_loads_do_not_mix(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, mes string")
    one = versions.Version(spark, root)
    one.replace("t", rows((1, "x"), (2, "y")), "mes", [])
    one.publish(nota=1)
    reader = versions.read(spark, root, "t")
    two, late = versions.Version(spark, root), versions.Version(spark, root)
    for v in (two, late):
        v.replace("t", rows((3, "y")), "mes", ["x", "y"])
    two.publish()
    with pytest.raises(versions.Overtaken):
        late.publish()
    assert sorted(map(tuple, reader.collect())) == [(1, "x"), (2, "y")]
    assert list(map(tuple, versions.read(spark, root, "t").collect())) == [(3, "y")]
    assert versions.manifest(spark, root).notes == {"nota": 1} and versions.published(spark, root) == [1, 2]
    assert versions.read(spark, root, "t", parts=["z"]).count() == 0 and versions.read(spark, root, "u") is None
    empty = versions.Version(spark, root)
    empty.replace("t", rows((1, "x")).where("k > 1"), "mes", ["y"])
    empty.publish()
    assert versions.read(spark, root, "t").count() == 0 and tables.stored_row_count(spark, root, "t") == 0


ODD = [
    order("ok", 1), order("single", 2).replace('[{', '{').replace('}]', '}'), order("cancel", 3).replace('"Facturado"', '"Cancelado"'),
    order("undated", 4, fecha="ayer"), order("cut", 5)[:-9], "[1, 2]", f"[{order('list', 1)}]", "null", "palabras", '"x"', "7",
    order("", 6).replace('"_id": "", ', ""), order("shape", 7).replace('"tipo": "CTonline"', '"tipo": "CTonline", "encabezado": 3'), "  ",
]


def test_every_document_is_accounted_for(spark, tmp_path):
    folder, root, progress = tmp_path / "in", str(tmp_path / "lake"), str(tmp_path / "cp")
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(ODD), "utf-8")
    load = ingest.run_ingest(spark, root, docs.read_documents(spark, str(folder)), UNTIL)
    assert load.accounts == ingest.Accounts(13, 2, 0, 1, 10, 10) and load.accounts.complete
    lines = tables.load_table(spark, root, tables.VIEWS["items"]).collect()
    assert sorted((r.order_id, r.clave) for r in lines) == [("ok", "A1"), ("single", "A1")]
    why = {r.documento: r.motivo for r in tables.load_table(spark, root, ingest.REJECTS).collect()}
    assert sorted(why.values()) == ["json"] * 8 + ["sin_fecha", "sin_id"] and why["[1, 2]"] == "json"
    # The same source again: nothing new, and no reject twice.
    again = ingest.run_ingest(spark, root, docs.read_documents(spark, str(folder)), UNTIL)
    assert again.empty and again.accounts == ingest.Accounts(13, 0, 2, 1, 10, 0) and again.accounts.complete
    (folder / "b.json").write_text("\n".join([order("later", 30), "{", ODD[3]]), "utf-8")
    third = ingest.run_ingest(spark, root, docs.read_documents(spark, str(folder)), UNTIL)
    assert third.accounts == ingest.Accounts(16, 1, 2, 1, 12, 1)
    rejects = tables.load_table(spark, root, ingest.REJECTS).groupBy("carga").count().collect()
    assert {r.carga: r["count"] for r in rejects} == {"1": 10, "2": 1}
    # The stream reads the same files into a lake of its own.
    flow = str(tmp_path / "flow")
    for _ in range(2):
        si.start_ingest(si.document_stream(spark, str(folder), 1), flow, progress).awaitTermination()
    rows = ingest.accounts_of_loads(spark, flow).agg(*[F.sum(c) for c in ("leidos", "cargados", "fuera", "otros", "rechazados")]).first()
    assert tuple(rows) == (16, 3, 0, 1, 12)
    assert state(spark, flow) == state(spark, root)


def test_a_stream_batch_that_comes_twice_is_loaded_once(spark, tmp_path):
    root, batch = str(tmp_path), parsed(spark, order("a", 1))
    first = ingest.load_documents(spark, root, batch, incremental=False, stream=("s", 0))
    again = ingest.load_documents(spark, root, batch, incremental=False, stream=("s", 0))
    other = ingest.load_documents(spark, root, batch, incremental=False, stream=("t", 0))
    assert (first.orders.n_new, again.orders.n_new, other.orders.n_new) == (1, 0, 1)
    assert versions.published(spark, root) == [1, 2]


def test_lines_of_two_versions_of_an_order_do_not_mix(spark, tmp_path):
    root = str(tmp_path)
    both = [order("a", 1, 1.0, ("A1", "B2")), order("a", 2, 2.0, ("C3",)), order("bb", 1), order("bb", 1)]
    for texts in (both, both[::-1]):
        load = ingest.run_ingest(spark, str(tmp_path / str(len(root))), parsed(spark, *texts), UNTIL)
        root = str(tmp_path / str(len(root)))
        assert state(spark, root) == ({"a": 2.0, "bb": 10.0}, [("a", "C3"), ("bb", "A1")]) and load.accounts.pending == 4


@pytest.mark.parametrize("as_of", ["2026-04-20T00:00:00", "2026-04-20T10:07:30", "2026-03-01T05:45:00"])
def test_totals_equal_a_full_recomputation(spark, tmp_path, as_of):
    root = str(tmp_path / "lake")
    loads = [
        [order(f"k{i}" + "x" * (i % 5), i, 0.1 * i) for i in range(80)],
        [order("k3xxx", 50, 7.7), order("k10", 95, None), order("fresh", 90)],  # a moved month, a correction, a new order
        [order("k3xxx", 96, 8.8), order("odd", 97), order("k79xxxx", 98)],
    ]
    read = []
    for texts in loads:
        ingest.load_documents(spark, root, parsed(spark, *texts), incremental=False)
        read.append(sorted(versions.manifest(spark, root).tables[totals.TOTALS].parts))
    orders = tables.load_table(spark, root, tables.VIEWS["orders"])
    segments = spark.createDataFrame([(f"C{i}", "MVPs" if i else "En Riesgo") for i in range(3)], "cliente_id string, segmento_cluster string")
    got = totals.stored_season_tables(spark, root, segments, as_of, months=2)
    want = season.seasonality(orders, segments, tables.load_table(spark, root, tables.VIEWS["items"]).withColumn("familia", F.lit("f")),
                              spark.createDataFrame([], "segmento string, antecedents string, consequents string, lift double"), as_of, months=2)
    want["diario"] = season.daily(orders, segments, as_of)
    for name in ("hora_dia", "mensual", "diario"):
        rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
        assert rounded(got[name]) == rounded(want[name]) and want[name].count()


def test_totals_read_only_touched_months(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    ingest.load_documents(spark, root, parsed(spark, *[order(f"k{i}", 10 * i) for i in range(30)]), incremental=False)
    asked, real = [], versions.Version.old

    def old(self, name, parts=None):
        found = real(self, name, parts)
        if name == totals.TOTALS:
            asked.extend(found.inputFiles())
        return found

    monkeypatch.setattr(versions.Version, "old", old)
    ingest.load_documents(spark, root, parsed(spark, order("k3", 65, 1.0)), incremental=False)
    assert {f.split("mes=")[1][:7] for f in asked} == {"2026-01", "2026-03"}
    parts = versions.manifest(spark, root).tables[totals.TOTALS].parts
    assert sum(folder.startswith("0000000002") for folder, _ in parts.values()) == 2 < len(parts)
    assert files.names_in(spark, f"{root}/nada") == []


def test_one_customer_is_read_from_few_row_groups(spark, tmp_path):
    """Orders stored by month and customer: a look-up pushes its filter and meets few of the row groups."""
    import glob

    import pyarrow.parquet as pq

    from custscope.operators import serve_customer

    root = str(tmp_path)
    rows = spark.range(60_000).select(
        F.concat(F.lit("o"), "id").alias("order_id"), F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("cliente_id"),
        F.expr("timestamp_seconds(1767225600 + id * 120)").alias("fecha"), (F.col("id") % 97).cast("double").alias("pago_total"),
        F.lit(1).alias("num_productos"), F.lit(0).alias("p"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (("parquet.block.size", "8192"), ("parquet.page.size", "1024"), ("parquet.block.row.count.limit", "500")):
        hadoop.set(key, value)
    try:
        version = versions.Version(spark, root)
        tables.upsert(version, "orders_historicos", rows, ["order_id"], "p")
        version.publish()
    finally:
        for key in ("parquet.block.size", "parquet.page.size", "parquet.block.row.count.limit"):
            hadoop.unset(key)
    groups = met = 0
    for path in glob.glob(f"{root}/orders_historicos/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            column = next(meta.row_group(g).column(i) for i in range(meta.num_columns) if meta.row_group(g).column(i).path_in_schema == "cliente_id")
            groups += 1
            met += column.statistics.min <= "c1234" <= column.statistics.max
    assert groups > 60 and met <= 0.05 * groups, (met, groups)
    orders = tables.load_table(spark, root, "orders_historicos")
    items = spark.createDataFrame([], "order_id string, cliente_id string, clave string, cantidad double")
    found = serve_customer.order_history(orders, items, "c1234")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cliente_id), EqualTo(cliente_id,c1234)]" in plan
    want = [r.order_id for r in rows.where("cliente_id = 'c1234'").orderBy("fecha").collect()]
    assert [r.order_id for r in found.collect()] == want and len(want) > 5
    one = found.select("order_id")
    assert "Sort [" not in serve_customer.order_history(orders, items)._jdf.queryExecution().optimizedPlan().toString() and one.count() == len(want)
    assert versions.manifest(spark, root).tables["orders_historicos"].column == "mes"


def staged_names(spark):
    return set(files.names_in(spark, staging.staging_root(spark)))


def shuffles_kept(spark):
    """Shuffles whose files are still there, as the driver knows them."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_a_load_leaves_no_staged_tables_and_no_shuffle_files(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join([order("a", 1), order("bb", 40, skus=("A1", "B2", "A1")), order("a", 2), "{cut"]))
    held, shuffles = staged_names(spark), shuffles_kept(spark)
    conf = {k: spark.conf.get(k, None) for k in staging._TIGHT}
    ingest.run_ingest(spark, str(tmp_path / "lake"), docs.read_documents(spark, str(folder)), UNTIL)
    si.start_ingest(si.document_stream(spark, str(folder)), str(tmp_path / "flow"), str(tmp_path / "progress")).awaitTermination()
    assert staged_names(spark) == held
    assert shuffles_kept(spark) - shuffles < 12  # small counts only; every write of rows removes its own
    assert conf == {k: spark.conf.get(k, None) for k in staging._TIGHT}
    wanted = ({"a": 10.0, "bb": 10.0}, [("a", "A1"), ("bb", "A1"), ("bb", "B2")])
    assert state(spark, str(tmp_path / "lake")) == state(spark, str(tmp_path / "flow")) == wanted


def test_scratch_deletes_what_was_staged_inside_also_after_an_error(spark):
    held = staged_names(spark)
    with pytest.raises(RuntimeError), staging.scratch(spark):
        with staging.scratch(spark):
            inner = staging.stage(spark.range(3), "inner")
            assert inner.count() == 3
        assert staged_names(spark) == held
        staging.stage(spark.range(3), "outer")
        assert len(staged_names(spark)) == len(held) + 1
        raise RuntimeError("stopped")
    assert staged_names(spark) == held


def test_keep_last_of_few_moves_only_repeated_keys(spark, monkeypatch):
    rows = spark.createDataFrame(
        [("a", "x", 1, 1.0), ("a", "x", 2, 2.0), ("a", None, 1, 3.0), (None, "a", 1, 4.0), (None, None, 1, 5.0), (None, None, 1, 6.0), ("b", "x", 1, 7.0)],
        "order_id string, clave string, posicion int, cantidad double")
    moved = []
    real = tables.keep_last
    monkeypatch.setattr(tables, "keep_last", lambda df, *a: moved.append(df) or real(df, *a))
    for most in (tables.FEW_KEYS, 0):
        monkeypatch.setattr(tables, "FEW_KEYS", most)
        got = tables.keep_last_of_few(rows, ["order_id", "clave"], ["posicion"])
        assert sorted(map(str, got.collect())) == sorted(map(str, real(rows, ["order_id", "clave"], ["posicion"]).collect()))
        assert moved.pop().count() == 6  # hashing passes over nulls, so two keys that differ only by their place are compared too
    alone = rows.where("cantidad > 6")
    assert tables.keep_last_of_few(alone, ["order_id", "clave"], ["posicion"]) is alone and not moved


def test_texts_of_the_stream_are_packed(spark, tmp_path):
    from custscope.testbed import catalog

    folder = str(tmp_path / "json")
    catalog.write_texts(spark.createDataFrame([(order("a", 1),), ("",), ("{cut",)], "value string"), folder)
    names = [n for n in files.names_in(spark, folder) if n.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)
    assert sorted(r[0] for r in spark.read.text(folder).collect()) == sorted([order("a", 1), "", "{cut"])
