"""Named queries over the driver's tables, one per operator, with their column lists."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.functions.labels import item_label
from custscope.functions.ordered import over_few_rows
from custscope.functions.timeparts import instant, local_time, time_features
from custscope.operators import basket, explore, flatten, quality, rfm, season, segment, sketches
from custscope.operators import serve_customer as customer
from custscope.operators import serve_moves as moves
from custscope.operators import serve_rules as rules
from custscope.operators import serve_segments as segs
from custscope.operators import serve_time as when
from custscope.plans import ingest as ingest_plan
from custscope.plans import job, totals
from custscope.schema import FEATURES, ITEM_KEYS, ORDER_KEYS, SEGMENT_ORDER
from custscope.sources import documents as docs
from custscope.sources import tables, versions
from custscope.sources.staging import fresh_path, stage, tight
from custscope.streaming import daily as stream_daily
from custscope.streaming import ingest as stream_ingest
from custscope.testbed import mapping as m
from custscope.testbed.shapes import shape

Query = Callable[[SparkSession, str], DataFrame]

SPECS: dict[str, str] = {}
QUERIES: dict[str, Query] = {}

# Relaxed rule thresholds that give rules on the driver's random data.
FAMILY_RULES = {"min_count": 10, "min_pct": 0.001, "min_confidence": 0.02, "min_lift": 1.2}
TYPE_RULES = {"min_count": 30, "min_pct": 0.001, "min_confidence": 0.2, "min_lift": 0.8}

DOC_RANGE = ("1999-01-01", "2000-06-30")
DOC_MARK = datetime(2000, 6, 30, tzinfo=m.AS_OF.tzinfo)
RANKED_CUSTOMER = "7"


def query(spec: str, name: str | None = None):
    """Registers a builder; its result is shaped by the column list."""
    def register(build: Query) -> Query:
        key = name or build.__name__
        SPECS[key] = spec
        QUERIES[key] = lambda spark, sf: shape(build(m.use_utc(spark), sf), spec)
        return build

    return register


def model() -> segment.SegmentModel:
    return segment.SegmentModel.packaged()


def segments(spark, sf) -> DataFrame:
    return segment.segment_customers(m.orders(spark, sf), model(), m.AS_OF)


def snapshot(spark, sf) -> DataFrame:
    return segment.segment_customers(m.orders(spark, sf), model(), m.SNAPSHOT_AS_OF)


# --- documents and tables -----------------------------------------------------------------------

ORDER_SPEC = (
    "order_id:s cliente_id:s nombre_cliente:s fecha:s pago_total:d4 iva_aplicado:d4 plazo:s "
    "tipo_pago:s num_productos:n tiene_errores:b"
)
ITEM_SPEC = (
    "order_id:s cliente_id:s fecha:s clave:s cantidad:d4 precio_final:d4 moneda:s valor_dolar:d4 "
    "promocion_id:i promocion_tipo:i"
)


def parsed(spark, sf) -> DataFrame:
    return docs.parse_documents(m.documents(spark, sf))


@query(ORDER_SPEC)
def doc_scan_range(spark, sf):
    found = docs.scan_range(parsed(spark, sf), *DOC_RANGE)
    return flatten.flatten_orders(found)


@query(ORDER_SPEC)
def doc_scan_incremental(spark, sf):
    return flatten.flatten_orders(docs.scan_incremental(parsed(spark, sf), DOC_MARK, m.AS_OF))


@query("n_pendientes:i")
def pending_count(spark, sf):
    return docs.pending_count(parsed(spark, sf), DOC_MARK, m.AS_OF)


@query("watermark:s")
def watermark(spark, sf):
    return tables.high_water_mark(m.orders(spark, sf))


@query("order_id:s cliente_id:s")
def doc_sample(spark, sf):
    return flatten.flatten_orders(docs.quick_sample(parsed(spark, sf), 5))


@query("tabla:s filas:i")
def row_counts(spark, sf):
    return tables.row_counts({
        "orders": m.source(spark, sf, "orders"), "lineitem": m.source(spark, sf, "lineitem"),
    })


@query(ORDER_SPEC)
def flatten_orders(spark, sf):
    return flatten.flatten_orders(parsed(spark, sf))


@query(ITEM_SPEC)
def explode_items(spark, sf):
    return flatten.explode_items(parsed(spark, sf))


@query("order_id:s num_productos:n")
def num_productos(spark, sf):
    return flatten.flatten_orders(parsed(spark, sf))


@query("order_id:s clave:s cantidad:d4 precio_final:d4 promocion_id:i promocion_tipo:i")
def lenient_casts(spark, sf):
    return flatten.explode_items(parsed(spark, sf))


CORRECTED_SINCE = datetime(2000, 1, 1, tzinfo=m.AS_OF.tzinfo)


def two_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A whole table, and a second delivery of everything since a date."""
    again = df.where(F.col("fecha") >= instant(CORRECTED_SINCE))
    return df.withColumn("secuencia", F.lit(0)), again.withColumn("secuencia", F.lit(1))


@query("order_id:s cliente_id:s fecha:s pago_total:d4 secuencia:n")
def upsert_orders(spark, sf):
    old, new = two_batches(m.orders(spark, sf))
    return tables.merge_keep_last(old, new.withColumn("pago_total", F.col("pago_total") + 1), ORDER_KEYS, ["secuencia"])


@query("order_id:s clave:s cantidad:d4 posicion:n secuencia:n")
def upsert_items(spark, sf):
    # The line number does not identify a line here, so the figures themselves break ties.
    old, new = two_batches(m.items(spark, sf).select("order_id", "clave", "fecha", "cantidad", "posicion"))
    return tables.merge_keep_last(
        old, new.withColumn("cantidad", F.col("cantidad") + 1), ITEM_KEYS, ["secuencia", "posicion", "cantidad"]
    )


@query(
    "corrida:n n_orders_nuevos:i n_items_nuevos:i n_orders_total:i n_items_total:i skipped:b watermark_nuevo:s"
)
def ingest_metrics(spark, sf):
    """Three runs over the documents: up to a date, the rest, and once more with nothing new."""
    root = fresh_path(spark, "ingest")
    source = stage(parsed(spark, sf), "documents")
    out = None
    for i, until in enumerate([DOC_MARK, m.AS_OF, m.AS_OF]):
        row = ingest_plan.as_row(spark, ingest_plan.run_ingest(spark, root, source, until))
        row = row.withColumn("corrida", F.lit(i + 1))
        out = row if out is None else out.unionByName(row)
    return out


STORED = "_tabla"


def stored_in_two(spark, first: DataFrame, second: DataFrame, keys, position: str) -> DataFrame:
    """Both deliveries merged into a stored table, each as a published version; what a reader then sees."""
    root = fresh_path(spark, "versions")
    for part in (first, second):
        version = versions.Version(spark, root)
        tables.upsert(version, STORED, part, keys, position)
        version.publish()
    return tables.load_table(spark, root, STORED)


@query("order_id:s cliente_id:s fecha:s pago_total:d4 lote:i mes:s")
def upsert_orders_stored(spark, sf):
    """The second delivery corrects amounts and moves every third order by 40 days, most of them to another month."""
    orders = m.orders(spark, sf).withColumn("p", F.lit(0))
    moved = F.when(F.col("order_id").cast("bigint") % 3 == 0, F.col("fecha") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("fecha"))
    again = orders.where(F.col("fecha") >= instant(CORRECTED_SINCE)).withColumns({"pago_total": F.col("pago_total") + 1, "fecha": moved})
    return stored_in_two(spark, orders, again, ORDER_KEYS, "p")


@query("order_id:s clave:s cantidad:d4 posicion:n lote:i mes:s")
def upsert_items_stored(spark, sf):
    """Two overlapping deliveries of the lines."""
    items = m.items(spark, sf).select("order_id", "clave", "fecha", "cantidad", "posicion")
    again = items.where(F.col("fecha") >= instant(CORRECTED_SINCE)).withColumn("cantidad", F.col("cantidad") + 1)
    return stored_in_two(spark, items, again, ITEM_KEYS, "posicion")


def damaged(spark, sf) -> DataFrame:
    return docs.parse_documents(m.damaged_documents(spark, sf))


def write_texts(texts: DataFrame, folder: str) -> None:
    """JSON lines, packed: such text is eight times as large as what it holds."""
    with tight(texts.sparkSession):
        texts.write.option("compression", "gzip").text(folder)


@query("fuente:s carga:s origen:s leidos:i cargados:i fuera:i otros:i rechazados:i rechazados_nuevos:i")
def ingest_accounts(spark, sf):
    """Where every document of a damaged source goes: two batch loads of it, and the same texts through the stream."""
    root, flow, folder, progress = (fresh_path(spark, n) for n in ("accounts", "flow", "json", "progress"))
    write_texts(m.damaged_documents(spark, sf), folder)
    with tight(spark):
        source = stage(docs.read_documents(spark, folder), "documents")
    for until in (DOC_MARK, m.AS_OF):
        ingest_plan.run_ingest(spark, root, source, until)
    stream_ingest.start_ingest(stream_ingest.document_stream(spark, folder), flow, progress).awaitTermination()
    loads = ingest_plan.accounts_of_loads(spark, root).withColumn("fuente", F.lit("lote"))
    arrived = ingest_plan.accounts_of_loads(spark, flow).withColumns({"fuente": F.lit("flujo"), "origen": F.lit("flujo")})
    return loads.unionByName(arrived)


@query("motivo:s order_id:s carga:s")
def ingest_rejects(spark, sf):
    """Each rejected document once, with the reason and the load that met it; a cut text has no id but in its text."""
    root = fresh_path(spark, "rejects")
    source = stage(damaged(spark, sf), "documents")
    for until in (DOC_MARK, m.AS_OF):
        ingest_plan.run_ingest(spark, root, source, until)
    found = tables.load_table(spark, root, ingest_plan.REJECTS)
    return found.withColumn("order_id", F.coalesce("order_id", F.regexp_extract("documento", '"_id":"([0-9]+)"', 1)))


def three_loads(spark, sf) -> str:
    """Events in three loads: those of even number, then the others with corrected values, then every tenth again 31 days later."""
    root = fresh_path(spark, "totals")
    events = m.event_orders(spark, sf).withColumn("p", F.lit(0))
    number = F.col("order_id").cast("bigint")
    loads = (
        events.where(number % 2 == 0),
        events.where((number % 2 == 1) | (number % 6 == 0)).withColumn("pago_total", F.col("pago_total") + 1),
        events.where(number % 10 == 0).withColumn("fecha", F.col("fecha") + F.expr("INTERVAL 31 DAYS")),
    )
    for part in loads:
        version = versions.Version(spark, root)
        _, changes = tables.upsert(version, tables.VIEWS["orders"], part, ORDER_KEYS, "p")
        totals.add_changes(version, changes)
        version.publish()
    return root


@query("tabla:s segmento:s periodo:s hora:n pedidos:i revenue:d4")
def temp_mantenido(spark, sf):
    """Hour, month and day tables from totals that three loads have kept by their changes."""
    found = totals.stored_season_tables(spark, three_loads(spark, sf), m.event_segments(spark, sf), m.EVENTS_AS_OF)
    rows = None
    for name, when_, hour, money in (
        ("hora_dia", "dia_nombre", F.col("hora"), F.lit(None)), ("mensual", "año_mes", F.lit(None), F.col("revenue")),
        ("diario", "fecha_dia", F.lit(None), F.col("revenue")),
    ):
        segment_name = "segmento" if name == "diario" else "segmento_cluster"
        one = found[name].select(
            F.lit(name).alias("tabla"), F.col(segment_name).alias("segmento"), F.col(when_).cast("string").alias("periodo"),
            hour.cast("int").alias("hora"), "pedidos", money.cast("double").alias("revenue"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("cliente_id:s segmento_cluster:s recency:i frequency:i monetary:d4 dias_entre_compras:d4 razon_distancias:d6 snapshot_month:s")
def snapshot_write(spark, sf):
    """Two months, the second written twice: the rerun replaces its own month only."""
    path = fresh_path(spark, "snapshots")
    tables.write_snapshot(snapshot(spark, sf), path, m.SNAPSHOT_AS_OF)
    for _ in range(2):
        tables.write_snapshot(segments(spark, sf), path, m.AS_OF)
    return spark.read.parquet(path)


# --- lines ---------------------------------------------------------------------------------------


@query("order_id:s clave:s precio_mxn:d4 subtotal_mxn:d4")
def enrich_items(spark, sf):
    return flatten.enrich_items(m.raw_items(spark, sf))


@query("clave:s familia:s n:i")
def derive_family(spark, sf):
    return m.items(spark, sf).groupBy("clave", "familia").agg(F.count(F.lit(1)).alias("n"))


@query("n_familias:i n_nulas:i n_items:i")
def family_stats(spark, sf):
    return flatten.family_stats(m.items(spark, sf))


@query("order_id:s clave:s")
def non_product_filter(spark, sf):
    return flatten.drop_non_products(m.items(spark, sf))


@query("order_id:s año_mes:s dia_semana:n dia_nombre:s hora:n")
def time_features_(spark, sf):
    return time_features(m.event_orders(spark, sf))


QUERIES["time_features"] = QUERIES.pop("time_features_")
SPECS["time_features"] = SPECS.pop("time_features_")

# --- RFM -----------------------------------------------------------------------------------------

RFM_SPEC = "cliente_id:s recency:i frequency:i monetary:d4 dias_entre_compras:d4 es_single_buyer:n"


@query("cliente_id:s recency:i frequency:i monetary:d4")
def rfm_features(spark, sf):
    return rfm.rfm_features(m.orders(spark, sf), m.AS_OF)


@query("cliente_id:s dias_entre_compras:d4")
def purchase_cadence(spark, sf):
    return rfm.purchase_cadence(m.orders(spark, sf), m.AS_OF)


@query(RFM_SPEC)
def rfm_complete(spark, sf):
    return rfm.rfm_complete(m.orders(spark, sf), m.AS_OF)


# Events carry a time of day, so this run has many orders of one customer within a day.
@query(RFM_SPEC)
def rfm_complete_hours(spark, sf):
    return rfm.rfm_complete(m.event_orders(spark, sf), m.EVENTS_AS_OF)


# --- seasonality ---------------------------------------------------------------------------------


def event_window(spark, sf):
    return season.orders_in_window(m.event_orders(spark, sf), m.EVENTS_AS_OF)


def hour_day(spark, sf):
    return season.hour_by_weekday(event_window(spark, sf), m.event_segments(spark, sf))


def order_window(spark, sf):
    return season.orders_in_window(m.orders(spark, sf), m.AS_OF)


def monthly(spark, sf):
    return season.monthly(order_window(spark, sf), m.proxy_segments(spark, sf))


def daily(spark, sf):
    return season.daily(m.orders(spark, sf), m.proxy_segments(spark, sf), m.AS_OF)


@query("segmento_cluster:s dia_semana:n dia_nombre:s hora:n pedidos:i")
def temp_hora_dia(spark, sf):
    return hour_day(spark, sf)


@query("segmento_cluster:s año_mes:s pedidos:i revenue:d4")
def temp_mensual(spark, sf):
    return monthly(spark, sf)


@query("fecha_dia:D segmento:s pedidos:i revenue:d4")
def temp_diario(spark, sf):
    return daily(spark, sf)


@query("segmento:s dia_semana:n dia_nombre:s hora:n pedidos:i pct:d6")
def hora_dia_pct(spark, sf):
    return when.hour_weekday_share(hour_day(spark, sf))


@query("segmento:s hora:n pct:d6")
def pct_por_hora(spark, sf):
    return when.share_by_hour(when.hour_weekday_share(hour_day(spark, sf)))


@query("segmento:s dia_semana:n dia_nombre:s pct:d6")
def pct_por_dia(spark, sf):
    return when.share_by_weekday(when.hour_weekday_share(hour_day(spark, sf)))


@query("segmento:s ano_mes:s pedidos:i revenue:d4")
def serie_mensual(spark, sf):
    return when.monthly_series(monthly(spark, sf), "MVPs,En Riesgo")


@query("segmento:s mes:n pedidos_promedio:d6")
def estacionalidad_tipica(spark, sf):
    return when.typical_months(monthly(spark, sf))


# The last orders are of July 2001: the 20th has a month behind it and one before.
MONTH_DAY = "2001-07-20"


@query("fecha_dia:s segmento:s pedidos:i revenue:d4")
def ultimo_mes(spark, sf):
    return when.current_month(daily(spark, sf), MONTH_DAY)


@query("fecha_dia:s segmento:s pedidos:i revenue:d4")
def mes_anterior(spark, sf):
    return when.previous_month_same_days(daily(spark, sf), MONTH_DAY)


@query("segmento:s pedidos_actual:i pedidos_anterior:i variacion_pct:d6")
def variacion_mensual(spark, sf):
    return when.monthly_change(daily(spark, sf), MONTH_DAY)


@query("total_actual:i total_anterior:i total_variacion_pct:d6")
def variacion_total(spark, sf):
    return when.total_change(daily(spark, sf), MONTH_DAY)


@query("segmento:s dia:n pedidos_actual:i pedidos_anterior:i")
def mes_alineado(spark, sf):
    return when.aligned_months(daily(spark, sf), MONTH_DAY)


# --- segmentation --------------------------------------------------------------------------------

SEGMENT_SPEC = (
    RFM_SPEC + " cluster_id:n segmento_cluster:s distancia_propia:d6 distancia_segunda:d6 "
    "razon_distancias:d6 segmento_secundario:s"
)


def complete(spark, sf):
    return rfm.rfm_complete(m.orders(spark, sf), m.AS_OF)


@query("cliente_id:s z_recency:d6 z_frequency:d6 z_monetary:d6 z_dias_entre_compras:d6")
def scaled_features(spark, sf):
    return segment.scaled_features(complete(spark, sf), model())


@query("cliente_id:s cluster_id:n segmento_cluster:s distancia_centroide:d6")
def segment_score(spark, sf):
    return segment.score(complete(spark, sf), model(), with_distance=True)


@query("cliente_id:s distancia_propia:d6 distancia_segunda:d6 razon_distancias:d6 segmento_secundario:s")
def segment_frontier(spark, sf):
    return segments(spark, sf)


@query(SEGMENT_SPEC)
def segmentos(spark, sf):
    return segments(spark, sf)


@query(" ".join(f"{f}_nulos:i {f}_negativos:i" for f in FEATURES))
def feature_validation(spark, sf):
    # Before imputation: the cadence of single buyers is still missing.
    return segment.feature_checks(rfm.customer_features(m.orders(spark, sf), m.AS_OF))


@query("cluster_id:n segmento_cluster:s recency:d1 frequency:d1 monetary:d1 dias_entre_compras:d1 n_clientes:i")
def centroids_original(spark, sf):
    return segment.centroid_profile(segments(spark, sf), model())


@query("n_total:i n_coincidencias:i pct_coincidencia:d6")
def snapshot_agreement(spark, sf):
    return segment.snapshot_agreement(segments(spark, sf), snapshot(spark, sf))


@query("snapshot:s MVPs:i Alto_Valor:i Ocasionales:i En_Riesgo:i Hibernando:i")
def segment_confusion(spark, sf):
    table = segment.segment_confusion(segments(spark, sf), snapshot(spark, sf))
    return table.withColumnsRenamed({n: n.replace(" ", "_") for n in SEGMENT_ORDER})


@query("cluster_id:n segmento_cluster:s n_clientes:i")
def kmeans_fit(spark, sf):
    fitted = segment.fit(complete(spark, sf), "prueba")
    return segment.centroid_profile(segment.score(complete(spark, sf), fitted), fitted)


@query("k:n inercia:d2 silueta:d4")
def kmeans_k_scan(spark, sf):
    return segment.k_scan(complete(spark, sf))


@query("version:s n_clientes:i n_iguales:i")
def model_roundtrip(spark, sf):
    """Saves a model with its pipeline, loads both and scores all customers with each."""
    folder = fresh_path(spark, "models")
    features = stage(complete(spark, sf), "features")
    fitted = segment.fit(features, "v2")
    fitted.save(spark, folder)
    loaded = segment.SegmentModel.load(spark, "v2", folder)
    by_numbers = segment.score(features, loaded).select("cliente_id", F.col("cluster_id").alias("a"))
    by_pipeline = loaded.load_pipeline(folder).transform(features).select("cliente_id", F.col("cluster_id").alias("b"))
    return by_numbers.join(by_pipeline, "cliente_id").agg(
        F.count(F.lit(1)).alias("n_clientes"), F.count_if(F.col("a") == F.col("b")).alias("n_iguales")
    ).withColumn("version", F.lit(loaded.version))


# --- serving: segments ---------------------------------------------------------------------------


@query("n_clientes:i revenue_total:d4 ticket_promedio:d4 pct_single_buyers:d6")
def kpis_globales(spark, sf):
    return segs.global_kpis(segments(spark, sf))


@query("segmento:s n_clientes:i pct:d6")
def distribucion_clientes(spark, sf):
    return segs.customers_per_segment(segments(spark, sf))


@query("segmento:s revenue:d4")
def revenue_por_segmento(spark, sf):
    return segs.revenue_per_segment(segments(spark, sf))


@query("segmento:s n_clientes:i pct:d6 recency_med:d4 frequency_med:d4 monetary_med:d4 cadencia_med:d4")
def resumen_por_segmento(spark, sf):
    return segs.segment_summary(segments(spark, sf))


@query(
    "segmento:s n_clientes:i pct_total:d6 recency_med:d4 recency_avg:d4 frequency_med:d4 frequency_avg:d4 "
    "monetary_med:d4 monetary_avg:d4 monetary_total:d4 cadencia_med:d4 pct_single_buyers:d6"
)
def metricas_segmento(spark, sf):
    return segs.segment_metrics(segments(spark, sf))


@query("orden:n segmento:s n_clientes:i")
def segment_order(spark, sf):
    return segs.in_segment_order(segs.customers_per_segment(segments(spark, sf)))


ALERT_SPEC = "cliente_id:s segmento:s recency:i cadencia:d4 ratio:d6 monetary:d4 frequency:i"


@query(ALERT_SPEC)
def clientes_urgentes(spark, sf):
    return segs.urgent_customers(segments(spark, sf))


@query("n_total:i n_mvps:i n_alto:i revenue_en_riesgo:d4")
def kpis_urgentes(spark, sf):
    return segs.urgent_kpis(segments(spark, sf))


@query(ALERT_SPEC)
def clientes_reactivacion(spark, sf):
    return segs.reactivation_customers(segments(spark, sf))


@query("n_total:i revenue_potencial:d4 recency_mediana:d4 cadencia_mediana:d4")
def kpis_reactivacion(spark, sf):
    return segs.reactivation_kpis(segments(spark, sf))


@query("segmento:s banda:s n_clientes:i revenue:d4")
def urgency_bands(spark, sf):
    return segs.urgency_bands(segments(spark, sf))


@query("segmento:s minimo:d4 q1:d4 mediana:d4 q3:d4 maximo:d4")
def monetary_box(spark, sf):
    return segs.monetary_box(segments(spark, sf))


RANKS = {"p05": 0.05, "q1": 0.25, "mediana": 0.5, "q3": 0.75, "p95": 0.95}
RANK_SPEC = "segmento:s n:i " + " ".join(f"{name}_bien:b" for name in RANKS)
SKETCHED = ("1998-03-10", "2000-11-20")


def within_one_percent(quantiles: DataFrame, errors: DataFrame) -> DataFrame:
    good = errors.select("segmento", *[(F.col(name) < 0.01).alias(f"{name}_bien") for name in RANKS])
    return quantiles.select("segmento", "n").join(good, "segmento")


@query(RANK_SPEC)
def monetary_box_aprox(spark, sf):
    """Approximate quantiles of the customers' money, and whether each is within one percent of its rank."""
    named = segments(spark, sf).withColumnRenamed("segmento_cluster", "segmento")
    found = stage(sketches.merged_quantiles(sketches.value_sketches(named, ["segmento", "cluster_id"], "monetary"), ["segmento"], RANKS), "quantiles")
    return within_one_percent(found, sketches.rank_errors(named, ["segmento"], "monetary", found, RANKS))


@query(RANK_SPEC)
def ticket_box_aprox(spark, sf):
    """Quantiles of order amounts over a span of days, merged from sketches stored per segment and day."""
    version = versions.Version(spark, fresh_path(spark, "sketches"))
    version.replace("tickets", sketches.ticket_sketches(m.orders(spark, sf), m.proxy_segments(spark, sf)), "mes", [])
    found = stage(sketches.ticket_quantiles(version.new("tickets"), RANKS, *SKETCHED), "quantiles")
    day = F.to_date(local_time(F.col("fecha")))
    orders = m.orders(spark, sf).where(day.between(*[F.lit(d).cast("date") for d in SKETCHED])).join(
        m.proxy_segments(spark, sf).withColumnRenamed("segmento_cluster", "segmento"), "cliente_id")
    return within_one_percent(found, sketches.rank_errors(orders, ["segmento"], "pago_total", found, RANKS))


RANGE_SPEC = " ".join(f"{f}_{e}:d4" for f in ("recency", "frequency", "monetary", "cadencia") for e in ("min", "max"))


@query(RANGE_SPEC)
def ranges_globales(spark, sf):
    return segs.global_ranges(segments(spark, sf))


@query(RANGE_SPEC)
def ranges_medianas(spark, sf):
    return segs.median_ranges(segments(spark, sf))


@query("segmento:s recency:d6 frequency:d6 monetary:d6 cadencia:d6")
def radar_segmentos(spark, sf):
    return segs.radar(segments(spark, sf))


@query("lado:s segmento:s n_clientes:i recency_med:d4 monetary_med:d4 monetary_min:d4 monetary_max:d4")
def comparador(spark, sf):
    """Two segments side by side with the ranges over all segments."""
    median = F.col("monetary_med").cast("double")
    metrics = segs.segment_metrics(segments(spark, sf)).select(
        F.when(F.col("segmento") == "MVPs", "a").otherwise("b").alias("lado"), "segmento", "n_clientes",
        "recency_med", "monetary_med", over_few_rows(F.min(median)).alias("monetary_min"),
        over_few_rows(F.max(median)).alias("monetary_max"),
    )
    return metrics.where(F.col("segmento").isin("MVPs", "Hibernando"))


# --- rules ---------------------------------------------------------------------------------------

RULE_SPEC = (
    "segmento:s antecedents:s consequents:s antecedent_support:d6 consequent_support:d6 support:d6 "
    "confidence:d6 lift:d6 leverage:d6 conviction:d6 n_antecedents:n n_consequents:n tamano_total:n "
    "n_pedidos_segmento:i support_count:i"
)
VALUE_SPEC = " ticket_medio:d4 ticket_mediano:d4 n_pedidos:i revenue_total:d4"


def family_baskets(spark, sf):
    return basket.multi_family_baskets(m.items(spark, sf), m.proxy_segments(spark, sf))


def family_itemsets(spark, sf):
    return basket.frequent_itemsets(family_baskets(spark, sf), FAMILY_RULES["min_count"], FAMILY_RULES["min_pct"])


def family_rules(spark, sf):
    found = basket.one_rule_per_pair(
        family_itemsets(spark, sf), FAMILY_RULES["min_confidence"], FAMILY_RULES["min_lift"]
    )
    return stage(found, "rules")


def products(spark, sf):
    return flatten.drop_non_products(m.items(spark, sf))


def family_actionable(spark, sf):
    return stage(
        basket.actionable_rules(family_rules(spark, sf), products(spark, sf), m.orders(spark, sf)), "valued"
    )


def type_itemsets(spark, sf):
    found = basket.multi_family_baskets(m.type_items(spark, sf), m.proxy_segments(spark, sf))
    return basket.frequent_itemsets(found, TYPE_RULES["min_count"], TYPE_RULES["min_pct"])


def type_rules(spark, sf):
    return basket.one_rule_per_pair(type_itemsets(spark, sf), TYPE_RULES["min_confidence"], TYPE_RULES["min_lift"])


def bundle_months(spark, sf):
    return season.bundles_by_month(
        order_window(spark, sf), m.proxy_segments(spark, sf), products(spark, sf), family_actionable(spark, sf)
    )


@query("order_id:s cliente_id:s segmento:s familias:s")
def baskets_multi_family(spark, sf):
    return family_baskets(spark, sf).withColumn("familias", item_label(F.col("familias")))


@query("segmento:s n_pedidos:i umbral:i se_omite:b")
def support_thresholds(spark, sf):
    return basket.support_thresholds(family_baskets(spark, sf), 10, 0.001)


@query("segmento:s items:s freq:i n_pedidos:i")
def frequent_itemsets(spark, sf):
    return family_itemsets(spark, sf).withColumn("items", item_label(F.col("items")))


@query("segmento:s items:s freq:i n_pedidos:i")
def frequent_itemsets_types(spark, sf):
    return type_itemsets(spark, sf).withColumn("items", item_label(F.col("items")))


@query(RULE_SPEC)
def rules_all(spark, sf):
    return basket.association_rules(type_itemsets(spark, sf), TYPE_RULES["min_confidence"], TYPE_RULES["min_lift"])


@query(RULE_SPEC)
def mba_por_segmento(spark, sf):
    return family_rules(spark, sf)


@query(RULE_SPEC)
def mba_por_segmento_types(spark, sf):
    return type_rules(spark, sf)


@query(RULE_SPEC)
def mba_exclusivas(spark, sf):
    return basket.exclusive_rules(family_rules(spark, sf))


@query(RULE_SPEC + VALUE_SPEC)
def mba_accionables(spark, sf):
    return family_actionable(spark, sf)


@query("antecedents:s consequents:s" + VALUE_SPEC)
def rule_value(spark, sf):
    """Every type rule, of whatever size."""
    pairs = stage(type_rules(spark, sf).select("antecedents", "consequents").distinct(), "pairs")
    lines = flatten.drop_non_products(m.type_items(spark, sf))
    return basket.rule_value(pairs, lines, m.orders(spark, sf))


@query("segmento:s antecedents:s consequents:s cuadrante:s")
def rule_quadrants(spark, sf):
    return basket.rule_quadrants(family_rules(spark, sf))


@query("regla:s segmento_regla:s año_mes:s pedidos:i revenue:d4")
def temp_bundles(spark, sf):
    return bundle_months(spark, sf)


BUNDLE_SPEC = (
    "segmento:s antecedents:s consequents:s confidence:d6 lift:d6 support_count:i n_pedidos:d1 "
    "ticket_medio:d4 ticket_mediano:d4 revenue_total:d4"
)


@query(BUNDLE_SPEC)
def bundles_top(spark, sf):
    valued = family_actionable(spark, sf)
    return rules.bundles_top(valued, valued)


@query(BUNDLE_SPEC)
def bundles_top_completa(spark, sf):
    found = family_rules(spark, sf)
    return rules.bundles_top(found, found, None, "completa")


@query(BUNDLE_SPEC)
def bundles_scatter(spark, sf):
    valued = family_actionable(spark, sf)
    return rules.bundles_scatter(valued, valued, None, "accionables", 0.08, 1.5)


@query(BUNDLE_SPEC + " puesto:n")
def top_bundles(spark, sf):
    return rules.top_bundles(family_actionable(spark, sf))


@query("segmento_regla:s regla:s ano_mes:s pedidos:i revenue:d4")
def bundles_temporalidad(spark, sf):
    return rules.bundles_over_time(stage(bundle_months(spark, sf), "months"))


@query("segmento_regla:s regla:s mes_pico:s pedidos:i pct_concentracion:d6")
def mes_pico(spark, sf):
    return rules.peak_month(bundle_months(spark, sf))


@query("segmento_regla:s regla:s revenue:d4 puesto:n")
def bundles_activos(spark, sf):
    return rules.active_bundles(bundle_months(spark, sf))


# --- customers -----------------------------------------------------------------------------------


@query("cliente_id:s familia:s n_pedidos:i unidades_totales:d4 revenue_total:d4 ultima_compra:s")
def cliente_productos_top(spark, sf):
    return customer.top_products(m.items(spark, sf))


@query("cliente_id:s familia_a:s familia_b:s n_ordenes:i confidence_segmento:d6 lift_segmento:d6 pct_aparicion:d6")
def cliente_bundles(spark, sf):
    return customer.own_bundles(m.items(spark, sf), m.proxy_segments(spark, sf), family_actionable(spark, sf))


@query("cliente_id:s order_id:s fecha:s pago_total:d4 compro:s le_falto:s co_occurrence:d6")
def cliente_oportunidades(spark, sf):
    return customer.missed_opportunities(m.items(spark, sf), m.orders(spark, sf))


@query("cliente_id:s")
def buscar_cliente(spark, sf):
    return customer.find_customers(segments(spark, sf), "1_3", 20)


@query("cliente_id:s recency:i frequency:i monetary:d4 dias_entre_compras:d4 es_single_buyer:n cluster:n segmento:s")
def cliente_perfil(spark, sf):
    return customer.profile(segments(spark, sf))


@query("cliente_id:s order_id:s fecha:s pago_total:d4 num_productos:n unidades_totales:d4")
def cliente_pedidos(spark, sf):
    items = m.items(spark, sf)
    counts = items.groupBy("order_id").agg(
        F.count_if(F.col("clave").isNotNull() & (F.col("clave") != "CARGO100")).alias("num_productos")
    )
    headers = m.orders(spark, sf).join(counts, "order_id", "left").fillna(0, ["num_productos"])
    return customer.order_history(headers, items)


@query("cliente_id:s recency:i monetary:d4 es_objetivo:b")
def cliente_posicion(spark, sf):
    return customer.position_in_segment(segments(spark, sf), RANKED_CUSTOMER)


# --- movement, quality, exploration --------------------------------------------------------------


@query(
    "cliente_id:s segmento_anterior:s segmento_actual:s recency:i frequency:i monetary:d4 cadencia:d4 direccion:s"
)
def cambios_segmento(spark, sf):
    past = tables.snapshot_rows(snapshot(spark, sf), m.SNAPSHOT_AS_OF)
    return moves.changed_since(segments(spark, sf), past, m.AS_OF, 1)


@query(
    "cliente_id:s segmento_actual:s segmento_secundario:s razon_distancias:d6 recency:i frequency:i "
    "monetary:d4 cadencia:d4 es_single_buyer:n"
)
def clientes_frontera(spark, sf):
    return moves.frontier_customers(segments(spark, sf))


@query("n_en_frontera:i n_subidas_mes:i n_bajadas_mes:i n_total_cambios:i")
def kpis_movimientos(spark, sf):
    now = segments(spark, sf)
    return moves.movement_kpis(moves.frontier_customers(now), moves.changed_segment(now, snapshot(spark, sf)))


@query("n_antes:i n_despues:i caida_pct:d6 ok:b")
def dq_ingest(spark, sf):
    old, new = two_batches(m.orders(spark, sf))
    return quality.check_ingest(old, tables.merge_keep_last(old, new, ORDER_KEYS, ["secuencia"]))


@query("n_clientes:i n_sin_segmento:i recency_nulos:i frequency_nulos:i monetary_nulos:i dias_entre_compras_nulos:i cluster_min:n cluster_max:n ok:b")
def dq_segmentos(spark, sf):
    return quality.check_segments(segments(spark, sf))


@query("segmento_dominante:s max_pct:d6 ok:b")
def dq_distribucion(spark, sf):
    return quality.check_distribution(segments(spark, sf))


@query("n_filas:i pedidos_temporal:i pedidos_rfm:i diferencia_pct:d6 ok:b")
def dq_crosscheck(spark, sf):
    now = segments(spark, sf)
    return quality.check_monthly(season.monthly(order_window(spark, sf), now), now)


@query("n_filas:i pedidos:i n_segmentos:i ok:b")
def dq_diario(spark, sf):
    return quality.check_daily(daily(spark, sf))


def _third(yes, no):
    return F.when(F.col("cliente_id").cast("bigint") % 3 == 0, yes).otherwise(no)


@query(SPECS["dq_ingest"])
def dq_ingest_falla(spark, sf):
    """A load after which every tenth order is gone."""
    orders = m.orders(spark, sf)
    return quality.check_ingest(orders, orders.where(F.col("order_id").cast("bigint") % 10 != 0))


@query(SPECS["dq_segmentos"])
def dq_segmentos_falla(spark, sf):
    """Customers without money, and a cluster that the model does not have."""
    broken = segments(spark, sf).withColumns({
        "monetary": _third(F.lit(None).cast("double"), F.col("monetary")), "cluster_id": _third(F.lit(9), F.col("cluster_id"))})
    return quality.check_segments(broken)


@query(SPECS["dq_distribucion"])
def dq_distribucion_falla(spark, sf):
    return quality.check_distribution(segments(spark, sf).withColumn("segmento_cluster", _third(F.lit("En Riesgo"), F.lit("MVPs"))))


@query(SPECS["dq_crosscheck"])
def dq_crosscheck_falla(spark, sf):
    """Every order of the month table counted twice."""
    now = segments(spark, sf)
    return quality.check_monthly(season.monthly(order_window(spark, sf), now).withColumn("pedidos", F.col("pedidos") * 2), now)


@query(SPECS["dq_diario"])
def dq_diario_falla(spark, sf):
    return quality.check_daily(daily(spark, sf).where("segmento IN ('MVPs', 'Hibernando')"))


@query("chequeo:s n:i porcentaje:d6 ok:b")
def dq_escrituras(spark, sf):
    """The same checks from what the writes of the three tables saw, without reading them again."""
    version = versions.Version(spark, fresh_path(spark, "checked"))
    scored, of_segments = quality.observe_segments(segments(spark, sf), SEGMENT_ORDER)
    version.replace_all("segmentos", scored)
    now = version.new("segmentos")
    months, of_months = quality.observe_orders(season.monthly(order_window(spark, sf), now), SEGMENT_ORDER, "segmento_cluster")
    days, of_days = quality.observe_orders(daily(spark, sf), SEGMENT_ORDER, "segmento")
    version.replace_all("meses", months)
    version.replace_all("dias", days)
    seen = of_segments.get
    whole, shares = quality.check_observed_segments(spark, seen, SEGMENT_ORDER)
    found = (
        ("segmentos", whole, "n_clientes", None), ("distribucion", shares, None, "max_pct"),
        ("mensual", quality.check_observed_monthly(spark, of_months.get, seen), "pedidos_temporal", "diferencia_pct"),
        ("diario", quality.check_observed_daily(spark, of_days.get), "pedidos", None))
    rows = [
        check.select(F.lit(name).alias("chequeo"), (F.col(n) if n else F.lit(None)).cast("bigint").alias("n"),
                     (F.col(p) if p else F.lit(None)).cast("double").alias("porcentaje"), "ok")
        for name, check, n, p in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("n_comunes:i coincidencia:d6 alerta:b")
def drift_coincidencia(spark, sf):
    return quality.drift_agreement(segments(spark, sf), snapshot(spark, sf))


@query("segmento:s pct_actual:d6 pct_anterior:d6 cambio_pp:d6 alerta:b")
def drift_pp(spark, sf):
    return quality.drift_points(segments(spark, sf), snapshot(spark, sf))


@query("cliente_id:s revenue_items:d4 monetary:d4 diferencia:d6 ok:b")
def dq_revenue(spark, sf):
    return quality.revenue_reconciliation(m.items(spark, sf), segments(spark, sf))


@query("cliente_id:s monetary:d4 pct_clientes_acum:d6 pct_revenue_acum:d6")
def pareto(spark, sf):
    return explore.pareto(segments(spark, sf))


@query("n_clientes:i revenue_top:d4 pct_revenue:d6")
def top10_share(spark, sf):
    return explore.top_share(segments(spark, sf))


@query("familia:s n_claves:i n_lineas:i")
def cardinalidad(spark, sf):
    return explore.sku_cardinality(m.items(spark, sf))


@query("bin:i n_pedidos:i revenue:d4 desde_log10:d4")
def ticket_hist(spark, sf):
    return explore.ticket_histogram(m.orders(spark, sf))


@query("segmento:s monetary_med:d4 indice:d4")
def monetary_index(spark, sf):
    return explore.monetary_index(segments(spark, sf))


# --- streams and the job -------------------------------------------------------------------------


def drained_documents(spark, sf) -> str:
    """The documents as JSON files, drained by the stream into the order and line history."""
    folder, root, progress = (fresh_path(spark, n) for n in ("json", "history", "progress"))
    write_texts(m.documents(spark, sf), folder)
    stream_ingest.start_ingest(stream_ingest.document_stream(spark, folder), root, progress).awaitTermination()
    return root


@query(ORDER_SPEC)
def stream_ingest_orders(spark, sf):
    return tables.load_table(spark, drained_documents(spark, sf), tables.VIEWS["orders"])


@query(ITEM_SPEC + " precio_mxn:d4 subtotal_mxn:d4 familia:s")
def stream_ingest_items(spark, sf):
    """The lines that the same stream stores."""
    return tables.load_table(spark, drained_documents(spark, sf), tables.VIEWS["items"])


QUERIES["stream_ingest"] = QUERIES.pop("stream_ingest_orders")
SPECS["stream_ingest"] = SPECS.pop("stream_ingest_orders")


def drained_days(spark, sf) -> str:
    """The events as a stream of files in two deliveries that overlap in time: a good part of the second is late."""
    files, root, progress = (fresh_path(spark, n) for n in ("events", "days", "progress"))
    events = m.event_orders(spark, sf).withColumn("_odd", F.col("order_id").cast("bigint") % 2)
    schema = "order_id string, cliente_id string, fecha timestamp, pago_total double"
    for odd in (0, 1):
        events.where(F.col("_odd") == odd).drop("_odd").write.mode("append").parquet(files)
        arriving = spark.readStream.schema(schema).parquet(files)
        stream_daily.start_daily(arriving, m.event_segments(spark, sf), root, progress, LATE_BY).awaitTermination()
    return root


LATE_BY = "7 days"


@query("fecha_dia:D segmento:s pedidos:i revenue:d4")
def stream_daily_orders(spark, sf):
    """Every event counts, late or not: the result equals the batch table."""
    return stream_daily.read_daily(spark, drained_days(spark, sf))


@query("order_id:s cliente_id:s fecha:s pago_total:d4")
def stream_late_orders(spark, sf):
    return stream_daily.late_orders(spark, drained_days(spark, sf))


QUERIES["stream_daily"] = QUERIES.pop("stream_daily_orders")
SPECS["stream_daily"] = SPECS.pop("stream_daily_orders")


@query("modo:s orden:i paso:s estado:s error:s")
def pipeline_runs(spark, sf):
    """A weekly run with ingest and rules, then a daily one that reuses the rules, then a monthly one: one row per step."""
    limits = {"min_support_count": 10, "min_support_pct": 0.001, "min_confidence": 0.02, "min_lift": 1.2}
    root = fresh_path(spark, "pipeline")
    source = stage(parsed(spark, sf), "documents")
    out = None
    for mode, day in (("weekly", m.AS_OF), ("daily", m.AS_OF + timedelta(days=1)), ("monthly", m.AS_OF + timedelta(days=2))):
        rows = job.run_pipeline(spark, root, source, mode, day, rule_limits=limits).to_frame(spark)
        out = rows if out is None else out.unionByName(rows)
    return out
