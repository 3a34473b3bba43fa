"""The driver's Parquet tables seen through the engine's contracts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.operators.flatten import add_family, enrich_items

AS_OF = datetime(2001, 8, 2, tzinfo=timezone.utc)
SNAPSHOT_AS_OF = datetime(2001, 7, 2, tzinfo=timezone.utc)
EVENTS_AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)

# Times are read as instants in UTC, so window filters reach the Parquet scan.
_COLUMNS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double",
    "part": "p_partkey bigint, p_name string, p_type string",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double",
}

# Market segment of the customer table to segment name.
PROXY_SEGMENTS = {
    "AUTOMOBILE": "MVPs",
    "BUILDING": "Alto Valor",
    "FURNITURE": "Ocasionales",
    "HOUSEHOLD": "En Riesgo",
    "MACHINERY": "Hibernando",
}


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read as it is split."""
    return use_utc(spark).read.schema(_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("cliente_id"),
        F.col("o_orderdate").alias("fecha"),
        F.col("o_totalprice").alias("pago_total"),
    )


def _sku(part: Column, name: Column) -> Column:
    made = F.concat(
        F.upper(F.replace(name, F.lit(" "), F.lit(""))),
        F.lpad(part.cast("string"), 6, "0"),
    )
    return (
        F.when(part % 50 == 0, F.lit("CARGO100"))
        .when(part % 97 == 1, F.lit(None).cast("string"))
        .otherwise(made)
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = source(spark, sf_dir, "lineitem"), source(spark, sf_dir, "part")
    headers = source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(headers, lines.l_orderkey == headers.o_orderkey)
        .select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("cliente_id"),
            F.col("o_orderdate").alias("fecha"),
            _sku(F.col("l_partkey"), F.col("p_name")).alias("clave"),
            F.col("l_quantity").alias("cantidad"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_final"),
            F.when(F.col("l_suppkey") % 4 == 0, "USD").otherwise("MXN").alias("moneda"),
            (F.lit(17.0) + (F.col("l_orderkey") % 5) * F.lit(0.25)).alias("valor_dolar"),
            F.col("l_linenumber").alias("posicion"),
            F.col("p_type"),
        )
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_family(enrich_items(raw_items(spark, sf_dir)))


def type_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six wide families (the part type): baskets with frequent sets of every size."""
    return raw_items(spark, sf_dir).withColumn("familia", F.col("p_type"))


def proxy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(v) for pair in PROXY_SEGMENTS.items() for v in pair])
    return source(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("cliente_id"),
        F.element_at(names, F.col("c_mktsegment")).alias("segmento_cluster"),
    )


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as orders with a time of day."""
    return source(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("order_id"),
        F.col("user_id").cast("string").alias("cliente_id"),
        F.col("ts").alias("fecha"),
        F.col("value").alias("pago_total"),
    )


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from custscope.schema import SEGMENT_ORDER

    names = F.array(*[F.lit(s) for s in SEGMENT_ORDER])
    return (
        source(spark, sf_dir, "events").select("user_id").distinct()
        .select(
            F.col("user_id").cast("string").alias("cliente_id"),
            F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("segmento_cluster"),
        )
    )


def _line(x: Column) -> Column:
    part = x["l_partkey"]
    return F.struct(
        x["l_linenumber"].alias("l_linenumber"),
        part.alias("l_partkey"),
        F.struct(
            _sku(part, x["p_name"]).alias("clave"),
            F.when(part % 31 == 0, F.lit("n/d")).otherwise(x["l_quantity"].cast("string")).alias("cantidad"),
            x["l_extendedprice"].cast("string").alias("precioFinal"),
            F.when(x["l_dollar"], "USD").otherwise("MXN").alias("moneda"),
            (part % 7).cast("string").alias("promocion_id"),
            F.when(part % 3 == 0, "x").otherwise("2").alias("promocion_tipo"),
        ).alias("producto"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines as JSON texts in the raw document shape, one row per order.

    A document holds the lines of one order by definition, so nesting them is the input format
    and not a choice; document stores cap the size of a document.
    """
    # Lines travel as the numbers they hold; their texts, several times as large, are made once they lie together.
    lines = (
        source(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", (F.col("l_suppkey") % 4 == 0).alias("l_dollar"))
        .join(source(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey").agg(F.collect_list(
            F.struct("l_linenumber", "l_partkey", "p_name", "l_quantity", "l_extendedprice", "l_dollar")).alias("lineas"))
        .select("l_orderkey", F.sort_array(F.transform("lineas", _line)).alias("lineas"))
    )
    head = source(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.map_concat(
        F.when(key % 11 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.expr("map('Facturado', 'si')")),
        F.when(F.col("o_orderstatus") == "P", F.expr("map('Cancelado', 'si')"))
        .otherwise(F.expr("map('Enviado', 'si')")),
    )
    return (
        head.join(lines, key == F.col("l_orderkey"), "left")
        .select(F.to_json(F.struct(
            key.cast("string").alias("_id"),
            F.when(key % 13 == 0, F.array(F.lit("e1"))).otherwise(F.expr("cast(array() as array<string>)")).alias("errores"),
            status.alias("estatus"),
            F.struct(
                F.when(key % 10 == 3, "Mostrador").otherwise("CTonline").alias("tipo"),
                F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fecha"),
                F.struct(
                    F.col("o_custkey").cast("string").alias("cliente"),
                    F.concat(F.lit("Cliente "), F.col("o_custkey").cast("string")).alias("nombre"),
                    F.when(key % 17 == 0, F.lit("gratis"))
                    .otherwise(F.col("o_totalprice").cast("string")).alias("pago"),
                    (F.lit(17.0) + (key % 5) * F.lit(0.25)).cast("string").alias("tipodecambio"),
                    F.lit("16").alias("iva"),
                    (key % 4).cast("string").alias("plazo"),
                    F.col("o_orderpriority").alias("tipoPago"),
                ).alias("encabezado"),
                F.struct(F.col("lineas.producto").alias("producto")).alias("detalle"),
            ).alias("pedido"),
        )).alias("value"))
    )


def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts, every 29th cut off and every 37th with a time that cannot be read."""
    key = F.get_json_object("value", "$._id").cast("bigint")
    return documents(spark, sf_dir).withColumn("value", (
        F.when(key % 29 == 0, F.expr("substring(value, 1, length(value) - 7)"))
        .when(key % 37 == 0, F.regexp_replace("value", '"fecha":"[^"]*"', '"fecha":"n/d"'))
        .otherwise(F.col("value"))))
