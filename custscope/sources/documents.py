"""Scans over nested order documents (one JSON object per order)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.functions.labels import string_array
from custscope.functions.timeparts import instant
from custscope.schema import (
    CANCELLED_STATUSES, CORRUPT, DOCUMENT, INVOICED_STATUS, ONLINE_ORDER_TYPE, SINGLE_LINE_DOCUMENT,
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the explicit document schema; blank lines are no documents."""
    return parse_documents(spark.read.text(path).where(F.trim("value") != ""))


def parse_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents that arrive as JSON text in a column, one row per text, with the text itself where it cannot be read.

    A cut or malformed text, one that is no object, or one with a value of another shape keeps only its text, in
    `_corrupto`. A single product that stands without its list counts as a list of one.
    """
    options = {"columnNameOfCorruptRecord": CORRUPT}
    text = F.col("_text")
    names = ["_id", "errores", "estatus", "pedido"]
    listed = F.from_json(text, f"{DOCUMENT}, {CORRUPT} string", options)
    readable = lambda d: d.isNotNull() & d[CORRUPT].isNull() & F.ltrim(text).startswith("{")
    once = texts.select(F.col(column).alias("_text")).withColumn("_d", listed).withColumn("_ok", F.coalesce(readable(F.col("_d")), F.lit(False)))
    again = once.withColumn("_s", F.from_json(F.when(~F.col("_ok"), text), f"{SINGLE_LINE_DOCUMENT}, {CORRUPT} string", options))
    single = F.coalesce(readable(F.col("_s")) & F.col("_s.pedido.detalle.producto").isNotNull(), F.lit(False))
    order = F.struct(
        F.col("_s.pedido.tipo").alias("tipo"), F.col("_s.pedido.fecha").alias("fecha"), F.col("_s.pedido.encabezado").alias("encabezado"),
        F.struct(F.array("_s.pedido.detalle.producto").alias("producto")).alias("detalle"))
    wrapped = F.struct(*[F.col(f"_s.{n}").alias(n) for n in names[:-1]], order.alias("pedido"))
    whole = F.struct(*[F.col(f"_d.{n}").alias(n) for n in names])
    parsed = again.select(
        F.when(F.col("_ok"), whole).when(single, wrapped).alias("d"), (F.col("_ok") | single).alias("_ok"), "_text")
    return parsed.select("d.*", F.when(~F.col("_ok"), F.coalesce(text, F.lit(""))).alias(CORRUPT))


def corrupt(docs: DataFrame) -> Column:
    """The text of a document that could not be read; NULL for all others, and for tables that were never text."""
    return F.col(CORRUPT) if CORRUPT in docs.columns else F.lit(None).cast("string")


def not_cancelled(statuses: Sequence[str] = CANCELLED_STATUSES) -> Column:
    """No cancelled status key exists; a document without statuses is not cancelled."""
    keys = F.map_keys(F.col("estatus"))
    return ~F.coalesce(F.arrays_overlap(keys, string_array(list(statuses))), F.lit(False))


def invoiced() -> Column:
    return F.coalesce(F.array_contains(F.map_keys(F.col("estatus")), INVOICED_STATUS), F.lit(False))


def plain(c: Column) -> Column:
    """A scalar as its own text: `{"$oid":"a"}`, `{"$date":"…"}` and `{"$numberLong":"3"}` give what they hold."""
    inner = F.regexp_extract(c, r'"\$\w+"\s*:\s*"?([^"{}]*?)"?\s*\}+$', 1)
    return F.when(c.startswith('{"$'), inner).otherwise(c)


def document_time() -> Column:
    """The order time: plain text, or `$date` with text or epoch milliseconds. NULL where neither can be read."""
    raw = F.col("pedido.fecha")
    text = plain(raw)
    millis = F.when(raw.startswith('{"$') & text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
    return F.when(millis.isNotNull(), F.timestamp_millis(millis)).otherwise(F.try_to_timestamp(text))


def document_id() -> Column:
    return plain(F.col("_id"))


def _is_sold() -> Column:
    return F.coalesce(F.col("pedido.tipo") == ONLINE_ORDER_TYPE, F.lit(False)) & not_cancelled() & invoiced()


def sold(docs: DataFrame) -> DataFrame:
    """Online orders that were invoiced and not cancelled."""
    return docs.where(_is_sold())


# What becomes of a document in a load.
PENDING, OUTSIDE, OTHER, REJECTED = "pendiente", "fuera", "otro", "rechazado"


def reject_reason(docs: DataFrame) -> Column:
    """Why a document cannot be loaded: no readable JSON, or a sold order without id or readable time. NULL otherwise."""
    return (
        F.when(corrupt(docs).isNotNull(), "json")
        .when(~_is_sold(), None)
        .when(document_id().isNull(), "sin_id")
        .when(document_time().isNull(), "sin_fecha")
    )


def document_class(docs: DataFrame, watermark: datetime | None = None, until: datetime | None = None) -> Column:
    """Each document is one of: rejected, not sold, sold outside the range of the load, pending."""
    time = document_time()
    inside = F.lit(True) if until is None else time <= instant(until)
    inside = inside if watermark is None else inside & (time > instant(watermark))
    return (
        F.when(reject_reason(docs).isNotNull(), REJECTED).when(~_is_sold(), OTHER).when(inside, PENDING).otherwise(OUTSIDE)
    )


def scan_range(docs: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Sold documents from the first second of `start` to the last second of `end`, in UTC."""
    first = date.fromisoformat(start) if isinstance(start, str) else start
    last = date.fromisoformat(end) if isinstance(end, str) else end
    last_second = datetime(last.year, last.month, last.day) + timedelta(hours=23, minutes=59, seconds=59)
    time = document_time()
    return sold(docs).where(
        (time >= instant(datetime(first.year, first.month, first.day))) & (time <= instant(last_second))
    )


def scan_incremental(
    docs: DataFrame, watermark: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """Sold documents strictly after the high-water mark; no mark means full history."""
    time = document_time()
    out = sold(docs).where(time <= instant(until))
    return out if watermark is None else out.where(time > instant(watermark))


def pending_count(
    docs: DataFrame, watermark: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    return scan_incremental(docs, watermark, until).agg(F.count(F.lit(1)).alias("n_pendientes"))


def quick_sample(docs: DataFrame, n: int = 5) -> DataFrame:
    """The first n documents of the right type that are not cancelled (invoiced or not)."""
    return docs.where((F.col("pedido.tipo") == ONLINE_ORDER_TYPE) & not_cancelled()).limit(n)
