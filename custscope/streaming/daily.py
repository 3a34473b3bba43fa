"""Daily orders and money per segment, kept up to date by a stream of orders that loses no late one."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from custscope.functions.timeparts import instant, local_time, month_key
from custscope.schema import LOCAL_TIMEZONE
from custscope.sources import versions
from custscope.sources.staging import stage
from custscope.sources.tables import MONTH_COLUMN
from custscope.sources.versions import Version

DAYS = "diario_flujo"
LATE = "tardios"
BATCH = "lote"
MONEY = "decimal(38,9)"


def day_totals(orders: DataFrame, segments: DataFrame, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """(fecha_dia, segmento, pedidos, revenue, mes) of order rows; totals per customer come first, so a hot customer joins as a few rows."""
    per = orders.where("fecha IS NOT NULL").groupBy("cliente_id", F.to_date(local_time(F.col("fecha"), tz)).alias("fecha_dia")).agg(
        F.count("order_id").alias("pedidos"), F.coalesce(F.sum(F.col("pago_total").cast(MONEY)), F.lit(0)).cast(MONEY).alias("revenue"))
    named = per.join(segments.select("cliente_id", F.col("segmento_cluster").alias("segmento")), "cliente_id")
    return _added(named).withColumn(MONTH_COLUMN, month_key(F.col("fecha_dia")))


def _added(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("fecha_dia", "segmento", *more).agg(
        F.sum("pedidos").alias("pedidos"), F.sum("revenue").cast(MONEY).alias("revenue"))


def merge_batch(
    spark: SparkSession, root: str, batch: DataFrame, stream: tuple[str, int], segments: DataFrame, late_by: str, tz: str = LOCAL_TIMEZONE
) -> int:
    """Adds the day totals of one batch to the stored ones and publishes them; returns how many orders were late.

    The totals of a batch are added to the months it touches, however old they are, so no state has to be kept open and
    nothing behind a watermark is lost. Orders older than the newest order of earlier batches by more than
    `late_by`, and orders without a time, which no day holds, are also written to `tardios`. A batch that was
    published before is left out.
    """
    version = Version(spark, root)
    done = dict(version.base.notes.get("dias", {}))
    if done.get(stream[0], -1) >= stream[1]:
        return 0
    rows = stage(batch.select("order_id", "cliente_id", "fecha", "pago_total"), "batch")
    mark = version.base.notes.get("marca")
    newest = rows.agg(F.max(F.unix_micros("fecha"))).first()[0]
    fresh = stage(day_totals(rows, segments, tz), "days")
    months = sorted(r[0] for r in fresh.select(MONTH_COLUMN).distinct().collect())
    old = version.old(DAYS, months)
    both = fresh if old is None else fresh.unionByName(old.select(fresh.columns))
    version.replace(DAYS, _added(both, MONTH_COLUMN), MONTH_COLUMN, months)
    behind = F.lit(False) if mark is None else F.col("fecha") < instant(_moment(mark)) - F.expr(f"INTERVAL {late_by}")
    late = stage(rows.where(F.col("fecha").isNull() | behind).withColumn(BATCH, F.lit(str(version.number))), "late")
    n_late = late.count()
    if n_late:
        version.replace(LATE, late, BATCH, [str(version.number)])
    done[stream[0]] = stream[1]
    known = [m for m in (mark, newest) if m is not None]
    version.publish(dias=done, marca=max(known) if known else None, tardios=version.base.notes.get("tardios", 0) + n_late)
    return n_late


def _moment(micros: int) -> datetime:
    return datetime.fromtimestamp(micros / 1_000_000, tz=timezone.utc)


def start_daily(
    orders: DataFrame, segments: DataFrame, root: str, checkpoint: str, late_by: str, tz: str = LOCAL_TIMEZONE
) -> StreamingQuery:
    """Adds every new order once and stops when the source is drained. `late_by` only decides what is reported as late."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, root, batch, (checkpoint, batch_id), segments, late_by, tz)

    return orders.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily(spark: SparkSession, root: str) -> DataFrame | None:
    """(fecha_dia, segmento, pedidos, revenue) of the newest version."""
    days = versions.read(spark, root, DAYS)
    return None if days is None else days.select("fecha_dia", "segmento", "pedidos", F.col("revenue").cast("double").alias("revenue"))


def late_orders(spark: SparkSession, root: str) -> DataFrame | None:
    """The late orders, with the number of the version that took them in."""
    return versions.read(spark, root, LATE)


def late_count(spark: SparkSession, root: str) -> int:
    return versions.manifest(spark, root).notes.get("tardios", 0)
