"""Totals per customer and quarter hour, kept up to date by what each load changes.

The hour, month and day tables are sums over orders. Every load knows which order rows it took away and which it put in their
place; adding these signed rows to the stored totals of the months they lie in gives the totals of the new history
without reading the history. Segments change with every run, so totals are kept per customer and meet the
segments when a table is asked for. A quarter of an hour is the finest step of any time zone in use, so local hours, days
and months are sums of whole quarters; the quarters that a window cuts are taken from the orders themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.functions.timeparts import as_utc, days_before, instant, time_features, window_start
from custscope.operators import season
from custscope.schema import LOCAL_TIMEZONE
from custscope.sources import versions
from custscope.sources.tables import MONTH_COLUMN, UNDATED, VIEWS
from custscope.sources.versions import Version

TOTALS = "totales_cuarto_hora"
QUARTER = 900
#: Sums are exact decimals, so that taking an order away leaves nothing behind.
MONEY = "decimal(38,9)"
_KEYS = [MONTH_COLUMN, "cliente_id", "cuarto"]


def quarter_of(time: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / QUARTER) * QUARTER)


def _sums(sign: Column) -> list[Column]:
    return [
        F.sum(sign).cast("bigint").alias("filas"),
        F.sum(F.when(F.col("order_id").isNotNull(), sign).otherwise(0)).cast("bigint").alias("pedidos"),
        F.coalesce(F.sum(sign * F.col("pago_total").cast(MONEY)), F.lit(0)).cast(MONEY).alias("revenue"),
    ]


def order_totals(orders: DataFrame, sign: Column | None = None) -> DataFrame:
    """(mes, cliente_id, cuarto, filas, pedidos, revenue) of order rows, or of signed ones."""
    return orders.where("fecha IS NOT NULL").groupBy(MONTH_COLUMN, "cliente_id", quarter_of(F.col("fecha")).alias("cuarto")).agg(
        *_sums(F.lit(1) if sign is None else sign))


def add_changes(version: Version, changes: DataFrame) -> list[str]:
    """Adds signed order rows to the stored totals; reads and writes only the months that the rows lie in, and names them."""
    delta = order_totals(changes, F.col("signo"))
    months = sorted(r[0] for r in changes.select(MONTH_COLUMN).distinct().collect() if r[0] != UNDATED)
    old = version.old(TOTALS, months)
    both = delta if old is None else delta.unionByName(old.select(delta.columns))
    summed = both.groupBy(*_KEYS).agg(
        F.sum("filas").cast("bigint").alias("filas"), F.sum("pedidos").cast("bigint").alias("pedidos"), F.sum("revenue").cast(MONEY).alias("revenue"))
    version.replace(TOTALS, summed.where("filas <> 0"), MONTH_COLUMN, months)
    return months


def in_window(totals: DataFrame, orders: DataFrame, as_of, start: Column) -> DataFrame:
    """(cliente_id, fecha, filas, pedidos, revenue) from `start` to `as_of`: whole quarters, and orders of the cut ones."""
    end = instant(as_of)
    first_cut, last_cut = quarter_of(start), quarter_of(end)
    months = lambda a, b: F.col(MONTH_COLUMN).between(F.date_format(a, "yyyy-MM"), F.date_format(b, "yyyy-MM"))
    whole = totals.where((F.col("cuarto") > first_cut) & (F.col("cuarto") < last_cut) & months(start, end))
    time = F.col("fecha")
    cut = orders.where(
        (time >= start) & (time <= end) & quarter_of(time).isin(first_cut, last_cut)
        & (F.col(MONTH_COLUMN).isin(F.date_format(first_cut, "yyyy-MM"), F.date_format(last_cut, "yyyy-MM"))))
    return whole.select("cliente_id", F.col("cuarto").alias("fecha"), "filas", "pedidos", "revenue").unionByName(
        order_totals(cut).select("cliente_id", F.col("cuarto").alias("fecha"), "filas", "pedidos", "revenue"))


def season_tables(
    totals: DataFrame, orders: DataFrame, segments: DataFrame, as_of=None, months: int = season.MONTHS,
    days_back: int = season.DAILY_WINDOW, tz: str = LOCAL_TIMEZONE,
) -> dict[str, DataFrame]:
    """The hour, month and day tables of `season`, from the totals; equal to those over all orders."""
    now = as_utc(as_of)
    window = time_features(in_window(totals, orders, now, window_start(now, months)), "fecha", tz)
    recent = in_window(totals, orders, now, days_before(now, days_back))
    return {
        "hora_dia": season.hour_by_weekday_of(window.groupBy("cliente_id", "dia_semana", "hora").agg(F.sum("filas").alias("pedidos")), segments),
        "mensual": season.monthly_of(window.groupBy("cliente_id", "año_mes").agg(*_orders_and_money()), segments),
        "diario": season.daily_of(
            recent.groupBy("cliente_id", F.to_date(season.local_time(F.col("fecha"), tz)).alias("fecha_dia")).agg(*_orders_and_money()), segments),
    }


def _orders_and_money() -> list[Column]:
    return [F.sum("pedidos").alias("pedidos"), F.sum("revenue").cast("double").alias("revenue")]


def stored_season_tables(spark: SparkSession, root: str, segments: DataFrame, as_of=None, **options) -> dict[str, DataFrame] | None:
    """`season_tables` of the newest version; None where it has no totals."""
    of = versions.manifest(spark, root)
    if TOTALS not in of.tables:
        return None
    orders = versions.read(spark, root, VIEWS["orders"], of)
    return season_tables(versions.read(spark, root, TOTALS, of), orders, segments, as_of, **options)
