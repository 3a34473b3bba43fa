"""Questions about seasonality: shares, typical months, and this month against the last."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custscope.functions.guards import segment_list
from custscope.functions.labels import share
from custscope.functions.timeparts import as_day, weekday_name


def _chosen(df: DataFrame, segments: str | Iterable[str] | None, column: str = "segmento_cluster") -> DataFrame:
    """All segments where none is named, also those beyond the usual five."""
    if not segments:
        return df.where(F.col(column).isNotNull())
    return df.where(F.col(column).isin(segment_list(segments)))


def hour_weekday_share(hour_day: DataFrame, segments=None) -> DataFrame:
    """Each cell as a share of its segment, so that segments of any size compare."""
    chosen = _chosen(hour_day, segments)
    totals = chosen.groupBy("segmento_cluster").agg(F.sum("pedidos").alias("_total"))
    return (
        chosen.join(totals, "segmento_cluster")
        .select(
            F.col("segmento_cluster").alias("segmento"), "dia_semana", "dia_nombre", "hora", "pedidos",
            share(F.col("pedidos"), F.col("_total")).alias("pct"),
        )
        .orderBy("segmento", "dia_semana", "hora")
    )


def _marginal(shares: DataFrame, key: str, size: int) -> DataFrame:
    """Percent per value of the key for each segment present, missing values as 0."""
    present = shares.select("segmento").distinct()
    spine = present.select("segmento", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(key))
    sums = shares.groupBy("segmento", F.col(key).cast("int").alias(key)).agg(F.sum("pct").alias("_pct"))
    return spine.join(sums, ["segmento", key], "left").select(
        "segmento", key, (F.coalesce("_pct", F.lit(0.0)) * 100).alias("pct")
    )


def share_by_hour(shares: DataFrame) -> DataFrame:
    return _marginal(shares, "hora", 24)


def share_by_weekday(shares: DataFrame) -> DataFrame:
    return _marginal(shares, "dia_semana", 7).withColumn("dia_nombre", weekday_name(F.col("dia_semana")))


def monthly_series(monthly: DataFrame, segments=None) -> DataFrame:
    return _chosen(monthly, segments).select(
        F.col("segmento_cluster").alias("segmento"), F.col("año_mes").alias("ano_mes"), "pedidos", "revenue"
    ).orderBy("ano_mes", "segmento")


def typical_months(monthly: DataFrame, segments=None) -> DataFrame:
    """Mean orders per calendar month over the years."""
    return (
        _chosen(monthly, segments)
        .groupBy(F.col("segmento_cluster").alias("segmento"), F.substring("año_mes", 6, 2).cast("int").alias("mes"))
        .agg(F.avg("pedidos").alias("pedidos_promedio"))
        .orderBy("segmento", "mes")
    )


def _month_back(day: date) -> date:
    """The same day one month before, or the last day of that month."""
    last = day.replace(day=1) - timedelta(days=1)
    return last.replace(day=min(day.day, last.day))


def _this_month(as_of) -> Column:
    return F.trunc("fecha_dia", "month") == F.lit(as_day(as_of).replace(day=1))


def _same_days_last_month(as_of) -> Column:
    end = _month_back(as_day(as_of))
    return F.col("fecha_dia").between(F.lit(end.replace(day=1)), F.lit(end))


def _day_rows(days: DataFrame) -> DataFrame:
    return days.select(
        F.col("fecha_dia").cast("string").alias("fecha_dia"), "segmento", "pedidos", "revenue"
    ).orderBy("fecha_dia", "segmento")


def current_month(daily: DataFrame, as_of=None) -> DataFrame:
    return _day_rows(daily.where(_this_month(as_of)))


def previous_month_same_days(daily: DataFrame, as_of=None) -> DataFrame:
    """Last month from its first day to the day that matches `as_of`."""
    return _day_rows(daily.where(_same_days_last_month(as_of)))


def monthly_change(daily: DataFrame, as_of=None) -> DataFrame:
    """Orders of this month against the same days of the last, per segment present in either.

    One conditional aggregate over the days of both months; the two ranges never overlap.
    """
    now, before = _this_month(as_of), _same_days_last_month(as_of)
    sums = (
        daily.where(now | before).groupBy("segmento").agg(
            F.coalesce(F.sum(F.when(now, F.col("pedidos"))), F.lit(0)).alias("pedidos_actual"),
            F.coalesce(F.sum(F.when(before, F.col("pedidos"))), F.lit(0)).alias("pedidos_anterior"),
        )
    )
    return sums.withColumn("variacion_pct", _change("pedidos_actual", "pedidos_anterior")).orderBy("segmento")


def _change(now: str, before: str) -> Column:
    return F.try_divide((F.col(now) - F.col(before)) * F.lit(100.0), F.col(before).cast("double"))


def total_change(daily: DataFrame, as_of=None) -> DataFrame:
    return (
        monthly_change(daily, as_of)
        .agg(
            F.coalesce(F.sum("pedidos_actual"), F.lit(0)).alias("total_actual"),
            F.coalesce(F.sum("pedidos_anterior"), F.lit(0)).alias("total_anterior"),
        )
        .withColumn("total_variacion_pct", _change("total_actual", "total_anterior"))
    )


def aligned_months(daily: DataFrame, as_of=None) -> DataFrame:
    """Both months side by side by day number; either side may be missing."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("segmento", F.dayofmonth("fecha_dia").alias("dia")).agg(F.sum("pedidos").alias(name))

    return side(daily.where(_this_month(as_of)), "pedidos_actual").join(
        side(daily.where(_same_days_last_month(as_of)), "pedidos_anterior"), ["segmento", "dia"], "full"
    )

