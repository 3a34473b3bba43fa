"""When customers buy: hour by weekday, month, day and bundle by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custscope.functions.guards import require_columns
from custscope.functions.labels import rule_arrow
from custscope.functions.timeparts import days_before, instant, local_time, time_features, weekday_name, window_start
from custscope.operators.basket import lists_matching, top_by_lift
from custscope.schema import LOCAL_TIMEZONE
from custscope.sources.staging import stage

TOP_BUNDLES = 20
DAILY_WINDOW = 90
MONTHS = 30


def _windowed(orders: DataFrame, as_of, start) -> DataFrame:
    require_columns(orders, ["order_id", "cliente_id", "fecha", "pago_total"], "orders")
    return orders.where((F.col("fecha") >= start) & (F.col("fecha") <= instant(as_of)))


def orders_in_window(orders: DataFrame, as_of=None, months: int = MONTHS, tz: str = LOCAL_TIMEZONE) -> DataFrame:
    """Orders of the trailing window, capped at `as_of`, with their local-time features."""
    return time_features(_windowed(orders, as_of, window_start(as_of, months)), "fecha", tz)


def _per_segment(customer_totals: DataFrame, segments: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Adds the segment to totals per customer and sums them up.

    The totals come first: a customer with a third of all orders joins as at most one row per
    key instead of one row per order.
    """
    require_columns(segments, ["cliente_id", "segmento_cluster"], "segments")
    return (
        customer_totals.join(segments.select("cliente_id", "segmento_cluster"), "cliente_id")
        .groupBy("segmento_cluster", *keys).agg(*[F.sum(s).alias(s) for s in sums])
    )


def hour_by_weekday(windowed: DataFrame, segments: DataFrame) -> DataFrame:
    return hour_by_weekday_of(windowed.groupBy("cliente_id", "dia_semana", "hora").agg(F.count(F.lit(1)).alias("pedidos")), segments)


def hour_by_weekday_of(per: DataFrame, segments: DataFrame) -> DataFrame:
    """The table of totals per customer, weekday and hour."""
    return _per_segment(per, segments, ["dia_semana", "hora"], ["pedidos"]).select(
        "segmento_cluster", "dia_semana", weekday_name(F.col("dia_semana")).alias("dia_nombre"), "hora", "pedidos"
    )


def _orders_and_money():
    return [
        F.count("order_id").alias("pedidos"),
        F.coalesce(F.sum("pago_total"), F.lit(0.0)).alias("revenue"),
    ]


def monthly(windowed: DataFrame, segments: DataFrame) -> DataFrame:
    return monthly_of(windowed.groupBy("cliente_id", "año_mes").agg(*_orders_and_money()), segments)


def monthly_of(per: DataFrame, segments: DataFrame) -> DataFrame:
    """The table of totals per customer and month."""
    return _per_segment(per, segments, ["año_mes"], ["pedidos", "revenue"])


def daily(
    orders: DataFrame, segments: DataFrame, as_of=None, days_back: int = DAILY_WINDOW, tz: str = LOCAL_TIMEZONE
) -> DataFrame:
    """Orders and money per local day and segment over the last days."""
    recent = _windowed(orders, as_of, days_before(as_of, days_back))
    per = recent.groupBy(
        "cliente_id", F.to_date(local_time(F.col("fecha"), tz)).alias("fecha_dia")
    ).agg(*_orders_and_money())
    return daily_of(per, segments)


def daily_of(per: DataFrame, segments: DataFrame) -> DataFrame:
    """The table of totals per customer and local day."""
    return (
        _per_segment(per, segments, ["fecha_dia"], ["pedidos", "revenue"])
        .select("fecha_dia", F.col("segmento_cluster").alias("segmento"), "pedidos", "revenue")
        .orderBy("fecha_dia", "segmento")
    )


def bundles_by_month(
    windowed: DataFrame, segments: DataFrame, items: DataFrame, rules: DataFrame, top_n: int = TOP_BUNDLES
) -> DataFrame:
    """Monthly orders and money of the top rules of each segment.

    Any order that holds all families counts, whatever the segment of its customer, as long as
    the customer has one. All rules are matched in one pass.
    """
    require_columns(items, ["order_id", "familia"], "items")
    require_columns(rules, ["segmento", "antecedents", "consequents", "lift"], "rules")
    top = stage(top_by_lift(rules.select("segmento", "antecedents", "consequents", "lift"), top_n), "bundles")
    priced = windowed.join(segments.select("cliente_id"), "cliente_id", "left_semi").select(
        "order_id", "año_mes", "pago_total"
    )
    held, lists = lists_matching(top, items)
    of_lists = held.join(priced, "order_id").groupBy("_list", "año_mes").agg(
        F.count("pago_total").alias("pedidos"), F.sum("pago_total").alias("revenue"))
    matched = (
        lists.join(of_lists, "_list").groupBy("antecedents", "consequents", "año_mes")
        .agg(F.sum("pedidos").alias("pedidos"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    )
    return matched.join(top, ["antecedents", "consequents"]).select(
        rule_arrow(F.col("antecedents"), F.col("consequents")).alias("regla"),
        F.col("segmento").alias("segmento_regla"), "año_mes", "pedidos", "revenue",
    )


def seasonality(
    orders: DataFrame,
    segments: DataFrame,
    items: DataFrame,
    rules: DataFrame,
    as_of=None,
    months: int = MONTHS,
    top_bundles: int = TOP_BUNDLES,
    tz: str = LOCAL_TIMEZONE,
) -> dict[str, DataFrame]:
    windowed = orders_in_window(orders, as_of, months, tz)
    return {
        "hora_dia": hour_by_weekday(windowed, segments),
        "mensual": monthly(windowed, segments),
        "bundles": bundles_by_month(windowed, segments, items, rules, top_bundles),
    }

