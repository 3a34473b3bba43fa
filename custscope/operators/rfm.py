"""Recency, frequency, monetary value and purchase cadence per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custscope.functions.guards import require_columns
from custscope.functions.timeparts import elapsed_days, instant, utc_day, window_start

DEFAULT_MONTHS = 30
FALLBACK_CADENCE_DAYS = 365.0


def in_window(orders: DataFrame, as_of=None, months: int = DEFAULT_MONTHS, cap_at_ref: bool = False) -> DataFrame:
    """Orders of the trailing window. Without the cap, orders after `as_of` count too."""
    require_columns(orders, ["cliente_id", "fecha", "pago_total"], "orders")
    out = orders.where(F.col("cliente_id").isNotNull() & (F.col("fecha") >= window_start(as_of, months)))
    return out.where(F.col("fecha") <= instant(as_of)) if cap_at_ref else out


def _customer_days(orders: DataFrame) -> DataFrame:
    """One row per customer and UTC day.

    Two orders of the same day are less than 24 hours apart, so their gap is always 0 days, and
    the gap to the next active day only needs the last order of one day and the first of the
    other. That makes this collapse exact, and a customer with a third of all orders is left
    with at most one row per day of the window before anything is keyed by customer.
    """
    return orders.groupBy("cliente_id", utc_day(F.col("fecha")).alias("dia")).agg(
        F.min("fecha").alias("primera"),
        F.max("fecha").alias("ultima"),
        F.count("fecha").alias("n"),
        F.sum("pago_total").alias("monto"),
    )


def customer_features(orders: DataFrame, as_of=None, months: int = DEFAULT_MONTHS, cap_at_ref: bool = False) -> DataFrame:
    """recency, frequency, monetary and the cadence (NULL for a single order)."""
    by_day = Window.partitionBy("cliente_id").orderBy("dia")
    days = _customer_days(in_window(orders, as_of, months, cap_at_ref)).withColumn(
        "previa", F.lag("ultima").over(by_day)
    )

    def gap(days_between, times, n, amount):
        return F.struct(
            days_between.cast("bigint").alias("salto"), times.cast("bigint").alias("veces"),
            n.cast("bigint").alias("n"), amount.alias("monto"), F.col("ultima").alias("ultima"),
        )

    # Two rows per day: the day itself with its n-1 gaps of zero days, and the gap to the
    # previous active day (none for the first).
    rows = days.select("cliente_id", F.inline(F.array(
        gap(F.lit(0), F.col("n") - 1, F.col("n"), F.col("monto")),
        gap(
            elapsed_days(F.col("previa"), F.col("primera")), F.col("previa").isNotNull().cast("int"),
            F.lit(0), F.lit(0.0),
        ),
    )))
    # Weighted median by running counts. Everything from here on is keyed by customer, so it runs
    # in place after the one shuffle, on at most two rows per day of the window.
    customer = Window.partitionBy("cliente_id")
    by_gap = customer.orderBy("salto").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("hasta", F.sum("veces").over(by_gap)).withColumn("total", F.sum("veces").over(customer))

    def gap_at(rank):
        here = (rank >= F.col("hasta") - F.col("veces")) & (rank < F.col("hasta"))
        return F.max(F.when(here, F.col("salto")))

    middle = (F.col("total") - 1) / 2
    recency = F.greatest(elapsed_days(F.max("ultima"), instant(as_of)), F.lit(0).cast("bigint"))
    return ranked.groupBy("cliente_id").agg(
        recency.alias("recency"),
        F.sum("n").alias("frequency"),
        F.coalesce(F.sum("monto"), F.lit(0.0)).alias("monetary"),
        ((gap_at(F.floor(middle)) + gap_at(F.ceil(middle))) / 2).alias("dias_entre_compras"),
    )


def rfm_features(orders: DataFrame, as_of=None, months: int = DEFAULT_MONTHS, cap_at_ref: bool = False) -> DataFrame:
    return customer_features(orders, as_of, months, cap_at_ref).drop("dias_entre_compras")


def purchase_cadence(orders: DataFrame, as_of=None, months: int = DEFAULT_MONTHS, cap_at_ref: bool = False) -> DataFrame:
    return customer_features(orders, as_of, months, cap_at_ref).select("cliente_id", "dias_entre_compras")


def impute_single_buyers(features: DataFrame) -> DataFrame:
    """Flags customers without a cadence and gives them the 95th percentile of the others.

    The percentile is one row that is joined to all. As a scalar subquery it would be planned again, with all
    that lies below it, for every filter on a column made from it. Cadences are multiples of half a day,
    so its aggregation state is bounded by the window, not by the number of customers.
    """
    check = features.agg(
        F.percentile("dias_entre_compras", 0.95).alias("_p95"),
        F.count_if(F.col("recency").isNull() | F.isnan("monetary")).alias("_malos"),
    )
    filled = F.coalesce(F.col("dias_entre_compras"), F.col("_p95"), F.lit(FALLBACK_CADENCE_DAYS))
    # A global aggregate: exactly one row, whatever the size of the data.
    return features.crossJoin(F.broadcast(check)).select(
        "cliente_id", "recency", "frequency", "monetary",
        F.when(
            F.col("_malos") > 0,
            F.raise_error(F.lit("null feature values remain after imputation")).cast("double"),
        ).otherwise(filled).alias("dias_entre_compras"),
        F.col("dias_entre_compras").isNull().cast("int").alias("es_single_buyer"),
    )


def rfm_complete(orders: DataFrame, as_of=None, months: int = DEFAULT_MONTHS, cap_at_ref: bool = False) -> DataFrame:
    """All features, no NULLs: one row per customer with an order in the window."""
    return impute_single_buyers(customer_features(orders, as_of, months, cap_at_ref))
