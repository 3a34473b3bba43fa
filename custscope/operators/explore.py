"""Exploratory tables: Pareto, concentration, SKU cardinality, ticket histogram, money index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custscope.functions.labels import share
from custscope.functions.ordered import exact_quantiles, over_few_rows, running_totals_desc


def pareto(segments: DataFrame) -> DataFrame:
    """Cumulative share of customers and money, best customers first; equal customers are peers."""
    totals = running_totals_desc(segments.select("monetary"), "monetary")
    return segments.select("cliente_id", "monetary").join(totals, "monetary").select(
        "cliente_id", "monetary",
        share(F.col("n_upto"), F.col("n_total")).alias("pct_clientes_acum"),
        share(F.col("sum_upto"), F.col("sum_total")).alias("pct_revenue_acum"),
    )


def top_share(segments: DataFrame, n: int = 10) -> DataFrame:
    """Share of all money that comes from the n best customers."""
    best = segments.orderBy(F.desc("monetary"), "cliente_id").limit(n).agg(F.sum("monetary")).scalar()
    return segments.agg(
        F.least(F.count(F.lit(1)), F.lit(n)).cast("bigint").alias("n_clientes"), F.sum("monetary").alias("_all")
    ).select("n_clientes", best.alias("revenue_top"), share(best, F.col("_all")).alias("pct_revenue"))


def sku_cardinality(items: DataFrame) -> DataFrame:
    """Distinct SKUs and lines per family."""
    return items.where(F.col("familia").isNotNull()).groupBy("familia").agg(
        F.count_distinct("clave").alias("n_claves"), F.count(F.lit(1)).alias("n_lineas")
    )


def ticket_histogram(orders: DataFrame, low: float = 0.0, high: float = 7.0, bins: int = 28) -> DataFrame:
    """Orders per bin of log10 of the ticket; bins 0 and bins+1 catch what lies outside."""
    size = (high - low) / bins
    bucket = F.width_bucket(F.log10("pago_total"), F.lit(low), F.lit(high), F.lit(bins))
    return (
        orders.where(F.col("pago_total") > 0).groupBy(bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_pedidos"), F.sum("pago_total").alias("revenue"))
        .withColumn("desde_log10", F.lit(low) + (F.col("bin") - 1) * F.lit(size))
    )


def monetary_index(segments: DataFrame, base: str = "MVPs") -> DataFrame:
    """Median money per segment with the base segment's median as 100."""
    medians = exact_quantiles(
        segments.select(F.col("segmento_cluster").alias("segmento"), "monetary"),
        ["segmento"], "monetary", {"monetary_med": 0.5},
    )
    reference = over_few_rows(F.max(F.when(F.col("segmento") == base, F.col("monetary_med"))))
    return medians.withColumn("indice", share(F.col("monetary_med") * 100, reference))
