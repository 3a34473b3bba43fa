"""Questions about segments: headline figures, summaries, alerts and the comparison radar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custscope.functions.labels import segment_rank, share, urgency_band, urgency_ratio
from custscope.functions.ordered import exact_quantiles, over_few_rows

URGENT_SEGMENTS = ["MVPs", "Alto Valor"]
REACTIVATION_SEGMENT = "En Riesgo"
URGENCY_FACTOR = 1.5


def _with_total(per_segment: DataFrame, count: str, name: str) -> DataFrame:
    """Adds the share of the grand total; the input has one row per segment."""
    return per_segment.withColumn(name, share(F.col(count), over_few_rows(F.sum(count))))


def _segment_name() -> Column:
    return F.col("segmento_cluster").alias("segmento")


def global_kpis(segments: DataFrame) -> DataFrame:
    return segments.agg(
        F.count(F.lit(1)).alias("n_clientes"),
        F.sum("monetary").alias("revenue_total"),
        share(F.sum("monetary"), F.sum("frequency")).alias("ticket_promedio"),
        F.avg(F.col("es_single_buyer").cast("double")).alias("pct_single_buyers"),
    )


def customers_per_segment(segments: DataFrame) -> DataFrame:
    counts = segments.groupBy(_segment_name()).agg(F.count(F.lit(1)).alias("n_clientes"))
    return _with_total(counts, "n_clientes", "pct").orderBy(F.desc("n_clientes"), "segmento")


def revenue_per_segment(segments: DataFrame) -> DataFrame:
    return (
        segments.groupBy(_segment_name()).agg(F.sum("monetary").alias("revenue"))
        .orderBy(F.desc("revenue"), "segmento")
    )


def in_segment_order(rows: DataFrame, column: str = "segmento") -> DataFrame:
    """Best to worst segment; the rank is kept so that callers can sort again."""
    return rows.withColumn("orden", segment_rank(F.col(column)).cast("int")).orderBy("orden")


def _segment_figures(segments: DataFrame) -> DataFrame:
    """Counts, exact medians, means and totals per segment.

    Days and order counts repeat, so their medians hold few distinct values and are aggregated in
    place; money does not repeat and takes the distributed quantile.
    """
    whole = segments.groupBy(_segment_name()).agg(
        F.count(F.lit(1)).alias("n_clientes"),
        F.median("recency").alias("recency_med"),
        F.avg("recency").alias("recency_avg"),
        F.median("frequency").alias("frequency_med"),
        F.avg("frequency").alias("frequency_avg"),
        F.avg("monetary").alias("monetary_avg"),
        F.sum("monetary").alias("monetary_total"),
        F.median("dias_entre_compras").alias("cadencia_med"),
        F.avg(F.col("es_single_buyer").cast("double")).alias("pct_single_buyers"),
    )
    money = exact_quantiles(
        segments.select(_segment_name(), "monetary"), ["segmento"], "monetary", {"monetary_med": 0.5}
    )
    return whole.join(money, "segmento", "left")


def segment_summary(segments: DataFrame) -> DataFrame:
    return _with_total(_segment_figures(segments), "n_clientes", "pct").select(
        "segmento", "n_clientes", "pct", "recency_med", "frequency_med", "monetary_med", "cadencia_med"
    ).orderBy(F.desc("monetary_med"), "segmento")


def segment_metrics(segments: DataFrame, segment: str | None = None) -> DataFrame:
    """One row per segment; an unknown name gives no row."""
    figures = _with_total(_segment_figures(segments), "n_clientes", "pct_total").select(
        "segmento", "n_clientes", "pct_total", "recency_med", "recency_avg", "frequency_med",
        "frequency_avg", "monetary_med", "monetary_avg", "monetary_total", "cadencia_med",
        "pct_single_buyers",
    )
    return figures if segment is None else figures.where(F.col("segmento") == segment)


# --- alerts -----------------------------------------------------------------------------------


def _regular() -> Column:
    """Customers whose cadence means something: several orders, at least a day apart."""
    return (F.col("es_single_buyer") == 0) & (F.col("dias_entre_compras") >= 1)


def _urgent(segments: DataFrame) -> DataFrame:
    return segments.where(
        F.col("segmento_cluster").isin(URGENT_SEGMENTS)
        & _regular()
        & (F.col("recency") > URGENCY_FACTOR * F.col("dias_entre_compras"))
    )


def _to_reactivate(segments: DataFrame) -> DataFrame:
    return segments.where((F.col("segmento_cluster") == REACTIVATION_SEGMENT) & _regular())


def _alert_rows(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        "cliente_id", _segment_name(), "recency", F.col("dias_entre_compras").alias("cadencia"),
        urgency_ratio(F.col("recency"), F.col("dias_entre_compras")).alias("ratio"),
        "monetary", "frequency",
    ).orderBy(F.desc("monetary"), "cliente_id")


def urgent_customers(segments: DataFrame) -> DataFrame:
    """Valuable customers overdue by more than 1.5 times their own cadence."""
    return _alert_rows(_urgent(segments))


def urgent_kpis(segments: DataFrame) -> DataFrame:
    name = F.col("segmento_cluster")
    return _urgent(segments).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(name == "MVPs").alias("n_mvps"),
        F.count_if(name == "Alto Valor").alias("n_alto"),
        F.sum("monetary").alias("revenue_en_riesgo"),
    )


def reactivation_customers(segments: DataFrame) -> DataFrame:
    return _alert_rows(_to_reactivate(segments))


def reactivation_kpis(segments: DataFrame) -> DataFrame:
    return _to_reactivate(segments).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum("monetary").alias("revenue_potencial"),
        F.median("recency").alias("recency_mediana"),
        F.median("dias_entre_compras").alias("cadencia_mediana"),
    )


def urgency_bands(segments: DataFrame) -> DataFrame:
    """Customers of the urgent segments per urgency band."""
    ratio = urgency_ratio(F.col("recency"), F.col("dias_entre_compras"))
    return (
        segments.where(F.col("segmento_cluster").isin(URGENT_SEGMENTS) & _regular())
        .groupBy(_segment_name(), urgency_band(ratio).alias("banda"))
        .agg(F.count(F.lit(1)).alias("n_clientes"), F.sum("monetary").alias("revenue"))
    )


# --- comparison -------------------------------------------------------------------------------

BOX = {"minimo": 0.0, "q1": 0.25, "mediana": 0.5, "q3": 0.75, "maximo": 1.0}


def monetary_values(segments: DataFrame, segment: str) -> DataFrame:
    return segments.where(F.col("segmento_cluster") == segment).select("monetary")


def monetary_box(segments: DataFrame) -> DataFrame:
    """Five-number summary of the money per segment."""
    return exact_quantiles(segments.select(_segment_name(), "monetary"), ["segmento"], "monetary", BOX)


_RANGED = {"recency": "recency", "frequency": "frequency", "monetary": "monetary", "cadencia": "dias_entre_compras"}


def global_ranges(segments: DataFrame) -> DataFrame:
    return segments.agg(*[
        f(F.col(c)).alias(f"{name}_{end}")
        for name, c in _RANGED.items() for end, f in (("min", F.min), ("max", F.max))
    ])


def median_ranges(segments: DataFrame) -> DataFrame:
    """Smallest and largest segment median of each feature."""
    figures = _segment_figures(segments)
    return figures.agg(*[
        f(F.col(f"{name}_med").cast("double")).alias(f"{name}_{end}")
        for name in _RANGED for end, f in (("min", F.min), ("max", F.max))
    ])


def radar(segments: DataFrame) -> DataFrame:
    """Segment medians scaled to [0,1] over all segments; fewer days is better, so days invert."""
    figures = _segment_figures(segments)

    def scaled(name: str) -> Column:
        median = F.col(f"{name}_med").cast("double")
        low, high = over_few_rows(F.min(median)), over_few_rows(F.max(median))
        return F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(median - low, high - low))

    return figures.select(
        "segmento",
        (1 - scaled("recency")).alias("recency"),
        scaled("frequency").alias("frequency"),
        scaled("monetary").alias("monetary"),
        (1 - scaled("cadencia")).alias("cadencia"),
    )
