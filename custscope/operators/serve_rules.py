"""Questions about rules and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custscope.functions.guards import bounded_int, one_of, single_segment
from custscope.functions.labels import share

MODES = ("accionables", "completa")
_VALUE = ["n_pedidos", "ticket_medio", "ticket_mediano", "revenue_total"]
_RULE = ["antecedents", "consequents", "confidence", "lift", "support_count"]


def _bundle_rows(actionable: DataFrame, all_rules: DataFrame, segment: str | None, mode: str) -> DataFrame:
    """The two rule tables under one schema; the complete one has no money columns."""
    if one_of("mode", mode, MODES) == "accionables":
        rows = actionable.select(*_RULE, F.col("n_pedidos").cast("double").alias("n_pedidos"), *_VALUE[1:], "segmento")
    else:
        rows = all_rules.select(*_RULE, *[F.lit(None).cast("double").alias(c) for c in _VALUE], "segmento")
    chosen = single_segment(segment)
    return rows if chosen is None else rows.where(F.col("segmento") == chosen)


def bundles_top(
    actionable: DataFrame, all_rules: DataFrame, segment: str | None = None, mode: str = "accionables"
) -> DataFrame:
    first = "revenue_total" if mode == "accionables" else "support_count"
    return _bundle_rows(actionable, all_rules, segment, mode).orderBy(
        F.desc(first), "segmento", "antecedents", "consequents"
    )


def bundles_scatter(
    actionable: DataFrame,
    all_rules: DataFrame,
    segment: str | None = None,
    mode: str = "accionables",
    min_confidence: float = 0.30,
    min_lift: float = 1.5,
) -> DataFrame:
    """All rules strictly above both thresholds."""
    return (
        _bundle_rows(actionable, all_rules, segment, mode)
        .where((F.col("confidence") > min_confidence) & (F.col("lift") > min_lift))
        .orderBy(F.desc("lift"), F.desc("confidence"), "segmento", "antecedents", "consequents")
    )


def top_bundles(actionable: DataFrame, segment: str | None = None, limit: int | None = 3) -> DataFrame:
    """The first rules of each segment by money; `limit=None` keeps them all."""
    rows = _bundle_rows(actionable, actionable, segment, "accionables")
    if limit is None:
        return rows
    order = Window.partitionBy("segmento").orderBy(F.desc("revenue_total"), "antecedents", "consequents")
    return rows.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= limit)


def _ranked_bundles(monthly: DataFrame) -> DataFrame:
    order = Window.partitionBy("segmento_regla").orderBy(F.desc("_money"), "regla")
    return (
        monthly.groupBy("segmento_regla", "regla").agg(F.sum("revenue").alias("_money"))
        .withColumn("puesto", F.row_number().over(order))
    )


def bundles_over_time(monthly: DataFrame, segment: str | None = None, top_n: int = 10) -> DataFrame:
    """Monthly series of the rules of a segment with the most money."""
    bounded_int("top_n", top_n, 1, 30)
    rows = monthly if segment is None else monthly.where(F.col("segmento_regla") == segment)
    top = _ranked_bundles(rows).where(F.col("puesto") <= top_n)
    return (
        rows.join(top, ["segmento_regla", "regla"], "left_semi")
        .select("segmento_regla", "regla", F.col("año_mes").alias("ano_mes"), "pedidos", "revenue")
        .orderBy("segmento_regla", "regla", "ano_mes")
    )


def peak_month(monthly: DataFrame, segment: str | None = None) -> DataFrame:
    """The month with most orders of each rule and its share of the rule's orders."""
    rows = monthly if segment is None else monthly.where(F.col("segmento_regla") == segment)
    # A rule has one row per month, so its window holds a few dozen rows.
    rule = Window.partitionBy("segmento_regla", "regla")
    return (
        rows.withColumn("_rank", F.row_number().over(rule.orderBy(F.desc("pedidos"), "año_mes")))
        .withColumn("_total", F.sum("pedidos").over(rule))
        .where(F.col("_rank") == 1)
        .select(
            "segmento_regla", "regla", F.col("año_mes").alias("mes_pico"), "pedidos",
            share(F.col("pedidos"), F.col("_total")).alias("pct_concentracion"),
        )
        .orderBy(F.desc("pedidos"), "segmento_regla", "regla")
    )


def active_bundles(monthly: DataFrame, segment: str | None = None, n: int = 5, top_n: int = 10) -> DataFrame:
    """The bundles shown first on the month heat map: the top `n` by money."""
    bounded_int("top_n", top_n, 1, 30)
    rows = monthly if segment is None else monthly.where(F.col("segmento_regla") == segment)
    return (
        _ranked_bundles(rows).where(F.col("puesto") <= min(n, top_n))
        .select("segmento_regla", "regla", F.col("_money").alias("revenue"), "puesto")
    )
