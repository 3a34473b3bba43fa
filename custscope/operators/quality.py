"""Quality and drift checks.

Each check is a one-row DataFrame with its figures, `ok` and `mensaje`; `enforce` runs it and
raises when it failed. The figures come from the tables, or from an `Observation` of the write that made the table: the
`observe_…` functions add it, and the checks take what it saw, so that a job reads nothing again for its checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from custscope.functions.labels import share
from custscope.functions.ordered import over_few_rows
from custscope.schema import FEATURES

MAX_DROP_PCT = 5.0
MAX_SHARE_PCT = 50.0
CROSS_CHECK_PCT = 2.0
MIN_DAILY_ORDERS = 100
MIN_DAILY_SEGMENTS = 3
MIN_AGREEMENT = 0.60
DRIFT_POINTS = 5.0


class QualityCheckFailed(Exception):
    """A check found data that must not be served."""


def _text(pattern: str, *args) -> Column:
    return F.format_string(pattern, *args)


def _verdict(figures: DataFrame, *failures: tuple[Column, Column]) -> DataFrame:
    """Adds ok and mensaje; the first failing condition names the problem."""
    message = F.lit(None).cast("string")
    for failed, text in reversed(failures):
        message = F.when(failed, text).otherwise(message)
    return figures.withColumn("mensaje", message).withColumn("ok", F.col("mensaje").isNull())


def enforce(check: DataFrame) -> dict:
    row = check.first().asDict()
    if not row["ok"]:
        raise QualityCheckFailed(row["mensaje"])
    return row


def check_ingest(before: DataFrame, after: DataFrame, max_drop_pct: float = MAX_DROP_PCT) -> DataFrame:
    """Orders must not shrink by more than the limit; an empty past is a first run."""
    past = before.agg(F.count(F.lit(1))).scalar()
    figures = after.agg(F.count(F.lit(1)).alias("n_despues")).select(past.alias("n_antes"), "n_despues")
    return _ingest_verdict(figures, max_drop_pct)


def check_ingest_counts(spark, n_after: int, n_before: int | None, max_drop_pct: float = MAX_DROP_PCT) -> DataFrame:
    """The same check from counts that are already known."""
    figures = spark.createDataFrame([(n_before, n_after)], "n_antes bigint, n_despues bigint")
    return _ingest_verdict(figures, max_drop_pct)


def _ingest_verdict(figures: DataFrame, max_drop_pct: float) -> DataFrame:
    with_drop = figures.withColumn(
        "caida_pct", share((F.col("n_antes") - F.col("n_despues")) * 100, F.col("n_antes"))
    )
    return _verdict(with_drop, (
        F.col("caida_pct") > max_drop_pct,
        _text(f"El ingest destruyó datos: %d → %d pedidos (%.1f%% > {max_drop_pct}%%)",
              F.col("n_antes"), F.col("n_despues"), F.col("caida_pct")),
    ))


def _segment_figures(features: list[str]) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_clientes"),
        F.count_if(F.col("segmento_cluster").isNull()).alias("n_sin_segmento"),
        *[F.count_if(F.col(f).isNull()).alias(f"{f}_nulos") for f in features],
        F.min("cluster_id").alias("cluster_min"),
        F.max("cluster_id").alias("cluster_max"),
    ]


def _segments_verdict(figures: DataFrame, features: list[str], max_cluster: int) -> DataFrame:
    n_null = sum(F.col(f"{f}_nulos") for f in features)
    return _verdict(
        figures,
        (F.col("n_clientes") == 0, F.lit("El resultado de la segmentación está vacío")),
        (F.col("n_sin_segmento") > 0, _text("%d clientes sin segmento", F.col("n_sin_segmento"))),
        (n_null > 0, _text("Hay %d nulos en features", n_null)),
        ((F.col("cluster_min") < 0) | (F.col("cluster_max") > max_cluster),
         _text(f"cluster_id fuera de rango [0, {max_cluster}]: %d a %d", F.col("cluster_min"), F.col("cluster_max"))),
    )


def check_segments(segments: DataFrame, features: list[str] = FEATURES, max_cluster: int = 4) -> DataFrame:
    return _segments_verdict(segments.agg(*_segment_figures(features)), features, max_cluster)


def _distribution_verdict(counts: DataFrame, max_share_pct: float) -> DataFrame:
    # Larger count first, then the name, so that a tie has one answer.
    figures = counts.agg(
        F.max_by("segmento_cluster", F.struct("n", "segmento_cluster")).alias("segmento_dominante"),
        share(F.max("n") * 100, F.sum("n")).alias("max_pct"),
    )
    return _verdict(figures, (
        F.col("max_pct") > max_share_pct,
        _text(f"El segmento %s absorbe %.1f%% de los clientes (máximo {max_share_pct}%%)",
              F.col("segmento_dominante"), F.col("max_pct")),
    ))


def check_distribution(segments: DataFrame, max_share_pct: float = MAX_SHARE_PCT) -> DataFrame:
    """No segment may hold more than the limit; guards against scoring in the wrong scale."""
    counts = segments.groupBy("segmento_cluster").agg(F.count(F.lit(1)).alias("n"))
    return _distribution_verdict(counts, max_share_pct)


def observe_segments(segments: DataFrame, names: list[str]) -> tuple[DataFrame, Observation]:
    """`names`: the segments that there can be. The write of the result tells all that the segment checks ask for."""
    seen = Observation()
    each = [F.count_if(F.col("segmento_cluster") == n).alias(f"n_{i}") for i, n in enumerate(names)]
    return segments.observe(
        seen, *_segment_figures(FEATURES), *each, F.coalesce(F.sum("frequency"), F.lit(0)).alias("pedidos_rfm")), seen


def check_observed_segments(
    spark: SparkSession, seen: dict, names: list[str], max_cluster: int = 4, max_share_pct: float = MAX_SHARE_PCT
) -> list[DataFrame]:
    """`check_segments` and `check_distribution` from what the write saw."""
    known = [k for k in seen if k.endswith("_nulos") or k in ("n_clientes", "n_sin_segmento", "cluster_min", "cluster_max")]
    kinds = ", ".join(f"{k} {'int' if k.startswith('cluster_') else 'bigint'}" for k in known)
    figures = spark.createDataFrame([tuple(seen[k] for k in known)], kinds)
    counts = [(n, seen[f"n_{i}"]) for i, n in enumerate(names) if seen[f"n_{i}"]]
    counts += [(None, seen["n_sin_segmento"])] * bool(seen["n_sin_segmento"])
    shares = spark.createDataFrame(counts, "segmento_cluster string, n bigint")
    return [_segments_verdict(figures, FEATURES, max_cluster), _distribution_verdict(shares, max_share_pct)]


def check_monthly(monthly: DataFrame, segments: DataFrame, tolerance_pct: float = CROSS_CHECK_PCT) -> DataFrame:
    """Orders of the monthly table against the summed order counts of the customers."""
    rfm = segments.agg(F.coalesce(F.sum("frequency"), F.lit(0))).scalar()
    figures = monthly.agg(F.count(F.lit(1)).alias("n_filas"), F.sum("pedidos").alias("pedidos_temporal")).select(
        "n_filas", "pedidos_temporal", rfm.alias("pedidos_rfm"))
    return _monthly_verdict(figures, tolerance_pct)


def _monthly_verdict(counts: DataFrame, tolerance_pct: float) -> DataFrame:
    figures = counts.withColumn(
        "diferencia_pct", share(F.abs(F.col("pedidos_temporal") - F.col("pedidos_rfm")) * 100, F.col("pedidos_rfm"))
    )
    some = F.col("n_filas") > 0
    return _verdict(
        figures,
        (some & (F.col("pedidos_rfm") == 0), F.lit("La suma de frequency es 0")),
        (some & (F.col("diferencia_pct") > tolerance_pct),
         _text(f"Inconsistencia entre temporalidad y RFM: %d contra %d (%.1f%% > {tolerance_pct}%%)",
               F.col("pedidos_temporal"), F.col("pedidos_rfm").cast("bigint"), F.col("diferencia_pct"))),
    )


def observe_orders(table: DataFrame, names: list[str], segment: str) -> tuple[DataFrame, Observation]:
    """Rows, orders and the orders of each segment of a month or day table, seen by its write."""
    seen = Observation()
    each = [F.count_if(F.col(segment) == n).alias(f"n_{i}") for i, n in enumerate(names)]
    return table.observe(
        seen, F.count(F.lit(1)).alias("n_filas"), F.coalesce(F.sum("pedidos"), F.lit(0)).alias("pedidos"), *each), seen


def check_observed_monthly(spark: SparkSession, seen: dict, segments_seen: dict, tolerance_pct: float = CROSS_CHECK_PCT) -> DataFrame:
    """`check_monthly` from what the writes of both tables saw."""
    row = (seen["n_filas"], seen["pedidos"] if seen["n_filas"] else None, segments_seen["pedidos_rfm"])
    return _monthly_verdict(spark.createDataFrame([row], "n_filas bigint, pedidos_temporal bigint, pedidos_rfm bigint"), tolerance_pct)


def check_daily(
    daily: DataFrame, min_orders: int = MIN_DAILY_ORDERS, min_segments: int = MIN_DAILY_SEGMENTS
) -> DataFrame:
    figures = daily.agg(
        F.count(F.lit(1)).alias("n_filas"),
        F.coalesce(F.sum("pedidos"), F.lit(0)).alias("pedidos"),
        F.count_distinct("segmento").alias("n_segmentos"),
    )
    return _daily_verdict(figures, min_orders, min_segments)


def check_observed_daily(
    spark: SparkSession, seen: dict, min_orders: int = MIN_DAILY_ORDERS, min_segments: int = MIN_DAILY_SEGMENTS
) -> DataFrame:
    """`check_daily` from what the write saw."""
    row = (seen["n_filas"], seen["pedidos"], sum(1 for k, n in seen.items() if k[2:].isdigit() and n))
    return _daily_verdict(spark.createDataFrame([row], "n_filas bigint, pedidos bigint, n_segmentos bigint"), min_orders, min_segments)


def _daily_verdict(figures: DataFrame, min_orders: int, min_segments: int) -> DataFrame:
    return _verdict(
        figures,
        (F.col("n_filas") == 0, F.lit("El agregado diario está vacío")),
        (F.col("pedidos") < min_orders, _text(f"Solo %d pedidos, se esperan {min_orders}", F.col("pedidos"))),
        (F.col("n_segmentos") < min_segments, _text(f"Solo %d segmentos, se esperan {min_segments}", F.col("n_segmentos"))),
    )


def drift_agreement(now: DataFrame, snapshot: DataFrame, minimum: float = MIN_AGREEMENT) -> DataFrame:
    """Share of common customers still in the segment of the frozen snapshot."""
    pairs = now.select("cliente_id", F.col("segmento_cluster").alias("a")).join(
        snapshot.select("cliente_id", F.col("segmento_cluster").alias("b")), "cliente_id"
    )
    same = F.avg((F.col("a") == F.col("b")).cast("double"))
    figures = pairs.agg(F.count(F.lit(1)).alias("n_comunes"), same.alias("coincidencia"))
    return figures.withColumn("alerta", F.coalesce(F.col("coincidencia") < minimum, F.lit(False)))


def drift_points(now: DataFrame, snapshot: DataFrame, limit: float = DRIFT_POINTS) -> DataFrame:
    """Change of each segment's share since the snapshot, in percentage points."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col("segmento_cluster").alias("segmento")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.select("segmento", (share(F.col("_n"), over_few_rows(F.sum("_n"))) * 100).alias(name))

    both = shares(now, "pct_actual").join(shares(snapshot, "pct_anterior"), "segmento", "full")
    zero = F.lit(0.0)
    points = F.coalesce("pct_actual", zero) - F.coalesce("pct_anterior", zero)
    return both.select(
        "segmento",
        F.coalesce("pct_actual", zero).alias("pct_actual"),
        F.coalesce("pct_anterior", zero).alias("pct_anterior"),
        points.alias("cambio_pp"),
        (F.abs(points) > limit).alias("alerta"),
    )


def revenue_reconciliation(items: DataFrame, segments: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Line totals per customer against the customer's money; both sides must exist."""
    lines = items.groupBy("cliente_id").agg(F.sum("subtotal_mxn").alias("revenue_items"))
    ratio = F.try_divide(F.abs(F.col("revenue_items") - F.col("monetary")), F.col("monetary"))
    return (
        lines.join(segments.select("cliente_id", "monetary"), "cliente_id")
        .select("cliente_id", "revenue_items", "monetary", ratio.alias("diferencia"))
        .withColumn("ok", F.coalesce(F.col("diferencia") <= tolerance, F.lit(False)))
    )
