"""Approximate quantiles from mergeable sketches.

Exact quantiles need all values at once. A KLL sketch of fixed size answers any quantile with a bounded error of rank, and
sketches of parts merge into the sketch of the whole. So one small row per segment and day is stored while loading, and a
question over any span of days merges rows instead of reading orders. Sketches build and merge map-side, so a segment with
a third of all orders is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custscope.functions.guards import bounded_int, require_columns
from custscope.functions.timeparts import local_time, month_key
from custscope.schema import LOCAL_TIMEZONE

#: Size of a sketch: about 0.3 % error of rank, at most some 20 kB a sketch.
SIZE = 1000


def value_sketches(df: DataFrame, keys: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """(keys, n, sketch): one sketch of the values of each group; NULL values are left out."""
    bounded_int("size", size, 8, 65_535)
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def ticket_sketches(orders: DataFrame, segments: DataFrame, tz: str = LOCAL_TIMEZONE, size: int = SIZE) -> DataFrame:
    """(segmento, fecha_dia, n, sketch, mes): order amounts per segment and local day, to be stored by month."""
    require_columns(orders, ["cliente_id", "fecha", "pago_total"], "orders")
    named = orders.join(segments.select("cliente_id", F.col("segmento_cluster").alias("segmento")), "cliente_id").withColumn(
        "fecha_dia", F.to_date(local_time(F.col("fecha"), tz)))
    return value_sketches(named, ["segmento", "fecha_dia"], "pago_total", size).withColumn("mes", month_key(F.col("fecha_dia")))


def merged_quantiles(sketches: DataFrame, groups: Sequence[str], ranks: dict[str, float], size: int = SIZE) -> DataFrame:
    """(groups, n, one column per named rank) of all sketches of a group together."""
    merged = sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("_all"))
    return merged.select(
        *groups, "n", *[F.kll_sketch_get_quantile_double("_all", F.lit(float(r))).alias(name) for name, r in ranks.items()])


def ticket_quantiles(
    sketches: DataFrame, ranks: dict[str, float], first: date | str | None = None, last: date | str | None = None, size: int = SIZE
) -> DataFrame:
    """Quantiles of order amounts per segment from the stored days `first` to `last`; months outside are not read."""
    days = sketches
    for bound, compare in ((first, "__ge__"), (last, "__le__")):
        if bound is not None:
            days = days.where(getattr(F.col("fecha_dia"), compare)(F.lit(str(bound)).cast("date"))
                              & getattr(F.col("mes"), compare)(F.lit(str(bound)[:7])))
    return merged_quantiles(days, ["segmento"], ranks, size)


def rank_errors(df: DataFrame, groups: Sequence[str], value: str, quantiles: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """(groups, one column per rank): how far the asked rank lies outside the ranks that the given value really has."""
    here = df.where(F.col(value).isNotNull()).join(quantiles.select(*groups, *ranks), list(groups))
    below = lambda name: F.avg((F.col(value) < F.col(name)).cast("double"))
    upto = lambda name: F.avg((F.col(value) <= F.col(name)).cast("double"))
    return here.groupBy(*groups).agg(*[
        F.greatest(below(name) - r, r - upto(name), F.lit(0.0)).alias(name) for name, r in ranks.items()])
