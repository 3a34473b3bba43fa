"""Customers between segments and customers that changed segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custscope.functions.labels import moved_up
from custscope.sources.tables import read_snapshot

FRONTIER_RATIO = 0.7


def frontier_customers(segments: DataFrame, threshold: float = FRONTIER_RATIO) -> DataFrame:
    """Nearly as close to a second segment as to their own."""
    return (
        segments.where((F.col("razon_distancias") >= threshold) & (F.col("es_single_buyer") == 0))
        .select(
            "cliente_id", F.col("segmento_cluster").alias("segmento_actual"), "segmento_secundario",
            "razon_distancias", "recency", "frequency", "monetary",
            F.col("dias_entre_compras").alias("cadencia"), "es_single_buyer",
        )
        .orderBy(F.desc("monetary"), "cliente_id")
    )


def changed_segment(segments: DataFrame, before: DataFrame) -> DataFrame:
    """Customers whose segment differs from an earlier snapshot, with the direction."""
    then = before.select("cliente_id", F.col("segmento_cluster").alias("segmento_anterior"))
    return (
        segments.where(F.col("es_single_buyer") == 0).join(then, "cliente_id")
        .where(F.col("segmento_cluster") != F.col("segmento_anterior"))
        .select(
            "cliente_id", "segmento_anterior", F.col("segmento_cluster").alias("segmento_actual"),
            "recency", "frequency", "monetary", F.col("dias_entre_compras").alias("cadencia"),
            moved_up(F.col("segmento_anterior"), F.col("segmento_cluster")).alias("direccion"),
        )
        .orderBy(F.desc("monetary"), "cliente_id")
    )


def changed_since(segments: DataFrame, snapshots: DataFrame, as_of=None, months: int = 1) -> DataFrame:
    """Changes against the snapshot taken `months` calendar months ago; empty without one."""
    return changed_segment(segments, read_snapshot(snapshots, as_of, months))


def movement_kpis(frontier: DataFrame, changes: DataFrame) -> DataFrame:
    """Each list is counted to one row and the two rows are added up, so no list is planned inside another."""
    near = frontier.agg(F.count(F.lit(1)).alias("n_en_frontera"))
    moved = changes.agg(
        F.count_if(F.col("direccion") == "subida").alias("n_subidas_mes"),
        F.count_if(F.col("direccion") == "bajada").alias("n_bajadas_mes"),
        F.count(F.lit(1)).alias("n_total_cambios"),
    )
    both = near.unionByName(moved, allowMissingColumns=True)
    return both.agg(*[F.sum(name).alias(name) for name in both.columns])
