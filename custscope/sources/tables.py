"""Stored tables: reads, overwrites, views, high-water mark, keep-last upsert into versions, and snapshots."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custscope.functions.guards import require_columns
from custscope.functions.timeparts import as_utc, month_key
from custscope.schema import SNAPSHOT_COLUMNS
from custscope.sources import versions
from custscope.sources.files import exists
from custscope.sources.staging import stage
from custscope.sources.versions import Manifest, Version

log = logging.getLogger(__name__)

# View name to stored table.
VIEWS = {
    "segmentos": "clientes_segmentados",
    "orders": "orders_historicos",
    "items": "items_historicos",
    "mba_accionables": "mba_accionables",
    "mba_por_segmento": "mba_por_segmento",
    "mba_exclusivas": "mba_exclusivas",
    "temp_hora_dia": "temp_hora_dia",
    "temp_mes": "temp_mensual",
    "temp_bundles": "temp_bundles",
    "temp_diario": "temp_diario",
}

BATCH_COLUMN = "lote"
MONTH_COLUMN = "mes"
CUSTOMER_COLUMN = "cliente_id"
UNDATED = "sin-fecha"
#: So many hashes of eight bytes are sent to every task.
FEW_KEYS = 1_000_000


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    return name in versions.manifest(spark, root).tables or exists(spark, table_path(root, name))


def load_table(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """The newest published version of a table, or a table saved as a whole."""
    found = versions.read(spark, root, name)
    if found is not None:
        return found
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(root, name))


def save_table(df: DataFrame, root: str, name: str) -> str:
    path = table_path(root, name)
    df.write.mode("overwrite").parquet(path)
    return path


def register_views(spark: SparkSession, root: str) -> list[str]:
    """A temporary view per stored table; tables not written yet are left out."""
    made = []
    for view, name in VIEWS.items():
        if has_table(spark, root, name):
            load_table(spark, root, name).createOrReplaceTempView(view)
            made.append(view)
    return made


def high_water_mark(orders: DataFrame) -> DataFrame:
    """The newest order time; reads one column."""
    return orders.agg(F.max("fecha").alias("watermark"))


def stored_high_water_mark(spark: SparkSession, root: str, name: str = VIEWS["orders"], of: Manifest | None = None) -> datetime | None:
    """None where the history is missing or empty; reads one column of the newest month."""
    of = of or versions.manifest(spark, root)
    months = [m for m in of.tables[name].parts if m != UNDATED] if name in of.tables else []
    if not months:
        return None
    newest = versions.read(spark, root, name, of, [max(months)])
    # Taken as micros so that the zone of the Python process plays no part.
    micros = high_water_mark(newest).select(F.unix_micros("watermark")).first()[0]
    return None if micros is None else datetime.fromtimestamp(micros / 1_000_000, tz=timezone.utc)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table; a zero-column scan, so the counts come from file footers."""
    rows = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def stored_row_count(spark: SparkSession, root: str, name: str) -> int | None:
    """From the manifest, or from file footers; None for a table that is not there."""
    of = versions.manifest(spark, root)
    if name in of.tables:
        return of.tables[name].rows
    path = table_path(root, name)
    return spark.read.parquet(path).count() if exists(spark, path) else None


def keep_last(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest sequence; equal sequences are told apart by the rest of the row.

    An aggregate rather than a row_number window: it combines map-side, so a key with very many
    copies never gathers in one task. NULL keys are equal to each other.
    """
    require_columns(df, [*keys, *sequence])
    keys = list(keys)
    # The keys are the group's; every other value moves once, in the order in which rows are compared.
    rest = [*sequence, *(c for c in df.columns if c not in (*keys, *sequence))]
    return (
        df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("_last"))
        .select(*[F.col(f"_k{keys.index(c)}").alias(c) if c in keys else F.col(f"_last.{c}") for c in df.columns])
    )


def keep_last_of_few(stored: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """`keep_last` of rows that are cheap to read again, most of which stand alone under their key.

    Keys are counted first, as hashes; only rows under a hash that comes again are moved and compared.
    """
    require_columns(stored, [*keys, *sequence])
    key = F.xxhash64(*keys)
    again = stage(stored.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "repeated-keys")
    n = again.count()
    if not n:
        return stored
    again = F.broadcast(again) if n <= FEW_KEYS else again
    alone = stored.join(again, key == F.col("_key"), "left_anti")
    return alone.unionByName(keep_last(stored.join(again, key == F.col("_key"), "left_semi"), keys, sequence))


def merge_keep_last(
    old: DataFrame | None, new: DataFrame, keys: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """Old and new rows together, one per key, the latest winning."""
    return keep_last(new if old is None else old.unionByName(new), keys, sequence)


@dataclass
class UpsertResult:
    n_new: int
    n_total: int
    n_duplicates: int


def upsert(
    version: Version,
    name: str,
    new: DataFrame,
    keys: Sequence[str],
    position: str,
    time_column: str = "fecha",
) -> tuple[UpsertResult, DataFrame]:
    """Merges `new` into a month-partitioned table of the version, keeping the last row per key.

    Only months that receive rows, or already hold one of the incoming keys, are written again, each in the order of its
    customers where the rows name one, so that one customer's rows lie in few row groups. Rows carry the number of
    their version and their position, so "last" does not depend on task order; merging the same rows
    again gives the same table but for that number.

    Also returns what changed, as signed rows: each touched row as it was (`signo` -1) and as it is now (1).
    """
    require_columns(new, [*keys, time_column, position], name)
    spark = version.spark
    fresh = new.withColumns({
        BATCH_COLUMN: F.lit(version.number).cast("bigint"),
        "posicion": F.col(position).cast("bigint"),
        MONTH_COLUMN: F.coalesce(month_key(F.col(time_column)), F.lit(UNDATED)),
    })
    fresh = fresh if position == "posicion" else fresh.drop(position)
    sequence = [BATCH_COLUMN, "posicion"]
    incoming = stage(fresh, "upsert-new")
    n_new = incoming.count()
    months = {r[0] for r in incoming.select(MONTH_COLUMN).distinct().collect()}  # a few hundred values
    old = version.old(name)
    n_old, before = 0, None
    merged = incoming
    if old is not None:
        n_old = version.base.tables[name].rows
        match = None
        for k in keys:
            same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
            match = same if match is None else match & same
        arriving = incoming.select(*keys).distinct().alias("n")
        held = old.select(*keys, MONTH_COLUMN).alias("o").join(arriving, match, "left_semi")
        months |= {r[0] for r in held.select(MONTH_COLUMN).distinct().collect()}
        touched = version.old(name, months).select(*incoming.columns)
        before = touched.alias("o").join(arriving, match, "left_semi").select(*[F.col(f"o.{c}") for c in incoming.columns])
        merged = touched.unionByName(incoming)
    clustered = [CUSTOMER_COLUMN, *keys] if CUSTOMER_COLUMN in incoming.columns else ()
    stored = version.replace(name, keep_last_of_few(merged, keys, sequence), MONTH_COLUMN, months, clustered)
    duplicates = n_old + n_new - stored.rows
    _report(name, n_old + n_new, duplicates, keys)
    # Incoming rows always win, so the rows of this version's number are the touched ones.
    changes = version.new(name, months).where(F.col(BATCH_COLUMN) == version.number).withColumn("signo", F.lit(1))
    if before is not None:
        changes = changes.unionByName(before.withColumn("signo", F.lit(-1)))
    return UpsertResult(n_new, stored.rows, duplicates), changes


def _report(path: str, before: int, duplicates: int, keys: Sequence[str]) -> None:
    if duplicates <= 0:
        return
    percent = 100.0 * duplicates / before
    say = log.error if percent > 20 else log.warning
    say("dropped %d duplicates (%.1f%%) from %s by %s", duplicates, percent, path, list(keys))


def snapshot_rows(segments: DataFrame, as_of) -> DataFrame:
    return segments.select(
        *SNAPSHOT_COLUMNS, F.lit(as_utc(as_of).strftime("%Y-%m")).alias("snapshot_month")
    )


def write_snapshot(segments: DataFrame, path: str, as_of) -> None:
    """Replaces the snapshot of this calendar month and leaves the others alone."""
    (
        snapshot_rows(segments, as_of).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_month").parquet(path)
    )


def months_back(as_of, months: int) -> str:
    moment = as_utc(as_of)
    index = moment.year * 12 + moment.month - 1 - months
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def read_snapshot(snapshots: DataFrame, as_of, months: int = 1) -> DataFrame:
    """The snapshot of the calendar month `months` before; no rows where there is none."""
    return snapshots.where(F.col("snapshot_month") == months_back(as_of, months)).drop("snapshot_month")
