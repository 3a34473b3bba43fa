"""Incremental ingest: high-water mark, one pass over the documents, flatten, enrich, keep-last upsert, one published version."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from custscope.operators.flatten import add_family, enrich_items, explode_items, flatten_orders
from custscope.plans.totals import add_changes
from custscope.schema import ITEM_KEYS, ORDER_KEYS
from custscope.sources import versions
from custscope.sources.documents import OTHER, OUTSIDE, PENDING, REJECTED, corrupt, document_class, document_id, document_time, reject_reason
from custscope.sources.staging import scratch, stage
from custscope.sources.tables import VIEWS, UpsertResult, stored_high_water_mark, upsert
from custscope.sources.versions import Version

log = logging.getLogger(__name__)
REJECTS = "rechazados"
LOADS = "cargas"
#: The number of the load, which both tables above are partitioned by.
LOAD_COLUMN = "carga"


@dataclass(frozen=True)
class Accounts:
    """Where the documents of a load went. `rejected` counts what it read; documents rejected by an earlier load are stored once."""

    read: int
    pending: int
    outside: int
    other: int
    rejected: int
    newly_rejected: int

    @property
    def complete(self) -> bool:
        return self.read == self.pending + self.outside + self.other + self.rejected


@dataclass(frozen=True)
class Load:
    """What a load did to each table, and the high-water marks before and after it."""

    orders: UpsertResult
    items: UpsertResult
    marks: tuple[datetime | None, datetime | None]
    accounts: Accounts | None = None

    @property
    def empty(self) -> bool:
        return self.marks[0] == self.marks[1] and not self.orders.n_new


def split_documents(docs: DataFrame, watermark: datetime | None = None, until: datetime | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(pending documents, rejected documents with their reason, documents per class).

    Without a mark that is one pass over the input: only pending and rejected documents are written, the others are counted
    by the same write. Behind a mark few documents are new, so classes are counted first, which does not read the lines
    of any document; documents are then written only if there are some.
    """
    classes = (PENDING, OUTSIDE, OTHER, REJECTED)
    figures = [F.count(F.lit(1)).alias("read"), *[F.count_if(F.col("_clase") == c).alias(c) for c in classes]]
    marked = docs.withColumns({"_clase": document_class(docs, watermark, until), "_motivo": reject_reason(docs), "_texto": corrupt(docs)})
    wanted = F.col("_clase").isin(PENDING, REJECTED)
    of = lambda kept, c: kept.where(F.col("_clase") == c).drop("_clase")
    if watermark is None:
        seen = Observation()
        kept = stage(marked.observe(seen, *figures).where(wanted), "documents", ["_clase"])
        counts = {"read": 0, **dict.fromkeys(classes, 0)} | {k: int(v) for k, v in seen.get.items()}
    else:
        counts = {k: int(v) for k, v in marked.agg(*figures).first().asDict().items()}
        some = counts[PENDING] or counts[REJECTED]
        kept = stage(marked.where(wanted), "documents", ["_clase"]) if some else marked.limit(0)
    return of(kept, PENDING).drop("_motivo", "_texto"), of(kept, REJECTED), counts


def store_rejects(version: Version, rejected: DataFrame) -> int:
    """Appends documents that no earlier load has rejected, with the reason and the number of the load; says how many.

    A batch source shows a bad document to every load; its text tells whether it is known.
    """
    body = [c for c in rejected.columns if not c.startswith("_") or c == "_id"]
    text = F.coalesce("_texto", F.to_json(F.struct(*body)))
    rows = rejected.select(F.col("_motivo").alias("motivo"), document_id().alias("order_id"), text.alias("documento")).withColumn(
        "huella", F.sha2(F.encode("documento", "UTF-8"), 256)).dropDuplicates(["huella"])
    known = version.old(REJECTS)
    if known is not None:
        rows = rows.join(known.select("huella"), "huella", "left_anti")
    fresh = stage(rows.select("motivo", "order_id", "documento", "huella", F.lit(str(version.number)).alias(LOAD_COLUMN)), "rejects")
    n = fresh.count()
    if n:
        version.replace(REJECTS, fresh, LOAD_COLUMN, [str(version.number)])
        log.error("%d documents cannot be loaded; load %d put them into %s", n, version.number, REJECTS)
    return n


def last_versions(docs: DataFrame) -> DataFrame:
    """Of documents that share an id, the last by time (then by content), so that lines of two versions of an order never mix.

    Ids are counted first; only documents of an id that comes again are compared.
    """
    stamp = F.struct(F.unix_micros(document_time()), F.xxhash64(F.to_json(F.struct(*docs.columns))))
    again = stage(docs.groupBy(document_id().alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "repeated-ids")
    if again.isEmpty():
        return docs
    repeated = stage(
        docs.join(again, document_id() == F.col("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max(stamp).alias("_stamp")),
        "repeated")
    return docs.join(repeated, document_id() == F.col("_key"), "left").where(
        F.col("_key").isNull() | (stamp == F.col("_stamp"))).drop("_key", "_n", "_stamp")


def store_documents(version: Version, docs: DataFrame) -> tuple[UpsertResult, UpsertResult]:
    """Flattens pending documents, merges them into the order and item history of the version and keeps its totals."""
    docs = last_versions(docs)
    orders = flatten_orders(docs).withColumn("posicion", F.coalesce(F.unix_micros("fecha"), F.lit(0)))
    items = add_family(enrich_items(explode_items(docs)))
    with scratch(version.spark):
        merged_items, _ = upsert(version, VIEWS["items"], items, ITEM_KEYS, "posicion")
    with scratch(version.spark):
        merged_orders, changes = upsert(version, VIEWS["orders"], orders, ORDER_KEYS, "posicion")
        add_changes(version, changes)
    return merged_orders, merged_items


def load_documents(spark: SparkSession, root: str, docs: DataFrame, until=None, incremental: bool = True, stream: tuple[str, int] | None = None) -> Load:
    """One load: all its tables are published together, or not at all.

    `incremental` takes only documents behind the high-water mark. `stream` is a stream's name and the number of its
    batch; a batch that was published before is not loaded again.
    """
    version = Version(spark, root)
    of = version.base
    mark = stored_high_water_mark(spark, root, of=of)
    rows = lambda view: of.tables[VIEWS[view]].rows if VIEWS[view] in of.tables else 0
    idle = [UpsertResult(0, rows(view), 0) for view in ("orders", "items")]
    streams = dict(of.notes.get("flujos", {}))
    if stream and streams.get(stream[0], -1) >= stream[1]:
        return Load(*idle, (mark, mark))
    with scratch(spark):
        pending, rejected, counts = split_documents(docs, mark if incremental else None, until)
        bad = store_rejects(version, rejected) if counts[REJECTED] else 0
        accounts = Accounts(counts["read"], counts[PENDING], counts[OUTSIDE], counts[OTHER], counts[REJECTED], bad)
        if not counts[PENDING] and not bad and not stream:
            return Load(*idle, (mark, mark), accounts)
        orders, items = store_documents(version, pending) if counts[PENDING] else idle
    one = [(stream[0] if stream else "lote", *(int(v) for v in vars(accounts).values()), str(version.number))]
    version.replace(LOADS, spark.createDataFrame(
        one, f"origen string, leidos bigint, cargados bigint, fuera bigint, otros bigint, rechazados bigint, rechazados_nuevos bigint, {LOAD_COLUMN} string",
    ), LOAD_COLUMN, [str(version.number)])
    if stream:
        streams[stream[0]] = stream[1]
    version.publish(flujos=streams)
    return Load(orders, items, (mark, stored_high_water_mark(spark, root)), accounts)


def run_ingest(spark: SparkSession, root: str, docs: DataFrame, until=None) -> Load:
    """Loads what is newer than the history; does nothing when there is nothing."""
    return load_documents(spark, root, docs, until)


def accounts_of_loads(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per published load: origen, leidos, cargados, fuera, otros, rechazados, rechazados_nuevos, carga."""
    return versions.read(spark, root, LOADS)


def as_row(spark: SparkSession, load: Load) -> DataFrame:
    return spark.createDataFrame(
        [(load.orders.n_new, load.items.n_new, load.orders.n_total, load.items.n_total, load.empty, *load.marks)],
        "n_orders_nuevos bigint, n_items_nuevos bigint, n_orders_total bigint, n_items_total bigint, "
        "skipped boolean, watermark_anterior timestamp, watermark_nuevo timestamp",
    )
