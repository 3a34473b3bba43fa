"""Published versions of several tables at once.

A load writes its rows to folders of its own and changes nothing that is there. What a table consists of is said by a
manifest: for each of its partitions, the folder of the load that last wrote it, and the rows in it. Publishing is
one rename of one small file, for all tables of the load together. A reader takes the newest manifest once and then reads files
that no later load touches, so it sees a load whole or not at all; a load that stops anywhere leaves folders that no
manifest names, which `vacuum` removes.

    root/<table>/version=<load>/<partition>=<value>/part-*.parquet
    root/_versiones/0000000003.json

One load runs at a time: of two that start from one version, the second to publish fails and is to be run again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from custscope.sources import files

MANIFESTS = "_versiones"
FOLDER = "version"


class Overtaken(RuntimeError):
    """Another load has published since this one began."""


@dataclass(frozen=True)
class Stored:
    """One table in a manifest: its partition column, the schema with that column last, and folder and rows by partition.

    A table without partitions has no column and one part without a name.
    """

    column: str
    schema: str
    parts: dict[str, tuple[str, int]]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts.values())


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    tables: dict[str, Stored] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "notes": self.notes, "tables": {k: vars(t) for k, t in self.tables.items()}})

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        tables = {
            name: Stored(t["column"], t["schema"], {k: (folder, n) for k, (folder, n) in t["parts"].items()})
            for name, t in raw["tables"].items()
        }
        return Manifest(raw["number"], tables, raw["notes"])


def published(spark: SparkSession, root: str) -> list[int]:
    found = files.names_in(spark, f"{root.rstrip('/')}/{MANIFESTS}")
    return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json"))


def manifest(spark: SparkSession, root: str, number: int | None = None) -> Manifest:
    """The version with this number, or the newest; an empty one where nothing was published."""
    if number is None:
        numbers = published(spark, root)
        if not numbers:
            return Manifest()
        number = numbers[-1]
    return Manifest.from_json(files.read_text(spark, f"{root.rstrip('/')}/{MANIFESTS}/{number:010d}.json"))


def read(
    spark: SparkSession, root: str, name: str, of: Manifest | None = None, parts: Iterable[str] | None = None
) -> DataFrame | None:
    """The rows of a table in a version (the newest), or only of some of its partitions; None if the version lacks the table.

    Only the folders named by the manifest are listed, and filters on the partition column leave the others unread.
    """
    of = of or manifest(spark, root)
    if name not in of.tables:
        return None
    table = of.tables[name]
    schema = StructType.fromJson(json.loads(table.schema))
    wanted = table.parts if parts is None else [p for p in parts if p in table.parts]
    base = f"{root.rstrip('/')}/{name}"
    paths = [f"{base}/{FOLDER}={table.parts[p][0]}" + (f"/{table.column}={p}" if table.column else "") for p in wanted]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])


class Version:
    """The next version of the tables under `root`, seen by nobody before `publish`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = manifest(spark, root)
        self.number = self.base.number + 1
        self.folder = f"{self.number:010d}-{uuid.uuid4().hex[:12]}"
        self.tables = dict(self.base.tables)

    def old(self, name: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """What the table held when this version was begun."""
        return read(self.spark, self.root, name, self.base, parts)

    def new(self, name: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """What the table will hold when this version is published."""
        return read(self.spark, self.root, name, Manifest(self.number, self.tables), parts)

    def replace(
        self, name: str, rows: DataFrame, column: str, touched: Iterable[str], cluster_by: Sequence[str] = ()
    ) -> Stored:
        """Writes `rows` in place of the partitions `touched`; those that get no rows are gone, all others stay.

        `cluster_by` orders each partition by these columns, over its files and inside them, and gives the first
        one a bloom filter: a look-up by it reads the few row groups whose range holds the value, and of
        those only such as may have it. Name a key last, so that one value with very many rows still spreads.
        """
        path = f"{self.root}/{name}/{FOLDER}={self.folder}"
        if cluster_by:
            order = [column, *cluster_by]
            # Without the second option every file holds a filter of 1 MB, whatever its rows.
            writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**{
                f"parquet.bloom.filter.enabled#{cluster_by[0]}": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
        else:
            # Gathers each partition in few files; adaptive execution splits one that is too large.
            writer = rows.hint("rebalance", column).write
        writer.mode("errorifexists").partitionBy(column).parquet(path)
        body = StructType([f for f in rows.schema if f.name != column])
        schema = StructType([*body, StructField(column, StringType())])
        written = self.spark.read.schema(StructType([StructField(column, StringType())])).parquet(path)
        counts = written.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per partition
        before = self.tables[name].parts if name in self.tables else {}
        gone = set(touched)
        parts = {p: where for p, where in before.items() if p not in gone}
        parts |= {r[0]: (self.folder, r[1]) for r in counts}
        self.tables[name] = Stored(column, json.dumps(schema.jsonValue()), dict(sorted(parts.items())))
        return self.tables[name]

    def replace_all(self, name: str, rows: DataFrame) -> Stored:
        """Writes `rows` as the whole of a table without partitions."""
        path = f"{self.root}/{name}/{FOLDER}={self.folder}"
        rows.write.mode("errorifexists").parquet(path)
        n = self.spark.read.schema(rows.schema).parquet(path).count()  # from the footers
        self.tables[name] = Stored("", json.dumps(rows.schema.jsonValue()), {"": (self.folder, n)})
        return self.tables[name]

    def publish(self, **notes) -> Manifest:
        """Makes this version the newest. Notes of earlier versions stay unless they are given anew."""
        done = Manifest(self.number, self.tables, {**self.base.notes, **notes})
        folder = f"{self.root}/{MANIFESTS}"
        draft = f"{folder}/.{self.folder}"
        files.write_text(self.spark, draft, done.to_json())
        if not files.rename_new(self.spark, draft, f"{folder}/{self.number:010d}.json"):
            files.delete(self.spark, draft)
            raise Overtaken(f"version {self.number} of {self.root} was published by another load")
        return done


def vacuum(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Removes manifests but the newest `keep`, and folders that none of those names; not while a load runs.

    Readers of an older version fail afterwards, so `keep` has to outlast the longest of them.
    """
    root = root.rstrip("/")
    numbers = published(spark, root)
    if not numbers:
        return []
    for number in numbers[:-keep]:
        files.delete(spark, f"{root}/{MANIFESTS}/{number:010d}.json")
    named: dict[str, set[str]] = {}
    for number in numbers[-keep:]:
        for name, table in manifest(spark, root, number).tables.items():
            named.setdefault(name, set()).update(f"{FOLDER}={folder}" for folder, _ in table.parts.values())
    gone = []
    for name, folders in named.items():
        for found in files.names_in(spark, f"{root}/{name}"):
            if found.startswith(f"{FOLDER}=") and found not in folders:
                gone.append(f"{root}/{name}/{found}")
                files.delete(spark, gone[-1])
    return gone
