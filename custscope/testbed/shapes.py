"""One column list per query, applied to the Spark result and to the check SQL alike.

A list reads "name:type name:type": s text, i bigint, n int, b boolean, D date, dK double rounded
to K places. Both engines then return the same names, types and rounding.

The engines round a value that lies exactly halfway in different ways, so a billionth is added
to both first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(spec: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) for p in spec.split()]


def _spark(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind.startswith("d"):
        return (F.round(c.cast("double") + F.lit(1e-9), int(kind[1:])) + F.lit(0.0)).alias(name)
    return c.cast({"s": "string", "i": "bigint", "n": "int", "b": "boolean", "D": "date"}[kind]).alias(name)


def _sql(name: str, kind: str) -> str:
    if kind.startswith("d"):
        return f'round(CAST("{name}" AS DOUBLE) + 1e-9, {kind[1:]}) + 0.0 AS "{name}"'
    target = {"s": "VARCHAR", "i": "BIGINT", "n": "INTEGER", "b": "BOOLEAN", "D": "DATE"}[kind]
    return f'CAST("{name}" AS {target}) AS "{name}"'


def shape(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_spark(*p) for p in _parts(spec)])


def shape_sql(body: str, spec: str) -> str:
    return f"SELECT {', '.join(_sql(*p) for p in _parts(spec))} FROM ({body}) AS result"
