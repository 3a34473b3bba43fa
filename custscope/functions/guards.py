"""Argument and schema checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from custscope.schema import SEGMENT_ORDER


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "the DataFrame") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns {missing}; it has {df.columns}")


def bounded_int(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer in [{low}, {high}], got {value!r}")
    return value


def one_of(name: str, value: str, choices: Iterable[str]) -> str:
    choices = list(choices)
    if value not in choices:
        raise ValueError(f"{name} must be one of {choices}, got {value!r}")
    return value


def segment_list(segments: str | Iterable[str] | None) -> list[str]:
    """A csv string or a list of segment names; nothing selected means all five."""
    if segments is None:
        return list(SEGMENT_ORDER)
    if isinstance(segments, str):
        segments = segments.split(",")
    chosen = [s.strip() for s in segments if s and s.strip()]
    return chosen or list(SEGMENT_ORDER)


def single_segment(segment: str | None) -> str | None:
    """None and 'Todos' both mean no restriction."""
    return None if segment in (None, "", "Todos") else segment
