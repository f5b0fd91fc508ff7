"""Sinks. Each write replaces only what it touches and can be repeated after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids
from . import keyed_table

# Every change below is one atomic commit of a keyed table; ``batch`` (writer, number) makes it repeatable.
Batch = tuple[str, int] | None


def write_state(state: DataFrame, path: str, buckets: int = 8) -> None:
    """A new state table, keyed by analysis."""
    keyed_table.create(state, path, "analysis_id", buckets)


def insert_state(rows: DataFrame, path: str, batch: Batch = None) -> bool:
    """Adds rows of analyses that the table does not have yet."""
    return keyed_table.insert(rows, path, batch)


def upsert_state(changes: DataFrame, path: str, batch: Batch = None) -> bool:
    """Replaces the rows of the keys in ``changes`` and adds new ones; other rows stay."""
    return keyed_table.upsert(changes, path, batch)


def delete_state(keys: DataFrame, path: str, batch: Batch = None) -> bool:
    """Removes the rows of the keys in ``keys``."""
    return keyed_table.delete(keys, path, batch)


def write_completed(documents: DataFrame, path: str, batch: Batch = None) -> bool:
    """Merges completed documents, whole or in parts, into the table; anything else is refused by the filter.

    All parts of a document are one key, so a document is replaced as a whole.
    """
    return upsert_state(documents.filter((F.col("status") == "completed") & F.col("result_payload").isNotNull()), path, batch)


def report_lines(metrics: DataFrame, id_col: str = "report_id") -> DataFrame:
    """One compact JSON line per metric, keys in order; floats keep their shortest form."""
    names = [c for c in metrics.columns if c != id_col]
    return metrics.select(id_col, "name", ids.canonical_json({n: F.col(n) for n in names}).alias("line"))


def write_report(metrics: DataFrame, path: str, id_col: str = "report_id") -> None:
    ordered = report_lines(metrics, id_col).repartitionByRange(id_col, "name").sortWithinPartitions(id_col, "name")
    ordered.select("line").write.mode("overwrite").text(path)
