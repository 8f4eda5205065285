"""What tells frames apart."""

from __future__ import annotations

from pyspark.sql import DataFrame


def frame_key(*tables: DataFrame) -> list[str]:
    """``recording`` and ``frame``; ``frame`` alone where no table has a ``recording``."""
    has = {"recording" in t.columns for t in tables}
    if len(has) > 1:
        raise ValueError("only some of the tables have a recording")
    return ["recording", "frame"] if has == {True} else ["frame"]


def require(rows: DataFrame, *columns: str) -> DataFrame:
    """The table itself; columns that it lacks raise."""
    if lost := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns are missing: {lost}")
    return rows
