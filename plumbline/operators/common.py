"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: str, first_seen: str | None = None) -> DataFrame:
    """The last row by ``order`` of each key, as an aggregation: partial on each side of the shuffle, so a hot key doesn't matter.

    ``first_seen`` names a column for the least ``order`` of the key. Null keys are a key.
    """
    rest = [c for c in df.columns if c not in keys]
    extra = [F.min(order).alias(first_seen)] if first_seen else []
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), *extra)
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest], *([first_seen] if first_seen else []))


def share(n: Column, of: Column) -> Column:
    """``n / of``, 0 when ``of`` is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))
