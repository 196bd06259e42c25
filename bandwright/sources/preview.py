"""First rows of every table, in a stated order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 6) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)


def preview_all(
    tables: Mapping[str, DataFrame], order_by: Mapping[str, Sequence[str]], rows: int = 6
) -> dict[str, DataFrame]:
    return {name: preview(df, order_by[name], rows) for name, df in tables.items()}
