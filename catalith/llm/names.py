"""Run an operator under private column names, so a table's own names never clash with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def sheltered(df: DataFrame, step: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """``step(renamed, name)`` gets ``df`` with positional names, and what a column is called there.

    Of the result, the columns of ``df`` are returned under their own names and in order.
    """
    inside = [f"_in{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, inside, strict=True))
    return step(df.toDF(*inside), at.__getitem__).select(*inside).toDF(*df.columns)
