"""Compute costly columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read many times.

    Chained projections are merged by the optimizer, which then repeats an expression at every use.
    A generator over one struct is a step of its own, so each column is computed once.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])
