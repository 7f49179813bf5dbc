"""Registry that pairs each Spark query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the parquet tables of one folder: `t.part`, `t.events`, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a query under its function name. `ids` are the inventory ids that it covers."""

    def add(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn

    return add


def load_all() -> dict[str, Query]:
    import importlib
    import pkgutil

    from larkspan import queries

    for module in pkgutil.iter_modules(queries.__path__):
        importlib.import_module(f"larkspan.queries.{module.name}")
    return QUERIES
