"""A keyed table that takes batches of changes at the price of the changes.

Rows lie in buckets by a hash of their key. A batch writes only the new images of the keys it touches (or that they are
gone) as a delta run; reading merges the buckets with the runs since, newest first. After `every` runs the touched
buckets are written anew and the runs are done with.

    base/run=<batch>/bucket=<b>     rows of a bucket as of that batch
    delta/batch_id=<batch>          images of that batch, with `gone`
    manifest/version=<batch>        one row: the run of each bucket, and the runs to merge, after that batch

The manifest is written last and each version only refers to files that were there before. A batch that is repeated after a
failure starts from the version before it and overwrites its own run and version, so it is applied once. Buckets and
open runs are bounded in number, so a manifest is small whatever the table holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.session import cut_lineage

BUCKETS = 64
EVERY = 8


class ChangeLog:
    """The table of `rows`, keyed by `key` (unique), below `path`."""

    def __init__(self, path: str, rows: DataFrame, key: str, buckets: int = BUCKETS, every: int = EVERY):
        self.spark: SparkSession = rows.sparkSession
        self.path, self.key, self.buckets, self.every = path.rstrip("/"), key, buckets, every
        self.schema, self.newest = rows.schema, "start"
        self.images = T.StructType([*self.schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("bucket", T.IntegerType())])
        self._say("start", {"bases": self._base("start", rows), "runs": []})

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def read(self, version: str | None = None) -> DataFrame:
        """The rows after a batch (the newest one that was applied here)."""
        state = self._state(version or self.newest)
        return self._merged(state)

    def apply(self, batch: DataFrame, batch_id: int, keys: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame, DataFrame], DataFrame], clear: Callable[[DataFrame], bool] | None = None) -> None:
        """Run `change(rows of the keys that the batch touches, batch)`; keys that it returns no row for are gone.

        `keys(batch)` gives the touched keys in one column. Where `clear(batch)` holds the whole table is emptied first,
        which writes no rows at all.
        """
        before = self._state("start" if batch_id == 0 else str(batch_id - 1))
        if clear is not None and clear(batch):
            before = {"bases": {}, "runs": []}
        asked = cut_lineage(keys(batch).toDF("asked").filter("asked is not null").distinct().withColumn("part", self.bucket(F.col("asked"))))
        parts = {str(r.part) for r in asked.select("part").distinct().collect()}  # at most one row per bucket
        old = self._merged(before, parts).join(asked, F.col(self.key) == F.col("asked"), "left_semi")
        old = cut_lineage(old)
        new = cut_lineage(change(old, batch).select(*self.schema.names))
        lost = old.join(new.select(F.col(self.key).alias("held")), F.col(self.key) == F.col("held"), "left_anti")
        run = new.withColumn("gone", F.lit(False)).unionByName(lost.withColumn("gone", F.lit(True)))
        run.withColumn("bucket", self.bucket(F.col(self.key))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/batch_id={batch_id}")
        after = {"bases": before["bases"], "runs": [*before["runs"], [batch_id, sorted(map(int, parts))]]}
        if len(after["runs"]) >= self.every:
            after = self._compacted(after, batch_id)
        self._say(str(batch_id), after)
        self.newest = str(batch_id)

    def _compacted(self, state: dict, batch_id: int) -> dict:
        """The buckets with open runs are written anew; the others stay where they are."""
        touched = {str(b) for _, parts in state["runs"] for b in parts}
        fresh = self._base(str(batch_id), self._merged(state, touched))
        return {"bases": {b: r for b, r in state["bases"].items() if b not in touched} | fresh, "runs": []}

    def _base(self, run: str, rows: DataFrame) -> dict[str, str]:
        """Write whole buckets; returns the run of each bucket that has rows."""
        target = f"{self.path}/base/run={run}"
        rows.withColumn("bucket", self.bucket(F.col(self.key))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = self.spark.read.schema(T.StructType([T.StructField("bucket", T.IntegerType())])).parquet(target)
        return {str(r.bucket): run for r in written.select("bucket").distinct().collect()}  # at most one row per bucket

    def _merged(self, state: dict, within: set[str] | None = None) -> DataFrame:
        """The rows of the buckets `within`, or of all of them."""
        buckets = [b for b in state["bases"] if within is None or b in within]
        paths = [f"{self.path}/base/run={state['bases'][b]}/bucket={b}" for b in sorted(buckets)]
        empty = self.spark.createDataFrame([], self.schema)
        base = self.spark.read.schema(self.schema).parquet(*paths) if paths else empty
        if not state["runs"]:
            return base
        folders = [f"{self.path}/delta/batch_id={k}" for k, _ in state["runs"]]
        images = self.spark.read.schema(T.StructType([*self.images.fields, T.StructField("batch_id", T.LongType())])).option("basePath", f"{self.path}/delta").parquet(*folders)
        if within is not None:
            images = images.filter(F.col("bucket").isin(*map(int, within)))
        newest = images.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.schema.names if c != self.key], "gone"), "batch_id").alias("image"))
        seen = newest.select(F.col(self.key).alias("held"))
        rows = newest.filter("not image.gone").select(*[F.col(c) if c == self.key else F.col(f"image.{c}").alias(c) for c in self.schema.names])
        return base.join(seen, F.col(self.key) == F.col("held"), "left_anti").unionByName(rows)

    def _say(self, version: str, state: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(state),)], "state string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _state(self, version: str) -> dict:
        return json.loads(self.spark.read.schema("state string").parquet(f"{self.path}/manifest/version={version}").first()[0])
