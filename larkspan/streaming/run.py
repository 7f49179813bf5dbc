"""Sources and sinks of the streaming queries. All paths lie in the shared folder of the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import work_path

TRIGGER_BYTES = 256 * 1024 * 1024


def stream_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as an unbounded table. A trigger takes a bounded number of bytes, and so bounds the rows
    of one key that a stateful operator sorts at a time."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES).parquet(path)


def late_arrivals(rows: DataFrame, at: str, ahead: str = "1 millisecond", pieces: int = 4) -> tuple[DataFrame, str]:
    """(the rows as a stream in which every second span of time arrives before the one that precedes it, the delay it needs).

    Each span is a file and a trigger of its own. A last file holds one row with nothing but a time, so far ahead that the
    watermark ends `ahead` of the newest row.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return stream_parquet(spark, _empty(rows), rows.schema), "1 second"
    width = (high - low) / pieces
    span = F.least(F.floor((F.timestamp_diff("MICROSECOND", F.lit(low), F.col(at))) / (width.total_seconds() * 1e6 + 1)), F.lit(pieces - 1))
    path = work_path(spark, "arrivals")
    dealt = rows.filter(F.col(at).isNotNull()).withColumn("span", span.cast("int"))
    for k in range(0, pieces, 2):
        for part in (k + 1, k):
            dealt.filter(F.col("span") == part).drop("span").coalesce(1).write.mode("append").parquet(path)
    late = int(2 * width.total_seconds()) + 2
    kind = dict(rows.dtypes)[at]
    last = (F.lit(high) + F.expr(f"interval {late} seconds") + F.expr(f"interval {ahead}")).cast(kind)
    mark = spark.range(1).select(*[(last if c == at else F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes])
    mark.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, f"{late} seconds"


def _empty(rows: DataFrame) -> str:
    path = work_path(rows.sparkSession, "arrivals")
    rows.limit(0).write.parquet(path)
    return path


def read_progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as an unbounded table with a `line` column and the time of arrival."""
    lines = spark.readStream.option("maxBytesPerTrigger", TRIGGER_BYTES).text(path)
    return lines.select(F.col("value").alias("line"), F.current_timestamp().alias("arrived"))


def drain(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> str:
    """Append everything that is available now to a parquet sink; returns its path.

    The file sink commits each batch once, so a restart from the checkpoint neither loses nor repeats rows.
    """
    spark = stream.sparkSession
    out = out or work_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or work_path(spark, f"{name}-checkpoint"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def drain_batches(
    stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None
) -> None:
    """Run `each(batch, batch_id)` for everything that is available now."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint or work_path(spark, f"{name}-checkpoint"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_updates(stream: DataFrame, name: str, key: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Drain an update-mode aggregate; each batch overwrites its own folder, so a repeated batch changes nothing.

    Returns the newest row per key.
    """
    spark = stream.sparkSession
    out = out or work_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    drain_batches(stream, name, write, "update", checkpoint)
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    rest = [c for c in rows.columns if c not in (key, "batch_id")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(key, "r.*")
