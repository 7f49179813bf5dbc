"""Session helper and the shared work folder used by checkpoints and stream sinks."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

LOCAL_STEPS = "/tmp/larkspan-steps"


def build_session(name: str = "larkspan", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _configured(spark: SparkSession) -> str | None:
    name = "spark.checkpoint.dir"
    return spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)


def _one_machine(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or one of this machine for a local session without it."""
    folder = _configured(spark)
    if not folder:
        if not _one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = f"file://{LOCAL_STEPS}/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it, for what Spark's own writers can't express. Works in tasks too."""
    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need no copy of their own.

    Without a shared folder on a cluster nothing is sent; the workers then need the package installed.
    """
    context = spark.sparkContext
    if getattr(context, "_larkspan_shipped", False) or not (_configured(spark) or _one_machine(spark)):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(top)))
    uri = work_path(spark, "package") + "/larkspan.zip"
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path))
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    context.addPyFile(uri)
    context._larkspan_shipped = True


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The plan starts anew from a table that survives the loss of executors. Unlike a checkpoint of the
    rows it is computed once, and its known size lets Spark choose the next join.
    """
    path = work_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
