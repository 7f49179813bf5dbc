"""Exact duplicates by a tree merge of digest runs, with DataFrame functions only.

Every row belongs to one of `fan_in ** rounds` runs. A run first merges its own rows: one entry per digest with the
best row and the count. In round r the runs whose numbers differ only in digit r exchange entries: an entry moves to
the run that has digit r of its digest's slot, and the entries of up to `fan_in` runs are merged there (`fan_in` 2 is
the plain binomial exchange; 8 takes three of its rounds at once). After the last round a run holds the whole of its
digest slots. No node ever sees more than `fan_in` entries of one digest, so a text that makes up a third of all
rows costs no more than any other.

"Verified" means that SHA-256, byte length and a second, independent hash must all agree at every level: they are the
merge key together, so a collision of one of them never joins two texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import read, shuffle_width, whole
from larkspan.session import cut_lineage

TEXT_KEY = ["_sha", "_bytes", "_check"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, row number, and the key of its text. Texts are read once and not moved."""
    text = whole(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_check"),
    )


def merge_runs(rows: DataFrame, keep: str, fan_in: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(entries of each run after its own merge, entries after the last round)."""
    best = {"largest": F.max_by, "smallest": F.min_by}[keep]
    runs = fan_in**rounds

    def merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy("_node", *TEXT_KEY).agg(
            best(F.struct("_id", "_row"), F.struct("_id", "_row")).alias("_best"), F.sum("_n").alias("_n")
        ).select("_node", *TEXT_KEY, "_best._id", "_best._row", "_n")

    own = merged(rows.select(*rows.columns, F.col("_run").alias("_node"), F.lit(1).cast("long").alias("_n")))
    top = own
    slot = F.pmod(F.xxhash64(*TEXT_KEY), F.lit(runs))
    for r in range(1, rounds + 1):
        low = fan_in**r
        top = merged(top.withColumn("_node", slot % low + F.floor(F.col("_node") / low) * low))
    return own, top


def group_rows(rows: DataFrame, keep: str, fan_in: int = 8) -> DataFrame:
    """`rows` (_id, _row, key columns) with _keep, _keep_row and _size of the group of rows with the same key."""
    rounds = max(1, math.ceil(math.log(max(2, shuffle_width(rows.sparkSession)), fan_in) - 1e-9))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(fan_in**rounds)))
    own, top = merge_runs(rows, keep, fan_in, rounds)
    answers = top.select(*TEXT_KEY, F.col("_id").alias("_keep"), F.col("_row").alias("_keep_row"), F.col("_n").alias("_size"))
    # the answer goes back to the runs first: a text has one entry in a run, however often it occurs there
    told = own.select(F.col("_node").alias("_run"), *TEXT_KEY).join(answers, TEXT_KEY)
    return rows.join(told, ["_run", *TEXT_KEY]).drop("_run")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the smallest (or largest) id is kept. Null texts count as empty, so they
    are copies of each other. A null id sorts before all ids. Of repeated rows with equal id and text exactly one is
    kept. An empty table gives no rows; further columns of `docs` are not read.
    """
    return group_rows(cut_lineage(digest_rows(docs, id_col, text_col)), keep, fan_in).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep_row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, kept: DataFrame, check: Column) -> DataFrame:
    """The rows of `docs` whose doc_id and `check` (of the text) are in `kept`, with all columns; of repeated rows one.

    The window reads its rows as the join left them, so choosing one of repeated rows costs no second shuffle or sort.
    """
    number = F.col("doc_id").cast("long")
    keys = {"k_id": F.coalesce(number, F.lit(0)), "k_null": number.isNull()}
    left = docs.select(F.struct("*").alias("doc"), check.alias("k_check"), *[c.alias(n) for n, c in keys.items()])
    right = kept.select(F.col("check").alias("k_check"), *[c.alias(n) for n, c in keys.items()])
    found = left.join(right, ["k_check", *keys], "left_semi")
    place = F.row_number().over(Window.partitionBy("k_check", *keys).orderBy("k_check"))
    return found.withColumn("place", place).filter("place = 1").select("doc.*")


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns; of repeated rows one."""
    kept = exact_dedup(docs, keep=keep).filter("kept")
    return keep_rows(docs, kept.select("doc_id", F.col("text_sha256").alias("check")), F.sha2(whole("text"), 256))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
