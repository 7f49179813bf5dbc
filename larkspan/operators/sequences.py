"""Ordered-sequence operators. Groups may be very large: they are cut into pieces (see plans.ordered)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import fold_text
from larkspan.plans.ordered import Running, positions, run_positions, running

# Limits of the capture loops.
STOP_REPEATS = 3
HISTORY = 5
SEARCH_HISTORY = 30


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece, value: str, stop: int = STOP_REPEATS, cap: int | None = None):
    """Rows that differ from the one before, up to the first run with `stop` repeats; at most `cap` rows per key."""
    marked = run_positions(df, keys, order, piece, value)
    ends = marked.filter(F.col("since") == stop).groupBy(*keys).agg(F.min("row").alias("_end"))
    kept = marked.join(ends, list(keys), "left").filter(
        (F.col("since") == 0) & (F.col("_end").isNull() | (F.col("row") < F.col("_end")))
    )
    if cap is not None:
        kept = positions(kept.drop("row"), keys, order, piece, "row").filter(F.col("row") <= cap)
    return kept.select(*df.columns)


def stable_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece, value: str, n: int = 2) -> DataFrame:
    """Per key the first row whose `n` comparisons with the row before it were all equal."""
    marked = run_positions(df, keys, order, piece, value).filter(F.col("since") >= n)
    rest = [c for c in df.columns if c not in keys]
    return marked.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def drop_recent_repeats(
    df: DataFrame, key: str, order: Sequence[str], piece, value: str, max_pages: int, history: int = HISTORY, stop: int = STOP_REPEATS
) -> DataFrame:
    """Rows whose value is not among the last `history` accepted ones; ends after `stop` repeats in a row or `max_pages`.

    The state depends on what was accepted, so rows are folded in order. At most `stop - 1` repeats can lie
    between two accepted rows, so the fold never looks beyond row `max_pages * stop`: rows after it cannot
    change the result, and the list of a key is bounded whatever its size.
    """
    bounded = positions(df.select(key, *order, value), [key], order, piece, "_row").filter(
        F.col("_row") <= max_pages * stop
    )
    item = F.struct(*order, F.col(value).alias("v"))
    lists = bounded.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    item_type = bounded.select(item.alias("i")).schema["i"].dataType.simpleString()
    value_type = df.schema[value].dataType.simpleString()
    start = F.struct(
        F.array().cast(f"array<{item_type}>").alias("kept"),
        F.array().cast(f"array<{value_type}>").alias("recent"),
        F.lit(0).alias("same"),
    )

    def step(acc: Column, row: Column) -> Column:
        over = (acc["same"] >= stop) | (F.size(acc["kept"]) >= max_pages)
        seen = F.array_contains(acc["recent"], row["v"])
        longer = F.concat(acc["recent"], F.array(row["v"]))
        recent = F.when(F.size(longer) > history, F.slice(longer, 2, history)).otherwise(longer)
        return (
            F.when(over, acc)
            .when(seen, F.struct(acc["kept"].alias("kept"), acc["recent"].alias("recent"), (acc["same"] + 1).alias("same")))
            .otherwise(
                F.struct(F.concat(acc["kept"], F.array(row)).alias("kept"), recent.alias("recent"), F.lit(0).alias("same"))
            )
        )

    folded = lists.select(key, F.explode(F.aggregate("rows", start, step, lambda acc: acc["kept"])).alias("r"))
    return folded.select(key, *[F.col(f"r.{c}").alias(c) for c in order], F.col("r.v").alias(value))


def flow_layout(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece, size: Column, start: float = 100, gap: float = 30, name: str = "x"):
    """Position of each element behind the ones before it: start + sum of (size + gap)."""
    out = running(df, keys, order, piece, {name: Running(size + F.lit(float(gap)), "sum", inclusive=False)})
    return out.withColumn(name, F.col(name) + F.lit(float(start)))


def chain_edges(chain: Column) -> Column:
    """Consecutive pairs of `a -> b -> c`, blank parts left out."""
    nodes = F.filter(F.transform(F.split(chain, "->"), lambda n: F.trim(n)), lambda n: n != "")
    n = F.size(nodes)
    pairs = F.arrays_zip(F.slice(nodes, F.lit(1), n - 1).alias("source"), F.slice(nodes, F.lit(2), n - 1).alias("target"))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<source:string,target:string>>"))


def recent_distinct(df: DataFrame, key: str, term: str, order: Sequence[str], limit: int = SEARCH_HISTORY, fold: bool = True):
    """Per key the newest distinct terms, newest first. Terms that fold alike count once, in their newest spelling.

    Terms are reduced before the ranking, and Spark limits each partition before it shuffles for `rank <= limit`.
    """
    rows = df.filter(F.trim(term) != "").select(key, F.trim(term).alias("term"), *order)
    same = fold_text(F.col("term")) if fold else F.col("term")
    newest = F.struct(*order)
    terms = rows.groupBy(key, same.alias("_same")).agg(
        F.max_by("term", newest).alias("term"), F.max(newest).alias("_last")
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_last").desc()))
    return terms.withColumn("rank", rank).filter(F.col("rank") <= limit).select(key, "term", "rank")


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last `n` rows of each key; Spark limits each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("back", rank).filter(F.col("back") <= n)


def active_jobs(df: DataFrame, key: str, order: Sequence[str], piece, event_id: str, request: Column, terminal: Column):
    """Job of every request: the first request since the last terminal event of the item.

    The epoch of a row is the number of terminal events before it; all requests of one epoch share a job.
    """
    marked = df.withColumns({"_req": request, "_end": F.when(terminal, 1).otherwise(0)})
    epochs = running(marked, [key], order, piece, {"epoch": Running(F.col("_end").cast("long"), "sum", inclusive=False)})
    asked = epochs.filter("_req")
    jobs = asked.groupBy(key, "epoch").agg(F.min_by(event_id, F.struct(*order)).alias("job_id"))
    return asked.join(jobs, [key, "epoch"]).select(
        key, event_id, "job_id", (F.col("job_id") == F.col(event_id)).alias("is_new")
    )


def last_error(df: DataFrame, key: str, order: Sequence[str], reason: Column, code: Column) -> DataFrame:
    """Per key the reason of its last error line, else a message with the code."""
    text = F.max_by(reason, F.when(reason.isNotNull(), F.struct(*order)))
    return df.groupBy(key).agg(text.alias("_text"), F.max(code).alias("_code")).select(
        key, F.coalesce("_text", F.concat(F.lit("exit code "), F.col("_code").cast("string"))).alias("reason")
    )


def as_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece, wanted: Column, value: str, name: str) -> DataFrame:
    """Add the value of the latest row up to this one for which `wanted` holds."""
    return running(df, keys, order, piece, {name: Running(F.when(wanted, F.col(value)), "last")})


def speaking_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece, speaking: Column, at: str) -> DataFrame:
    """Contiguous speaking rows per key: start, end and length of each run."""
    marked = df.withColumn("_on", speaking)
    runs = run_positions(marked, keys, order, piece, "_on").filter("_on")
    return runs.groupBy(*keys, (F.col("row") - F.col("since")).alias("_run")).agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("chunks")
    ).drop("_run")
