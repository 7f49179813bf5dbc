"""Ordered-group computations that never put a whole group into one task.

A plain window over `partitionBy(key)` sorts every row of a key in one task, which
fails when one key holds a large share of the rows.  Each function here takes a
`piece` column: a value that rises with the sort order (`id div 4096`, a day, an
hour), so a group is cut into pieces of bounded size.

  1. inside `(key, piece)` an ordinary window computes the local value, and the rows are written once,
  2. the last row of each `(key, piece)` has the totals, which are carried along the pieces,
  3. the carried value is joined back on `(key, piece)`.

Only step 2 runs per key, over one small row per piece. Where even these rows are many,
`piece` is a list from coarse to fine, and step 2 is itself done piece by piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import cut_lineage

PIECE = "_piece"


@dataclass(frozen=True)
class Running:
    """One running value: kind is sum, max, min or last (null values are skipped)."""

    value: Column
    kind: str = "sum"
    inclusive: bool = True


def _fold(kind: str, value: Column) -> Column:
    return {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }[kind](value)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carried)
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: Column | Sequence[Column],
    values: dict[str, Running],
    backward: bool = False,
) -> DataFrame:
    """Add running values per key in `order` (a total order), computed piece by piece.

    With `backward` the order is walked from its end, which gives "next row" values.
    """
    keys = list(keys)
    levels = [piece] if isinstance(piece, Column) else list(piece)

    def direction(name: str) -> Column:
        return F.col(name).desc() if backward else F.col(name).asc()

    inputs = {f"_in_{n}": spec.value for n, spec in values.items()}
    fine = levels[0] if len(levels) == 1 else F.struct(*[c.alias(f"p{i}") for i, c in enumerate(levels)])
    base = df.withColumns({PIECE: fine, **inputs})
    ordered = Window.partitionBy(*keys, PIECE).orderBy(*[direction(c) for c in order])
    frame = lambda last: ordered.rowsBetween(Window.unboundedPreceding, last)
    # all values share one exchange and one sort; the last row of a piece has its totals
    local = base.withColumns(
        {f"_p_{n}": _fold(s.kind, F.col(f"_in_{n}")).over(frame(0)) for n, s in values.items()}
        | {f"_l_{n}": _fold(s.kind, F.col(f"_in_{n}")).over(frame(-1)) for n, s in values.items() if not s.inclusive}
        | {"_ends": F.lead(F.lit(True)).over(ordered).isNull()}
    )
    unread = [c for c in inputs if c not in df.columns]
    local = cut_lineage(local.drop(*unread))
    totals = local.filter("_ends").select(*keys, PIECE, *[f"_p_{n}" for n in values])
    carried = _carried(totals, keys, levels, values, backward)
    joined = local.join(carried, [*keys, PIECE], "left")
    return joined.select(
        *df.columns,
        *[_merge(s.kind, F.col(f"_c_{n}"), F.col(f"_p_{n}" if s.inclusive else f"_l_{n}")).alias(n) for n, s in values.items()],
    )


def _carried(totals: DataFrame, keys: list[str], levels: list[Column], values: dict[str, Running], backward: bool) -> DataFrame:
    """keys, PIECE and `_c_` values: what the pieces before a piece hand on, from the totals of the pieces."""
    if len(levels) == 1:
        place = F.col(PIECE).desc() if backward else F.col(PIECE).asc()
        before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *keys, PIECE, *[_fold(s.kind, F.col(f"_p_{n}")).over(before).alias(f"_c_{n}") for n, s in values.items()]
        )
    renamed = totals.withColumnRenamed(PIECE, "_fine")
    above = {f"_c_{n}": Running(F.col(f"_p_{n}"), s.kind, inclusive=False) for n, s in values.items()}
    coarse = [F.col(f"_fine.p{i}") for i in range(len(levels) - 1)]
    return running(renamed, keys, ["_fine"], coarse, above, backward).select(*keys, F.col("_fine").alias(PIECE), *above)


def run_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column | Sequence[Column], value: str) -> DataFrame:
    """Add `row` (1-based) and `since`: how many rows before this one, in a row, have the same value. Nulls are equal.

    One pass over the rows: a piece knows its rows, its first and last value, and where its last run starts; whether its
    first run goes on from the piece before is decided on these few rows.
    """
    keys = list(keys)
    levels = [piece] if isinstance(piece, Column) else list(piece)
    fine = levels[0] if len(levels) == 1 else F.struct(*[c.alias(f"p{i}") for i, c in enumerate(levels)])
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    packed = F.struct(F.col(value).alias("v"))
    place = F.row_number().over(inside).cast("long")
    marked = df.withColumn(PIECE, fine).withColumns({"_place": place, "_before": F.lag(packed).over(inside), "_ends": F.lead(F.lit(True)).over(inside).isNull()})
    starts = F.when(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v")), F.col("_place"))
    whole = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({"_start": F.max(starts).over(whole), "_head": F.first(packed).over(whole)}).drop("_before")
    local = cut_lineage(local)
    ends = local.filter("_ends").select(*keys, PIECE, F.col("_place").alias("_p_row"), packed.alias("_p_last"), "_head", "_start")
    first = _carried(ends, keys, levels, {"row": Running(F.lit(0)), "last": Running(F.lit(0), "last")}, False)
    known = ends.join(first, [*keys, PIECE], "left").withColumn("_offset", F.coalesce("_c_row", F.lit(0)))
    goes_on = F.coalesce(F.col("_head.v").eqNullSafe(F.col("_c_last.v")) & F.col("_c_last").isNotNull(), F.lit(False))
    # where the last run of a piece starts, unless it is the one that came in from the piece before
    known = known.withColumns({"_goes_on": goes_on, "_p_begun": F.when((F.col("_start") > 1) | ~goes_on, F.col("_offset") + F.col("_start"))})
    begun = _carried(known.select(*keys, PIECE, "_p_begun"), keys, levels, {"begun": Running(F.lit(0), "max")}, False)
    told = known.select(*keys, PIECE, "_offset", "_goes_on").join(begun, [*keys, PIECE], "left")
    out = local.join(told, [*keys, PIECE], "left")
    row, own = F.coalesce("_offset", F.lit(0)) + F.col("_place"), F.coalesce("_offset", F.lit(0)) + F.col("_start")
    start = F.when((F.col("_start") == 1) & F.coalesce("_goes_on", F.lit(False)), F.col("_c_begun")).otherwise(own)
    return out.select(*df.columns, row.alias("row"), (row - start).alias("since"))


def rank(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """1-based place of each row in the total `order` of the whole table.

    Rows are dealt by ranges of the order and sorted there, written once with their place in the partition, and the
    rows of the partitions before are added: one number per partition, so no task sees more than its range. `order`
    must be total, or equal rows would have to share a range.
    """
    mark = "_place"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of the id are the partition, the lower 33 the row in it
    placed = cut_lineage(dealt.withColumn(mark, F.monotonically_increasing_id()))
    part = F.shiftright(mark, 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    found = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return found.select(*df.columns, (F.col("_first") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column | Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based row number per key."""
    return running(df, keys, order, piece, {name: Running(F.lit(1).cast("long"))})


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column | Sequence[Column], columns: dict[str, str]
) -> DataFrame:
    """Add the value of the previous row of the key (`{new name: column}`), null on the first row."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    out = running(df, keys, order, piece, {"_prev": Running(packed, "last", inclusive=False)})
    return out.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in columns])


def following(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column | Sequence[Column], columns: dict[str, str]
) -> DataFrame:
    """Add the value of the next row of the key (`{new name: column}`), null on the last row."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    out = running(df, keys, order, piece, {"_next": Running(packed, "last", inclusive=False)}, backward=True)
    return out.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in columns])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and per share the exact quantile of `value`, linear between two ranks, for all groups at once.

    Equal values of a group are counted before the shuffle and dealt by ranges of the value, so a group of any size is
    cut into pieces. The totals of the pieces tell which of them hold the wanted ranks; only these are looked through.
    Nulls take no part; a group without values has no row. Null keys are a group.
    """
    key = F.struct(F.lit(0).alias("_all"), *keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(key.alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = cut_lineage(counts.repartitionByRange("_v").withColumn(PIECE, F.spark_partition_id()))
    group = Window.partitionBy("_key")
    before = group.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_key", PIECE).agg(F.sum("_n").alias("_own"))
    totals = totals.withColumns({"_first": F.coalesce(F.sum("_own").over(before), F.lit(0)), "_total": F.sum("_own").over(group)})
    at = {name: (F.col("_total") - 1) * F.lit(float(share)) for name, share in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()])))
    wanted = totals.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_own"))))
    found = counts.join(wanted.filter(F.size("_ranks") > 0).drop("_own"), ["_key", PIECE])
    upto = F.col("_first") + F.sum("_n").over(Window.partitionBy("_key", PIECE).orderBy("_v"))
    found = found.withColumn("_end", upto)
    hit = F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))
    found = found.select("_key", "_v", "_total", F.explode(hit).alias("_rank"))

    def between(a: Column) -> Column:
        low = F.max(F.when(F.col("_rank") == F.floor(a), F.col("_v")))
        high = F.max(F.when(F.col("_rank") == F.ceil(a), F.col("_v")))
        share = F.max(a - F.floor(a))
        return F.when(low == high, low.cast("double")).otherwise((1 - share) * low + share * high)

    picked = found.groupBy("_key").agg(*[between(a).alias(name) for name, a in at.items()])
    return picked.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *shares)
