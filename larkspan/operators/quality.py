"""Quality measures of texts and of pages seen as rasters (line = row, character = column, ink = not blank)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import let, squash
from larkspan.operators.filters import drop_lines

# Character class, limits and bands.
CJK = r"[぀-ヿ㐀-鿿！-｠]"
MARGIN, MARGIN_MIN = 0.02, 10
FAILURE_LIMIT = 0.25
SEAM_BAND = (0.40, 0.60)
GAP_SHARE = (0.02, 0.08)
BLANK_MAX, CONTENT_MIN, SIDE_RATIO = 0.008, 0.003, 5
ORDER_RATIO = 1.2
FREE_BELOW, FREE_RIGHT = 60, 80
DEFAULT_W, DEFAULT_H = 100.0, 50.0


# -- texts --------------------------------------------------------------------------------


def pair_texts(truth: DataFrame, output: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every truth, with its other columns, and the output of the same key, '' when there is none."""
    right = output.select(key, F.col(text).alias("output"))
    return truth.withColumnRenamed(text, "truth").join(right, key, "left").withColumn("output", F.coalesce("output", F.lit("")))


def comparable(c: Column) -> Column:
    """The text as an error rate sees it: without boilerplate lines, in compatibility form, without white space."""
    return squash(drop_lines(F.coalesce(c, F.lit(""))))


def error_rate(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sum of edit distances over sum of truth lengths; null without truth."""
    errors = F.sum(F.levenshtein("output", "truth"))
    total = F.sum(F.length("truth"))
    return pairs.groupBy(*group).agg(
        errors.alias("errors"), total.alias("total"), (errors / F.nullif(total, F.lit(0))).alias("cer")
    )


def hit_metrics(detected: DataFrame, truth: DataFrame, engine: str, page: str) -> DataFrame:
    """Per engine the found, expected and false pages."""
    marks = detected.select(engine, page, F.lit(1).alias("d"), F.lit(0).alias("t")).unionByName(
        truth.select(engine, page, F.lit(0).alias("d"), F.lit(1).alias("t"))
    )
    pages = marks.groupBy(engine, page).agg(F.max("d").alias("d"), F.max("t").alias("t"))
    return pages.groupBy(engine).agg(
        F.count_if((F.col("d") == 1) & (F.col("t") == 1)).alias("hits"),
        F.count_if(F.col("t") == 1).alias("expected"),
        F.count_if((F.col("d") == 1) & (F.col("t") == 0)).alias("false_hits"),
    )


def spurious_spaces(c: Column, char_class: str = CJK) -> Column:
    """Number of blank runs between two characters of the class."""
    return F.regexp_count(c, F.lit(rf"(?<={char_class})[ \t　]+(?={char_class})"))


def failure_gate(df: DataFrame, failed: Column, limit: float = FAILURE_LIMIT, strict: bool = False) -> DataFrame:
    """Share of failed rows; with `strict` the query fails when it is above the limit."""
    share = F.avg(F.when(failed, 1.0).otherwise(0.0))
    out = df.agg(share.alias("share")).withColumn("passed", F.col("share") <= limit)
    if strict:
        problem = F.raise_error(F.concat(F.lit("too many failures: "), F.col("share").cast("string")))
        out = out.withColumn("passed", F.when(F.col("passed"), F.lit(True)).otherwise(problem.cast("boolean")))
    return out


def qc_summary(df: DataFrame, group: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Rows, rows without any flag, and rows per flag."""
    any_flag = None
    for flag in flags.values():
        any_flag = flag if any_flag is None else (any_flag | flag)
    return df.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.count_if(~any_flag).alias("ok"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
    )


# -- rasters --------------------------------------------------------------------------------
# A page is one array of lines in one row, so all measures are narrow expressions on that array.


def ink(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def width_of(lines: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))


def band_ink(lines: Column, first: Column, count: Column) -> Column:
    """Ink in the columns [first, first + count) of all lines."""
    return F.aggregate(lines, F.lit(0), lambda acc, s: acc + ink(F.substring(s, first + 1, F.greatest(count, F.lit(0)))))


def rows_ink(lines: Column, first: Column, count: Column) -> Column:
    return F.aggregate(F.slice(lines, first + 1, count), F.lit(0), lambda acc, s: acc + ink(s))


def region_density(lines: Column, share: float = MARGIN, least: int = MARGIN_MIN) -> Column:
    """Ink density of the page and of its four margins."""

    def measure(p: Column) -> Column:
        w, h = p["w"], p["h"]
        mh = F.least(F.greatest(F.lit(least), F.floor(h * share).cast("int")), h)
        mw = F.least(F.greatest(F.lit(least), F.floor(w * share).cast("int")), w)
        whole = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
        return F.struct(
            whole(rows_ink(lines, F.lit(0), h), w * h).alias("page"),
            whole(rows_ink(lines, F.lit(0), mh), w * mh).alias("top"),
            whole(rows_ink(lines, h - mh, mh), w * mh).alias("bottom"),
            whole(band_ink(lines, F.lit(0), mw), mw * h).alias("left"),
            whole(band_ink(lines, w - mw, mw), mw * h).alias("right"),
        )

    return let(F.struct(width_of(lines).alias("w"), F.size(lines).alias("h")), measure)


def content_bbox(lines: Column) -> Column:
    """(x0, y0, x1, y1) of the ink, the whole page when it has none."""
    marked = F.filter(
        F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("y"))), lambda r: ink(r["s"]) > 0
    )

    def box(rows: Column) -> Column:
        some = F.size(rows) > 0
        lead = lambda s: F.length(s) - F.length(F.ltrim(s))
        return F.struct(
            F.when(some, F.array_min(F.transform(rows, lambda r: lead(r["s"])))).otherwise(0).alias("x0"),
            F.when(some, F.element_at(rows, 1)["y"]).otherwise(0).alias("y0"),
            F.when(some, F.array_max(F.transform(rows, lambda r: F.length(F.rtrim(r["s"])) - 1)))
            .otherwise(width_of(lines) - 1)
            .alias("x1"),
            F.when(some, F.element_at(rows, -1)["y"]).otherwise(F.size(lines) - 1).alias("y1"),
        )

    return let(F.when(F.size(marked) > 0, marked).otherwise(F.slice(marked, 1, 0)), box)


def clipped_sides(density: Column, limit_min: float = 0.10) -> Column:
    """Sides whose margin is denser than max(0.10, half the density of the page)."""
    limit = F.greatest(F.lit(limit_min), density["page"] * 0.5)
    return F.filter(
        F.array(*[F.when(density[s] > limit, F.lit(s)) for s in ("top", "bottom", "left", "right")]),
        lambda s: s.isNotNull(),
    )


def column_profile(lines: Column, first: Column, count: Column) -> Column:
    """Ink count of the columns [first, first + count), added up line by line."""
    zero = F.array_repeat(F.lit(0), count)
    chars = lambda s: F.split(F.rpad(F.substring(s, first + 1, count), count, " "), "")
    return F.aggregate(
        lines,
        zero,
        lambda acc, s: F.zip_with(acc, F.slice(chars(s), F.lit(1), count), lambda a, c: a + F.when(c == " ", 0).otherwise(1)),
    )


def seam_band(width: Column) -> tuple[Column, Column]:
    return F.floor(width * SEAM_BAND[0]).cast("int"), F.floor(width * SEAM_BAND[1]).cast("int")


def gap_nearest_centre(profile: Column, first: Column, width: Column) -> Column:
    """Middle of the run of empty columns nearest to the centre; runs must be 2 % to 8 % of the width wide."""
    low, high = F.floor(width * GAP_SHARE[0]).cast("int"), F.floor(width * GAP_SHARE[1]).cast("int")
    state = F.struct(F.array().cast("array<int>").alias("mids"), F.lit(0).alias("start"), F.lit(0).alias("len"))

    def close(acc: Column) -> Column:
        good = (acc["len"] >= F.greatest(low, F.lit(1))) & (acc["len"] <= high)
        mid = (acc["start"] + F.floor(acc["len"] / 2)).cast("int")
        return F.when(good, F.concat(acc["mids"], F.array(mid))).otherwise(acc["mids"])

    def step(acc: Column, c: Column) -> Column:
        empty = c["ink"] == 0
        return F.when(
            empty,
            F.struct(
                acc["mids"].alias("mids"),
                F.when(acc["len"] == 0, c["x"]).otherwise(acc["start"]).alias("start"),
                (acc["len"] + 1).alias("len"),
            ),
        ).otherwise(F.struct(close(acc).alias("mids"), F.lit(0).alias("start"), F.lit(0).alias("len")))

    columns = F.transform(profile, lambda v, i: F.struct((first + i).cast("int").alias("x"), v.alias("ink")))
    mids = F.aggregate(columns, state, step, close)
    centre = F.floor(width / 2).cast("int")
    return F.array_min(F.transform(mids, lambda m: F.struct(F.abs(m - centre).alias("d"), m.alias("m"))))["m"]


def smoothed_argmin(profile: Column, first: Column, width: Column, band_first: Column, band_end: Column, reach: Column, weight: float = 1000.0):
    """Column of the band with the least (moving average + squared distance from the centre); the first on ties.

    The profile covers the band and `reach` columns on both sides, as far as the page has them.
    """
    xs = F.sequence(band_first, band_end - 1)

    def score(x: Column) -> Column:
        a = F.greatest(x - reach, F.lit(0))
        b = F.least(x + reach, width - 1)
        total = F.aggregate(F.slice(profile, a - first + 1, b - a + 1), F.lit(0), lambda s, v: s + v)
        d = (x - width / 2) / (width / 4)
        return F.struct((total / (b - a + 1) + d * d * weight).alias("score"), x.alias("x"))

    return F.when(band_end > band_first, F.array_min(F.transform(xs, score))["x"])


def side_density(lines: Column, width: Column, low: float, high: float) -> Column:
    a, b = F.floor(width * low).cast("int"), F.floor(width * high).cast("int")
    area = (b - a) * F.size(lines)
    return F.coalesce(band_ink(lines, a, b - a) / F.nullif(area, F.lit(0)), F.lit(0.0))


def blank_side(left: Column, right: Column) -> Column:
    """Which outer side is blank while the other has text, else null."""

    def blank(a: Column, b: Column) -> Column:
        return (a < BLANK_MAX) & (b > a * SIDE_RATIO) & (b > CONTENT_MIN)

    return F.when(blank(right, left), "right").when(blank(left, right), "left")


def page_order(left_ink: Column, right_ink: Column) -> Column:
    return F.when(right_ink > left_ink * ORDER_RATIO, "right_first").otherwise("left_first")


def bounds(df: DataFrame, group: Sequence[str], x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Bounding box with default sizes, and the next free positions below and to the right."""
    x0, y0 = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    w0, h0 = F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(DEFAULT_W)), F.coalesce(F.nullif(h, F.lit(0.0)), F.lit(DEFAULT_H))
    return df.groupBy(*group).agg(
        F.min(x0).alias("min_x"), F.min(y0).alias("min_y"), F.max(x0 + w0).alias("max_x"), F.max(y0 + h0).alias("max_y")
    ).withColumns(
        {
            "next_y": F.floor(F.col("max_y") + FREE_BELOW + 0.5).cast("double"),
            "next_x": F.floor(F.col("max_x") + FREE_RIGHT + 0.5).cast("double"),
        }
    )
