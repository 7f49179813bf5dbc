"""Catalogue operators: merging feeds, facets, labels, sorting, freshness and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.dates import sort_day, sort_duration, sort_ts
from larkspan.functions.text import UNCLASSIFIED, blank_to_null, norm_text

# -- joins ---------------------------------------------------------------------------------


def label_join(df: DataFrame, dim: DataFrame, code: str, dim_code: str, dim_label: str, default: str = UNCLASSIFIED):
    """Left join of a code with its label. No hint: Spark broadcasts the dimension only below its size limit."""
    d = dim.select(F.col(dim_code).alias("_code"), F.col(dim_label).alias("label"))
    return df.join(d, F.col(code) == F.col("_code"), "left").drop("_code").withColumn(
        "label", F.coalesce("label", F.lit(default))
    )


def resolve_or_stub(requests: DataFrame, catalog: DataFrame, keys: Sequence[str], attributes: dict[str, Column]):
    """Requests with the attributes of the catalogue row, or stub attributes made from the request."""
    known = catalog.select(*keys, *attributes, F.lit(True).alias("_known"))
    stub = requests.withColumns({f"_stub_{n}": c for n, c in attributes.items()})
    joined = stub.join(known, list(keys), "left")
    return joined.select(
        *requests.columns,
        *[F.when(F.col("_known"), F.col(n)).otherwise(F.col(f"_stub_{n}")).alias(n) for n in attributes],
        F.coalesce("_known", F.lit(False)).alias("known"),
    )


def saved_keys(events: DataFrame, manifest: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events that the manifest names or that a file matches."""
    known = manifest.select(*keys).unionByName(files.select(*keys))
    return events.join(known, list(keys), "left_semi")


# -- feeds ---------------------------------------------------------------------------------


def union_first(feeds: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of ranked feeds; per key the row that comes first by (feed, order)."""
    whole = None
    for rank, feed in enumerate(feeds):
        ranked = feed.withColumn("feed_rank", F.lit(rank))
        whole = ranked if whole is None else whole.unionByName(ranked)
    rest = [c for c in whole.columns if c not in keys]
    first = whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("feed_rank", *order)).alias("r"))
    return first.select(*keys, "r.*")


def merge_feeds(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    attributes: Sequence[str],
    category: str,
    label: str,
    lookup: Column | None = None,
) -> DataFrame:
    """One row per key: attributes of the first row, ordered distinct categories and labels of all rows.

    Categories are reduced to one row per (key, category) before they are gathered, so a key that
    holds a large share of the rows never becomes one long list. With `lookup` (a map column) all
    labels come from the categories, else each row brings its own.
    """
    ord_ = F.struct(*order)
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*attributes), ord_).alias("a"),
        F.min_by(F.col(category), F.when(F.col(category).isNotNull(), ord_)).alias("category"),
    )

    def gathered(column: str, name: str) -> DataFrame:
        present = rows.filter(F.col(column).isNotNull() & (F.col(column) != ""))
        seen = present.groupBy(*keys, column).agg(F.min(ord_).alias("o"))
        return seen.groupBy(*keys).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("o", F.col(column).alias("v")))), lambda s: s["v"]
            ).alias(name)
        )

    none = F.array().cast("array<string>")
    out = first.join(gathered(category, "categories"), list(keys), "left")
    if lookup is None:
        out = out.join(gathered(label, "labels"), list(keys), "left")
    else:
        out = out.withColumn("labels", F.transform("categories", lambda c: F.coalesce(lookup[c], F.lit(UNCLASSIFIED))))
    return out.select(
        *keys,
        "a.*",
        "category",
        F.coalesce("categories", none).alias("categories"),
        F.coalesce("labels", none).alias("labels"),
    )


# -- facets and labels ---------------------------------------------------------------------------


def facet_counts(
    df: DataFrame, categories: str, dim: DataFrame | None = None, unclassified: str = "none", zero: bool = True
) -> DataFrame:
    """Count per array element. With `zero`, rows without category count as unclassified and every
    dimension row (`category`, `rank`) is kept in its order; without, only what occurs is counted."""
    arr = F.col(categories)
    if zero:
        arr = F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.array(F.lit(unclassified))).otherwise(arr)
    counts = df.select(F.explode(arr).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    if not zero or dim is None:
        return counts
    return dim.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def ordered_labels(df: DataFrame, label: str, order: str, dim: DataFrame, sentinel: str) -> DataFrame:
    """Distinct labels with sort columns: dimension order, then first seen, the sentinel last."""
    seen = df.groupBy(F.col(label).alias("label")).agg(F.min(order).alias("first_seen"))
    ranked = seen.join(dim.select("label", F.col("rank").alias("dim_rank")), "label", "left")
    band = (
        F.when(F.col("label") == sentinel, 2).when(F.col("dim_rank").isNotNull(), 0).otherwise(1)
    )
    return ranked.withColumn("band", band)


def overview(df: DataFrame, key: str, saved: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(saved).alias("saved"))


def outcome_counts(df: DataFrame, saved: DataFrame, keys: Sequence[str], status: Column) -> DataFrame:
    """Done and failed counts of the rows that were not saved before."""
    fresh = df.join(saved.select(*keys), list(keys), "left_anti")
    return fresh.agg(
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "failed").alias("failed"),
    )


# -- sorting -----------------------------------------------------------------------------------


def event_sort_keys(column: str, title: Column, date: Column, shown: Column, time: Column, duration: Column, saved: Column):
    """Sort columns of an event list by title, date, duration or saved state."""
    t = norm_text(title)
    if column == "date":
        ts, day = sort_ts(date), sort_day(F.coalesce(blank_to_null(date), shown))
        return [ts["ok"], ts["ts"], day["ok"], day["day"], norm_text(time), t]
    if column == "duration":
        d = sort_duration(duration)
        return [d["ok"], d["seconds"], t]
    if column == "saved":
        return [saved, t]
    return [t]


def day_sort_keys(df: DataFrame, date: str, shown: str, name: str) -> DataFrame:
    """`df` with the struct `name` of the sort keys of its date texts.

    A list has far fewer days than rows: each spelling is read once and its keys are joined back.
    """
    spelled = df.select(F.col(date).alias("_date"), F.col(shown).alias("_shown")).distinct()
    ts, day = sort_ts(F.col("_date")), sort_day(F.coalesce(blank_to_null(F.col("_date")), F.col("_shown")))
    read = spelled.select("*", F.struct(ts["ok"].alias("k0"), ts["ts"].alias("k1"), day["ok"].alias("k2"), day["day"].alias("k3")).alias(name))
    same = F.col(date).eqNullSafe(F.col("_date")) & F.col(shown).eqNullSafe(F.col("_shown"))
    return df.join(read, same).drop("_date", "_shown")


def sort_by(df: DataFrame, keys: Sequence[Column], position: str, reverse: bool = False, stable: bool = False):
    """Total order by keys and position. `reverse` also turns ties around, unless `stable` keeps them."""
    way = (lambda c: c.desc()) if reverse else (lambda c: c.asc())
    last = F.col(position).asc() if stable or not reverse else F.col(position).desc()
    return df.orderBy(*[way(k) for k in keys], last)


def z_band(element_id: Column, back: Column, front: Column) -> Column:
    """-1 back, 0 middle, 1 front; back wins."""
    return F.when(F.array_contains(back, element_id), -1).when(F.array_contains(front, element_id), 1).otherwise(0)


def corner_list(df: DataFrame, name: str, site: str, corner: str) -> DataFrame:
    """Complete rows, per key the one with the smallest (name, ids)."""
    clean = df.select(
        norm_text(F.col(name)).alias("name"), F.trim(F.col(site)).alias("site"), F.trim(F.col(corner)).alias("corner")
    ).filter("name <> '' and site <> '' and corner <> ''")
    return clean.groupBy(F.concat_ws("_", "site", "corner").alias("key")).agg(
        F.min(F.struct("name", "site", "corner"))["name"].alias("name")
    )


# -- freshness and selection ------------------------------------------------------------------------


def freshest(sources: dict[str, DataFrame], keys: Sequence[str], keep: str, requested: DataFrame) -> DataFrame:
    """Per requested key the value of the first source (in dict order) that has it, and the source name.

    Keys that no source has get the source `error`.
    """
    whole = None
    for rank, (name, df) in enumerate(sources.items()):
        part = df.select(*keys, keep, F.lit(rank).alias("_rank"), F.lit(name).alias("source"))
        whole = part if whole is None else whole.unionByName(part)
    best = whole.groupBy(*keys).agg(F.min_by(F.struct(keep, "source"), "_rank").alias("b"))
    return requested.select(*keys).join(best, list(keys), "left").select(
        *keys, F.col(f"b.{keep}").alias(keep), F.coalesce("b.source", F.lit("error")).alias("source")
    )


def write_back(fetched: DataFrame, keys: Sequence[str], complete: Column, keep_partial: bool = False, size: Column | None = None):
    """Rows of a fetch that may be cached: complete ones, or any non-empty one with `keep_partial`."""
    return fetched.filter((size > 0) if keep_partial else complete)


def first_valid(df: DataFrame, key: str, rank: str, valid: Column, value: str) -> DataFrame:
    """Per key the value of the first valid row by rank, null when none is valid."""
    return df.groupBy(key).agg(F.min_by(F.col(value), F.when(valid, F.col(rank))).alias(value))


def best_variant(df: DataFrame, key: str, variant: str, score: Column, rank: Column) -> DataFrame:
    """Per key the variant with the highest score; the first by rank on ties."""
    return df.groupBy(key).agg(
        F.max_by(F.struct(F.col(variant).alias("variant"), score.alias("score")), F.struct(score, -rank)).alias("b")
    ).select(key, "b.variant", "b.score")
