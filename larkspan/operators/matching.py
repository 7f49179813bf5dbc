"""Matching of stored files with catalogue events, retention and clean-up plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import let, safe_name, title_budget, truncate_bytes
from larkspan.operators.filters import classify_file
from larkspan.plans.once import once
from larkspan.plans.ordered import Running, running
from larkspan.session import cut_lineage

# Preference of file kinds.
SUFFIX_RANK = {"mp3": 0, "m4a": 1, "aac": 2, "wav": 3, "mp4": 4}
# Length of the grams that stand for a title where it may lie anywhere.
GRAM = 3
# Events of a folder and date up to which each of its files meets them all.
FEW = 8


def two_dates(utc_day: Column, local_shown: Column) -> Column:
    """The dates under which an event may be stored: the UTC day and the local day, distinct."""
    local = F.regexp_extract(local_shown, r"^(\d{4})-(\d{2})-(\d{2})", 0)
    return F.array_distinct(
        F.filter(F.array(F.trim(F.coalesce(utc_day, F.lit(""))), F.replace(local, F.lit("-"), F.lit(""))), lambda d: d != "")
    )


def _date_windows(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(name, F.lit(r"(?=(\d{8}))"), F.lit(1)))


def _title_candidates(name: Column) -> Column:
    """Every text that an event title must equal for the file to match it.

    The stem, and each stretch after an underscore up to a later dot (or the end when there is no dot).
    """
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    at = lambda ch: F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)) == ch)
    dots = F.when(name.contains("."), at(".")).otherwise(F.array(F.length(name) + 1))
    stretches = F.flatten(
        F.transform(
            at("_"),
            lambda i: F.transform(
                F.filter(dots, lambda j: j > i + 1), lambda j: F.substring(name, i + 1, j - i - 1)
            ),
        )
    )
    return F.array_distinct(F.concat(F.array(stem), stretches))


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def match_files(events: DataFrame, files: DataFrame, mode: str = "exact", audio_only: bool = True, few: int = FEW) -> DataFrame:
    """(event_key, path) pairs of stored files.

    `events`: dir, event_key, item_titles (safe names), title (raw), dates (array).
    `files`: dir, path, name.

    exact     the title equals the stem, or ends it after `_`, or stands between `_` and `.`
    contains  the title occurs anywhere in the safe name

    Comparing every file of a folder with every event would be a theta join. Files meet events in blocks of
    (dir, date). In a block of at most `few` events a file meets them all, which moves a file once per date. In larger
    blocks they meet by the exact titles (or the first gram of the title) that a match must share: there both sides are
    exploded to these. The full predicate is checked on what meets, so the keys only have to be complete.
    """
    named = files.withColumn("_kind", classify_file(F.col("name"), audio_only))
    usable = named.filter("_kind = 'media'" if audio_only else "_kind not in ('temp', 'manifest', 'backup')")
    exact = mode == "exact"

    # the dates once per event, then one row per date
    listed = once(events, _days=F.when(F.size("dates") > 0, F.col("dates")).otherwise(F.array(F.lit(""))))
    dated = listed.select(
        "dir", "event_key", "item_titles", F.trim(F.coalesce(F.col("title"), F.lit(""))).alias("_raw"),
        F.explode("_days").alias("_date"),
    ).withColumn("_date_key", F.when(F.col("_date").rlike(r"^\d{8}$"), F.col("_date")).otherwise(F.lit("")))
    flag = F.col("_raw") == "" if exact else F.length(safe_name(F.col("_raw"))) < GRAM
    block = ["dir", "_date_key"]
    blocks = cut_lineage(dated.groupBy(*block).agg(F.max(flag).alias("_flag"), F.count("*").alias("_n")))
    windows = _date_windows(F.col("name"))
    # without events that have no date, no file is asked for them
    if not blocks.filter("_date_key = ''").isEmpty():
        windows = F.concat(windows, F.array(F.lit("")))
    found = usable.select("dir", "path", "name", F.explode(windows).alias("_date_key"))
    wide = ["event_key", "item_titles", "_raw", "_date", "path", "name"]

    # the three sides share one partitioning; the few events of a block are the side that is held
    events_of_few = dated.join(blocks.filter(F.col("_n") <= few).select(*block), block)
    pairs = found.join(events_of_few, block).select(*wide)
    if not (large := blocks.filter(F.col("_n") > few)).isEmpty():
        pairs = pairs.unionByName(_by_titles(dated, found, large, exact).select(*wide))
    hit = once(pairs.filter(F.col("name").contains(F.col("_date"))), _safe_name=safe_name(F.col("name"))).filter(
        (_title_fits() if exact else F.col("_safe_name").contains(safe_name(F.col("_raw"))))
        & F.exists("item_titles", lambda i: F.col("_safe_name").contains(i))
    )
    return hit.select("event_key", "path").distinct()


def _by_titles(dated: DataFrame, found: DataFrame, blocks: DataFrame, exact: bool) -> DataFrame:
    """Files and events of the `blocks` that share a title (or the first gram of one)."""
    if exact:
        titles = F.when(F.col("_raw") == "", F.array(F.lit(""))).otherwise(_variants())
    else:
        titles = let(
            safe_name(F.col("_raw")),
            lambda n: F.array(F.left(n, F.when(F.length(n) >= GRAM, F.lit(GRAM)).otherwise(F.lit(1)))),
        )
    # the spellings are made behind an exchange on folder and date: rows that meet nothing are gone by then
    block = ["dir", "_date_key"]
    wanted = found.select(*block).join(blocks.select(*block), block, "left_semi").distinct()
    asked = dated.join(wanted, block, "left_semi").hint("rebalance", *block)
    left = asked.select("dir", "event_key", "item_titles", "_raw", "_date", "_date_key", F.explode(titles).alias("_title_key"))

    # files: only dates and folders with events go on
    met = found.join(blocks, block).hint("rebalance", *block)
    none = F.array().cast("array<string>")
    if exact:
        keys = F.concat(let(F.col("name"), _title_candidates), F.when(F.col("_flag"), F.array(F.lit(""))).otherwise(none))
    else:
        keys = let(
            safe_name(F.col("name")),
            lambda n: F.concat(_grams(n, GRAM), F.when(F.col("_flag"), _grams(n, 1)).otherwise(none)),
        )
    right = met.withColumn("_title_key", F.explode(keys)).select("dir", "path", "name", "_date_key", "_title_key")

    return left.join(right, [*block, "_title_key"])


def _variants() -> Column:
    """Spellings of the title: safe and raw, and both cut to the bytes that the item title leaves."""

    def spell(safe: Column) -> Column:
        both = F.array(safe, F.col("_raw"))
        cut = F.flatten(
            F.transform(
                "item_titles",
                lambda i: F.array(truncate_bytes(safe, title_budget(i)), truncate_bytes(F.col("_raw"), title_budget(i))),
            )
        )
        budget = F.array_min(F.transform("item_titles", title_budget))
        # a title that fits the smallest budget has no shortened spelling
        return F.array_distinct(F.when(F.octet_length("_raw") <= budget, both).otherwise(F.concat(both, cut)))

    return let(safe_name(F.col("_raw")), spell)


def _title_fits() -> Column:
    name, stem = F.col("name"), F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    mark = F.lit("_")
    fits = lambda v: (v != "") & (
        (stem == v) | stem.endswith(F.concat(mark, v)) | name.contains(F.concat(mark, v, F.lit(".")))
    )
    return (F.col("_raw") == "") | F.exists(_variants(), fits)


def best_match(matches: DataFrame, key: str, date_first: Column, title_exact: Column, suffix: Column, mtime: Column, path: str):
    """The preferred file per event: date and title prefix, exact title, kind, newest, path. One aggregate, no sort."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SUFFIX_RANK.items() for x in kv])[F.lower(suffix)], F.lit(99))
    order = F.struct(
        F.when(date_first, 0).otherwise(1).alias("a"),
        F.when(title_exact, 0).otherwise(1).alias("b"),
        rank.alias("c"),
        (-mtime).alias("d"),
        F.col(path).alias("e"),
    )
    return matches.groupBy(key).agg(F.min_by(F.col(path), order).alias(path))


def find_path(events: DataFrame, manifest: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """The manifest path when there is one, else the best file of the scan; `origin` says which."""
    m = manifest.select(key, F.col("path").alias("_m"))
    s = scanned.select(key, F.col("path").alias("_s"))
    joined = events.select(key).join(m, key, "left").join(s, key, "left")
    origin = F.when(F.col("_m").isNotNull(), "manifest").when(F.col("_s").isNotNull(), "scan").otherwise("none")
    return joined.select(key, F.coalesce("_m", "_s").alias("path"), origin.alias("origin"))


def restore_plan(files: DataFrame, active: DataFrame, now: Column, min_age: float, suffix: str = ".bak") -> DataFrame:
    """Each backup of a media file: `restore` when the original is missing, else `delete`.

    Folders in use and files younger than `min_age` seconds are left out. `files`: dir, name, age columns.
    """
    n = len(suffix)
    backups = files.filter(F.col("name").endswith(suffix)).withColumn(
        "original", F.expr(f"substring(name, 1, length(name) - {n})")
    )
    wanted = backups.filter(
        (classify_file(F.col("original"), audio_only=False) == "media") & (now - F.col("mtime") >= min_age)
    ).join(active.select("dir"), "dir", "left_anti")
    present = files.select("dir", F.col("name").alias("original"), F.lit(True).alias("_there")).distinct()
    return wanted.join(present, ["dir", "original"], "left").select(
        "dir", "name", "original", F.when(F.col("_there"), "delete").otherwise("restore").alias("action")
    )


def evict_plan(files: DataFrame, store: Sequence[str], order: Sequence[str], size: str, piece: Column, limit: int) -> DataFrame:
    """Files to delete so that each store fits its limit: the oldest go until the rest fits.

    The running size is computed piece by piece, so one large store is spread over many tasks.
    """
    if limit <= 0:
        return files.limit(0)
    totals = files.groupBy(*store).agg(F.sum(size).alias("_total")).filter(F.col("_total") > limit)
    over = files.join(totals, list(store))
    summed = running(over, store, order, piece, {"_before": Running(F.col(size), "sum", inclusive=False)})
    return summed.filter(F.col("_total") - F.col("_before") > limit).select(*files.columns)


def store_status(files: DataFrame, store: Sequence[str], size: str, mtime: str, warn: int = 100 * 1024 * 1024) -> DataFrame:
    """Size, newest time and over-threshold flag per store."""
    return files.groupBy(*store).agg(
        F.sum(size).alias("size"), F.max(mtime).alias("newest"), (F.sum(size) > warn).alias("over")
    )


