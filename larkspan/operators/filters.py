"""Row filters and row-level normalisation of a catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import blank_to_null, fold_text, joined_fields, norm_text, strip
from larkspan.functions.unicode import fold_literal

# File classes by name.
AUDIO = ("mp3", "m4a", "aac", "wav")
VIDEO = ("mp4",)
PARTIAL_MARK = ".part"
PARTIAL_SUFFIX = ".ytdl"
BACKUP_SUFFIXES = (".bak",)
MANIFEST_NAME = ".downloaded.json"
VALID_ID = r"^[0-9A-Za-z_-]+$"
NON_BODY_LINE = r"^(Kindle|章を読み終えるまで.*|\d+%)$"


def keyword_filter(df: DataFrame, needle: str | None, columns: Sequence[Column]) -> DataFrame:
    """Keep rows whose joined texts contain the needle; case counts, an empty needle keeps all."""
    if not needle:
        return df
    return df.filter(norm_text(joined_fields(columns)).contains(norm_text(F.lit(needle))))


def search_filter(
    df: DataFrame, needle: str | None, columns: Sequence[Column], labels: Column | None = None
) -> DataFrame:
    """Tolerant search: both sides are folded; `labels` (an array) is searched too."""
    folded = fold_literal(needle or "")
    if not folded:
        return df
    fields = [*columns] + ([F.array_join(labels, " ")] if labels is not None else [])
    return df.filter(fold_text(joined_fields(fields)).contains(folded))


def title_filter(df: DataFrame, needle: str | None, title: Column) -> DataFrame:
    """Lower-case title contains the lower-case needle."""
    return df.filter(F.lower(title).contains(needle.lower())) if needle else df


def label_filter(df: DataFrame, wanted: str | None, label: Column, looked_up: Column) -> DataFrame:
    """Label equals; rows without a label use the looked-up one. None keeps all rows."""
    if wanted is None:
        return df
    return df.filter(F.coalesce(blank_to_null(label), looked_up) == wanted)


def category_filter(df: DataFrame, category: str, categories: Column, unclassified: str = "none") -> DataFrame:
    """Array membership; the unclassified id asks for rows with an empty array."""
    if category == unclassified:
        return df.filter(F.size(categories) == 0)
    return df.filter(F.array_contains(categories, category))


def public_category(internal: Column, internal_id: str = "", public_id: str = "none") -> Column:
    return F.when(internal == internal_id, F.lit(public_id)).otherwise(internal)


def internal_category(public: Column, internal_id: str = "", public_id: str = "none") -> Column:
    return F.when(public == public_id, F.lit(internal_id)).otherwise(public)


def saved_filter(df: DataFrame, saved: DataFrame, keys: Sequence[str], saved_only=False, unsaved_only=False) -> DataFrame:
    """All rows, only saved, or only unsaved ones; `saved_only` wins when both are set."""
    if saved_only:
        return df.join(saved.select(*keys), list(keys), "left_semi")
    if unsaved_only:
        return df.join(saved.select(*keys), list(keys), "left_anti")
    return df


def status_filter(df: DataFrame, wanted: str | None, status: Column, default: str = "pending") -> DataFrame:
    return df.filter(F.coalesce(status, F.lit(default)) == wanted) if wanted else df


def classify_file(name: Column, audio_only: bool = True, backups: Sequence[str] = BACKUP_SUFFIXES) -> Column:
    """temp, manifest, backup, media or other. `backups`: the suffixes of saved older files."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    media = AUDIO if audio_only else AUDIO + VIDEO
    return (
        F.when(name == MANIFEST_NAME, "manifest")
        .when(name.contains(PARTIAL_MARK) | name.endswith(PARTIAL_SUFFIX), "temp")
        .when(reduce(or_, [name.endswith(b) for b in backups]), "backup")
        .when(suffix.isin(*media), "media")
        .otherwise("other")
    )


def lookup(df: DataFrame, **key) -> DataFrame:
    """The first row with the key, or no row."""
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.limit(1)


def normalise_raw(series_id, row_id, sub_id, title, sub_title, id_sub: str = "01") -> dict[str, Column]:
    """Columns of a feed row with the fall-backs for missing or empty fields."""
    main = F.coalesce(blank_to_null(series_id), blank_to_null(row_id), F.lit(""))
    sub = F.coalesce(blank_to_null(sub_id), F.lit(id_sub))
    shown = F.coalesce(
        blank_to_null(norm_text(title)), blank_to_null(norm_text(sub_title)), F.concat(main, F.lit("_"), sub)
    )
    return {"site_id": main, "sub_id": sub, "title": shown}


def drop_lines(text: Column, pattern: str = NON_BODY_LINE) -> Column:
    """The text without the lines that match a boilerplate pattern."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~strip(line).rlike(pattern)), "\n")


def selection(answer: Column, count: Column) -> Column:
    """Distinct 1-based ordinals of a text such as `1,3,5`; `a` means all. Out-of-range entries are left out."""
    every = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    picked = F.filter(
        F.transform(F.split(answer, ","), lambda p: F.trim(p).try_cast("int")),
        lambda n: n.isNotNull() & (n >= 1) & (n <= count),
    )
    return F.when(F.lower(F.trim(answer)).isin("a", "all"), every).otherwise(F.array_distinct(picked))


def valid_id(c: Column) -> Column:
    """The id when it has only safe characters, else ''."""
    return F.when(c.rlike(VALID_ID), c).otherwise(F.lit(""))


def safe_or(url: Column, item_id: Column, template: str) -> Column:
    """The url, else one made from the id."""
    return F.coalesce(blank_to_null(url), F.when(valid_id(item_id) != "", F.concat(F.lit(template), item_id)), F.lit(""))


