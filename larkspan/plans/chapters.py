"""Books to parts: contents rows, offset by voting, then the fallback ladder, then size-bounded parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators import books as B
from larkspan.plans.once import once

TIERS = ("explicit", "contents", "title_search", "headings", "equal_chunks")


def boundaries_by_tier(books: DataFrame, key: str = "doc_id", method: str = "levenshtein", explicit: str | None = None):
    """Adds `tier`, `boundaries` and the facts that led to them.

    A tier is used when it gives at least two boundaries; an explicit list always wins.
    With the edit-distance method every step is a column of the book: one pass without a shuffle.
    With the matching-blocks method the two searches are exploded and join back on the book key.
    """
    rows = B.with_contents(B.prepare(books))
    in_row = method == "levenshtein"
    joined = once(rows, offset=B.offset_in_row(F.col("clean"), F.col("tops"), F.col("entries"))) if in_row else _searched(rows, key, method)
    none = F.array().cast(f"array<{B.BOUNDARY}>")
    tiers = {
        "contents": F.when(
            F.col("offset").isNotNull(), B.monotone_starts(F.col("entries"), F.col("offset"), F.col("n_pages"))
        ).otherwise(none),
        "title_search": F.coalesce(B.titles_in_row(F.col("clean"), F.col("entries")) if in_row else F.col("_titles"), none),
        "headings": B.heading_rows(F.col("clean")),
    }
    # a tier is worked out only where no tier before it is enough
    wide, open_ = joined, F.lit(True)
    for n, c in tiers.items():
        wide = once(wide, **{f"_t_{n}": F.when(open_, c).otherwise(none)})
        open_ = open_ & (F.size(f"_t_{n}") < 2)
    tier, chosen = F.lit("equal_chunks"), none
    for name in reversed(list(tiers)):
        enough = F.size(f"_t_{name}") >= 2
        tier, chosen = F.when(enough, F.lit(name)).otherwise(tier), F.when(enough, F.col(f"_t_{name}")).otherwise(chosen)
    if explicit is not None:
        given = F.coalesce(F.size(explicit), F.lit(0)) > 0
        pages = F.array_sort(F.transform(explicit, lambda b: F.struct(b["page"].alias("page"), b["title"].alias("title"))))
        listed = F.transform(pages, lambda b: F.struct(b["title"].alias("title"), b["page"].alias("page")))
        tier, chosen = F.when(given, F.lit("explicit")).otherwise(tier), F.when(given, listed).otherwise(chosen)
    return once(
        wide.select(*books.columns, "n_pages", "toc", "entries", "offset", tier.alias("tier"), chosen.alias("boundaries")),
        boundaries=F.col("boundaries"),
    )


def _searched(rows: DataFrame, key: str, method: str) -> DataFrame:
    offsets = B.vote_offset(rows, key, "entries", method).select(key, "offset")
    found = B.title_pages(rows, key, "entries", method)
    # one entry per chapter row of the book
    titles = found.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page", "pos", "title"))),
            lambda s: F.struct(s["title"].alias("title"), s["page"].alias("page")),
        ).alias("_titles")
    )
    return rows.join(offsets, key, "left").join(titles, key, "left")


def split_books(books: DataFrame, cap: float, key: str = "doc_id", method: str = "levenshtein", explicit: str | None = None):
    """One row per book with its tier and its final `parts`."""
    planned = boundaries_by_tier(books, key, method, explicit).withColumn(
        "_sizes", F.transform("pages", lambda p: F.octet_length(p))
    )
    fine = F.transform("boundaries", lambda b: b["page"])
    size = B.array_sum(F.col("_sizes"))
    parts = F.when(
        F.col("tier") == "equal_chunks", B.equal_chunks(F.col("n_pages"), size, cap)
    ).otherwise(B.resplit_oversized(B.interval_ends(F.col("boundaries"), F.col("n_pages")), F.col("_sizes"), fine, cap))
    return once(planned, parts=parts)


def report(split: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report columns of each book, to be written as one JSON document per book."""
    return split.select(
        key,
        F.col("n_pages").alias("total_pages"),
        F.coalesce(F.col("toc.last") - F.col("toc.first") + 1, F.lit(0)).alias("toc_pages_detected"),
        F.size("entries").alias("all_entries_count"),
        F.size(B.chapters_of(F.col("entries"))).alias("chapter_entries_count"),
        "offset",
        F.size("boundaries").alias("boundaries_count"),
        (~F.col("tier").isin("contents", "explicit")).alias("fallback_used"),
        F.col("tier").alias("fallback_type"),
        F.col("parts").alias("outputs"),
    )
