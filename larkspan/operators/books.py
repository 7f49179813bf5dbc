"""Books as one row each: `pages array<string>`.

A book arrives as one row, so its pages are bounded by one cell and every operator here is a narrow
expression on arrays: no shuffle, and no group that could grow with the data. The two similarity
searches explode the row into (title, page) candidates, prune those that cannot reach the threshold,
and aggregate back per book.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import headings as H
from larkspan.functions.similarity import similarity, similarity_from
from larkspan.functions.text import let, part_title, strip
from larkspan.functions.unicode import nfkc_each
from larkspan.plans.once import once

# Limits of the page rules.
SCAN_PAGES = 30
EXTRA_PAGES = 10
KEYWORD_LINES = 5
ROWS_MIN, ROWS_SHARE = 3, 0.3
VOTERS, VOTE_SHARE_MIN = 4, 0.55
OFFSET_FIRST, OFFSET_LAST = -5, 59
VOTE_HEAD_LINES, VOTE_CHARS, VOTE_CONTAINED = 6, 400, 0.9
TITLE_HEAD_LINES, TITLE_STOP, TITLE_KEEP, TITLE_CONTAINED = 10, 0.8, 0.5, 0.95
HEADING_LINES = 15
FRONT = "前付け"

ENTRY = "struct<title:string,printed_page:int,is_chapter:boolean>"
BOUNDARY = "struct<title:string,page:int>"
PART = "struct<title:string,start_page:int,end_page:int>"


def lines_of(page: Column) -> Column:
    return F.split(page, "\n")


def head_of(page: Column, n: int) -> Column:
    return F.array_join(F.slice(lines_of(page), 1, n), "\n")


def squash_each(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.regexp_replace(x, r"(?U:\s)+", ""))


def prepare(books: DataFrame, pages: str = "pages") -> DataFrame:
    """Add `clean`, the NFKC pages, and `tops`, the squashed NFKC form of the first characters of each page.

    Both come from one call of the Arrow helper per book.
    """
    cut = F.transform(pages, lambda p: F.left(p, F.lit(VOTE_CHARS)))
    read = once(books, **{pages: F.col(pages)})
    both = read.withColumn("_both", nfkc_each(F.concat(F.col(pages), cut)))
    n = F.size(pages)
    return once(
        both, clean=F.slice("_both", F.lit(1), n), tops=squash_each(F.slice("_both", n + 1, n)), n_pages=n
    ).drop("_both")


def with_contents(prepared: DataFrame, pages: str = "pages") -> DataFrame:
    """Add the contents run `toc` and its `entries` to prepared books."""
    run = once(prepared, toc=toc_run(F.col(pages)))
    return once(run, entries=toc_entries(F.col("clean"), F.col("toc")))


def numbers(first, last) -> Column:
    """first..last, empty when last < first (a plain sequence would count down)."""
    a = first if isinstance(first, Column) else F.lit(first)
    b = last if isinstance(last, Column) else F.lit(last)
    return F.when(a <= b, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("double"), lambda a, v: a + v.cast("double"))


# -- contents pages --------------------------------------------------------------------------


def _page_stats(page: Column) -> Column:
    rows = F.filter(F.transform(lines_of(page), strip), lambda x: x != "")
    counted = let(rows, lambda r: F.struct(F.size(F.filter(r, H.is_contents_row)).alias("hits"), F.size(r).alias("n")))
    word = H.has_contents_word(head_of(page, KEYWORD_LINES))
    return let(
        counted,
        lambda c: F.struct(
            c["hits"].alias("hits"), (c["hits"] / F.greatest(c["n"], F.lit(1))).alias("share"), word.alias("word")
        ),
    )


def toc_run(pages: Column) -> Column:
    """(first, last) 1-based contents pages, null when the book has none."""
    stats = F.transform(F.slice(pages, 1, SCAN_PAGES + EXTRA_PAGES), _page_stats)

    def run(s: Column) -> Column:
        starts = lambda p: p["word"] | ((p["hits"] >= ROWS_MIN) & (p["share"] >= ROWS_SHARE))
        goes_on = lambda p: (p["hits"] >= ROWS_MIN) | (p["share"] >= ROWS_SHARE)
        scan = F.least(F.size(s), F.lit(SCAN_PAGES))
        first = F.array_min(F.filter(numbers(1, scan), lambda i: starts(F.element_at(s, i))))

        def close(start: Column) -> Column:
            stop = F.array_min(F.filter(numbers(start + 1, F.size(s)), lambda i: ~goes_on(F.element_at(s, i))))
            return F.when(
                start.isNotNull(), F.struct(start.alias("first"), F.coalesce(stop - 1, F.size(s)).alias("last"))
            )

        return let(first, close)

    return let(stats, run)


def toc_entries(pages: Column, run: Column) -> Column:
    """Contents rows of the pages of a run, in order. `pages` should be NFKC text."""
    rows = F.flatten(
        F.transform(
            F.slice(pages, run["first"], run["last"] - run["first"] + 1),
            lambda p: F.filter(
                F.transform(lines_of(p), lambda line: H.contents_row(line, normalise=False)), lambda r: r.isNotNull()
            ),
        )
    )
    return F.when(run.isNotNull(), rows).otherwise(F.array().cast(f"array<{ENTRY}>"))


def chapters_of(entries: Column) -> Column:
    return F.filter(entries, lambda e: e["is_chapter"])


# -- similarity searches -----------------------------------------------------------------------


def _reachable(title: Column, text: Column, method: str, floor: float) -> Column:
    """The best score that the two lengths allow reaches the floor."""
    a, b = F.length(title), F.length(text)
    best = (2 * F.least(a, b)) / (a + b) if method == "blocks" else F.least(a, b) / F.greatest(a, b)
    return F.coalesce(best, F.lit(0.0)) >= floor


def _scored(df: DataFrame, head: Column, contained: Column, bonus: float, method: str, floor: float) -> DataFrame:
    """Score of the squashed title against a head; candidates that cannot reach the floor are left out."""
    rows = once(df, _head=head, _in=contained).filter(
        F.col("_in") | _reachable(F.col("_title"), F.col("_head"), method, floor)
    )
    title, text = F.col("_title"), F.col("_head")
    score = similarity_from(title, text, floor) if method == "levenshtein" else similarity(title, text, method)
    return rows.withColumn("score", F.when(F.col("_in"), F.greatest(score, F.lit(bonus))).otherwise(score))


def vote_offset(books: DataFrame, key: str, entries: str, method: str = "levenshtein") -> DataFrame:
    """(key, offset, agree): the printed-to-physical offset on which most of the first chapter rows agree.

    Every row votes for its best offset; ties go to the smaller one. Books without an agreed offset give no row.
    `books` comes from `prepare`.
    """
    voters = F.slice(chapters_of(F.col(entries)), 1, VOTERS)
    base = once(books.select(key, "clean", "tops", voters.alias("_voters")).filter(F.size("_voters") >= 2), _voters=F.col("_voters"))
    prepared = once(
        base,
        _titles=squash_each(F.transform("_voters", lambda v: v["title"])),
        _heads=squash_each(F.transform("clean", lambda p: head_of(p, VOTE_HEAD_LINES))),
    ).withColumnRenamed("tops", "_tops")
    per_title = prepared.select(
        key, F.size("_voters").alias("_n"), "_heads", "_tops", "_titles", F.posexplode("_voters").alias("_i", "_v")
    ).select(key, "_n", "_heads", "_tops", "_i", F.col("_v.printed_page").alias("_printed"), F.col("_titles")[F.col("_i")].alias("_title"))
    first = F.greatest(F.lit(OFFSET_FIRST), 1 - F.col("_printed"))
    last = F.least(F.lit(OFFSET_LAST), F.size("_heads") - F.col("_printed"))
    # a candidate takes along its own head and top only, not those of the whole book
    at = lambda name, o: F.element_at(name, F.col("_printed") + o)
    places = F.transform(
        numbers(first, last), lambda o: F.struct(o.alias("offset"), at("_heads", o).alias("_text"), at("_tops", o).alias("_top"))
    )
    tries = per_title.filter("_title <> ''").select(key, "_n", "_i", "_title", F.explode(places).alias("_c")).select(
        key, "_n", "_i", "_title", "_c.*"
    )
    scored = _scored(tries, F.col("_text"), F.col("_top").contains(F.col("_title")), VOTE_CONTAINED, method, VOTE_SHARE_MIN)
    votes = (
        scored.groupBy(key, "_i")
        .agg(F.max_by(F.struct("offset", "score", "_n"), F.struct("score", -F.col("offset"))).alias("b"))
        .filter(F.col("b.score") >= VOTE_SHARE_MIN)
    )
    counted = votes.groupBy(key, F.col("b.offset").alias("offset")).agg(
        F.count("*").alias("agree"), F.first("b._n").alias("_n")
    )
    best = counted.groupBy(key).agg(
        F.max_by(F.struct("offset", "agree", "_n"), F.struct("agree", -F.col("offset"))).alias("b")
    )
    enough = F.col("b.agree") >= F.greatest(F.lit(1), F.floor(F.col("b._n") / 2))
    return best.filter(enough).select(key, F.col("b.offset").alias("offset"), F.col("b.agree").alias("agree"))


def title_pages(books: DataFrame, key: str, entries: str, method: str = "levenshtein") -> DataFrame:
    """(key, pos, title, page): the page on which each chapter title is found.

    The first page with a score of at least 0.8 wins, else the best page (the earliest on ties) from 0.5.
    """
    chapters = chapters_of(F.col(entries))
    base = once(
        books.select(key, "clean", entries),
        _c=chapters,
        _titles=squash_each(F.transform(chapters, lambda v: v["title"])),
        _heads=squash_each(F.transform("clean", lambda p: head_of(p, TITLE_HEAD_LINES))),
        _filled=F.transform("clean", lambda p: strip(p) != ""),
    )
    per_title = base.select(key, "_titles", "_heads", "_filled", F.posexplode("_c").alias("pos", "_e")).select(
        key, "pos", F.col("_e.title").alias("title"), F.col("_titles")[F.col("pos")].alias("_title"), "_heads", "_filled"
    ).filter(F.length("_title") >= 2)
    filled = F.transform("_heads", lambda h, i: F.struct(i.alias("_at"), h.alias("_text"), F.get("_filled", i).alias("_ok")))
    tries = per_title.select(
        key, "pos", "title", "_title", F.explode(F.filter(filled, lambda s: s["_ok"])).alias("_c")
    ).select(key, "pos", "title", "_title", "_c._at", "_c._text")
    scored = _scored(tries, F.col("_text"), F.col("_text").contains(F.col("_title")), TITLE_CONTAINED, method, TITLE_KEEP)
    page = F.col("_at") + 1
    best = scored.groupBy(key, "pos").agg(
        F.first("title").alias("title"),
        F.min(F.when(F.col("score") >= TITLE_STOP, page)).alias("_sure"),
        F.max_by(page, F.struct("score", -page)).alias("_best"),
        F.max("score").alias("_score"),
    )
    return best.filter(F.col("_score") >= TITLE_KEEP).select(key, "pos", "title", F.coalesce("_sure", "_best").alias("page"))


# The same two searches as expressions on the row: no explode, no shuffle. The matching-blocks method needs
# the Arrow helper, which cannot run inside an array expression, so it keeps the exploded form above.


def _row_score(title: Column, head: Column, inside: Column, bonus: float, floor: float) -> Column:
    lev = F.when(_reachable(title, head, "levenshtein", floor), similarity_from(title, head, floor)).otherwise(F.lit(0.0))
    return F.when(inside, F.greatest(lev, F.lit(bonus))).otherwise(lev)


def offset_in_row(clean: Column, tops: Column, entries: Column) -> Column:
    """The agreed offset of `vote_offset` (edit-distance method), null without one."""

    def search(b: Column) -> Column:
        def best(v: Column) -> Column:
            title = F.regexp_replace(v["title"], r"(?U:\s)+", "")

            def tries(name: Column) -> Column:
                def one(o: Column) -> Column:
                    at = v["printed_page"] + o
                    inside = F.element_at(b["tops"], at).contains(name)
                    score = _row_score(name, F.element_at(b["heads"], at), inside, VOTE_CONTAINED, VOTE_SHARE_MIN)
                    return F.struct(score.alias("score"), (-o).alias("down"))

                first = F.greatest(F.lit(OFFSET_FIRST), 1 - v["printed_page"])
                last = F.least(F.lit(OFFSET_LAST), F.size(b["heads"]) - v["printed_page"])
                return F.when(name != "", F.array_max(F.transform(numbers(first, last), one)))

            return let(let(title, tries), lambda r: F.when(r["score"] >= VOTE_SHARE_MIN, -r["down"]))

        votes = F.filter(F.transform(b["voters"], best), lambda o: o.isNotNull())

        def elect(v: Column) -> Column:
            counted = F.transform(
                F.array_distinct(v), lambda o: F.struct(F.size(F.filter(v, lambda x: x == o)).alias("agree"), (-o).alias("down"))
            )
            enough = F.greatest(F.lit(1), F.floor(F.size(b["voters"]) / 2))
            return let(F.array_max(counted), lambda w: F.when(w["agree"] >= enough, -w["down"]))

        return F.when(F.size(b["voters"]) >= 2, let(votes, elect))

    heads = squash_each(F.transform(clean, lambda p: head_of(p, VOTE_HEAD_LINES)))
    voters = F.slice(chapters_of(entries), 1, VOTERS)
    return let(F.struct(voters.alias("voters"), heads.alias("heads"), tops.alias("tops")), search)


def titles_in_row(clean: Column, entries: Column) -> Column:
    """The boundaries of `title_pages` (edit-distance method), by page and then by row."""
    heads = F.transform(
        clean,
        lambda p: F.struct(
            F.regexp_replace(head_of(p, TITLE_HEAD_LINES), r"(?U:\s)+", "").alias("text"), (strip(p) != "").alias("filled")
        ),
    )

    def search(hs: Column) -> Column:
        def found(e: Column, pos: Column) -> Column:
            def scan(name: Column) -> Column:
                scored = F.transform(
                    hs,
                    lambda h, i: F.struct(
                        F.when(
                            h["filled"], _row_score(name, h["text"], h["text"].contains(name), TITLE_CONTAINED, TITLE_KEEP)
                        ).alias("score"),
                        (-(i + 1)).alias("down"),
                    ),
                )
                return F.when(F.length(name) >= 2, let(scored, pick))

            def pick(scores: Column) -> Column:
                sure = F.filter(scores, lambda c: c["score"] >= TITLE_STOP)
                best = F.array_max(F.filter(scores, lambda c: c["score"].isNotNull()))
                page = F.when(F.size(sure) > 0, -F.element_at(sure, 1)["down"]).otherwise(
                    F.when(best["score"] >= TITLE_KEEP, -best["down"])
                )
                return let(
                    page,
                    lambda n: F.when(n.isNotNull(), F.struct(n.alias("page"), pos.alias("pos"), e["title"].alias("title"))),
                )

            return let(F.regexp_replace(e["title"], r"(?U:\s)+", ""), scan)

        hits = F.filter(F.transform(chapters_of(entries), found), lambda r: r.isNotNull())
        return F.transform(F.array_sort(hits), lambda r: F.struct(r["title"].alias("title"), r["page"].alias("page")))

    return F.when(F.size(chapters_of(entries)) > 0, let(heads, search)).otherwise(F.array().cast(f"array<{BOUNDARY}>"))


# -- headings ---------------------------------------------------------------------------------


def heading_rows(pages: Column) -> Column:
    """Boundaries by headings in the first lines of each page (`pages` should be NFKC text).

    At most one per page, and none that repeats the chapter of the last accepted one (running headers).
    """
    found = F.flatten(
        F.transform(
            pages,
            lambda p, i: F.transform(
                F.filter(
                    F.transform(F.slice(lines_of(p), 1, HEADING_LINES), H.heading_of), lambda t: t.isNotNull()
                ),
                lambda t: F.struct(t.alias("title"), H.heading_key(t).alias("key"), (i + 1).alias("page")),
            ),
        )
    )
    start = F.struct(
        F.array().cast(f"array<{BOUNDARY}>").alias("kept"),
        F.lit(None).cast("string").alias("key"),
        F.lit(0).alias("page"),
    )

    def step(acc: Column, h: Column) -> Column:
        new = (h["page"] > acc["page"]) & (acc["key"].isNull() | (acc["key"] != h["key"]))
        return F.when(
            new,
            F.struct(
                F.concat(acc["kept"], F.array(F.struct(F.left(h["title"], F.lit(60)).alias("title"), h["page"].alias("page")))).alias("kept"),
                h["key"].alias("key"),
                h["page"].alias("page"),
            ),
        ).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: acc["kept"])


# -- boundaries and parts -----------------------------------------------------------------------


def monotone_starts(entries: Column, offset: Column, total: Column) -> Column:
    """Chapter boundaries at printed page + offset inside the book, strictly rising."""
    chapters = chapters_of(entries)
    placed = F.transform(
        chapters,
        lambda e, i: F.struct((e["printed_page"] + offset).cast("int").alias("page"), i.alias("i"), e["title"].alias("title")),
    )
    ordered = F.array_sort(F.filter(placed, lambda p: (p["page"] >= 1) & (p["page"] <= total)))

    def first_of_page(s: Column) -> Column:
        return F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["page"] != p["page"]))

    return F.transform(let(ordered, first_of_page), lambda p: F.struct(p["title"].alias("title"), p["page"].alias("page")))


def interval_ends(boundaries: Column, total: Column, front: str = FRONT) -> Column:
    """Parts from each boundary to the page before the next one; the pages before the first get a front part."""
    front_row = F.struct(F.lit(front).alias("title"), F.lit(1).alias("page"))
    whole = F.when(F.element_at(boundaries, 1)["page"] > 1, F.concat(F.array(front_row), boundaries)).otherwise(boundaries)

    def close(b: Column) -> Column:
        return F.transform(
            b,
            lambda s, i: F.struct(
                s["title"].alias("title"),
                s["page"].cast("int").alias("start_page"),
                (F.coalesce(F.get(b, i + 1)["page"], total + 1) - 1).cast("int").alias("end_page"),
            ),
        )

    return F.when(F.size(boundaries) > 0, let(whole, close)).otherwise(F.array().cast(f"array<{PART}>"))


def part_of_page(parts: Column, page: Column) -> Column:
    """The part that holds a page: the one with the greatest start up to it."""
    return F.element_at(F.filter(parts, lambda p: p["start_page"] <= page), -1)


def equal_chunks(total: Column, size: Column, cap: float) -> Column:
    """Equal page ranges: ⌈size / cap⌉ parts of ⌈pages / parts⌉ pages; the last is shorter, empty ones are dropped."""
    parts = F.greatest(F.lit(1), F.ceil(size / cap))
    per_part = F.greatest(F.lit(1), F.ceil(total / parts)).cast("int")
    return let(
        per_part,
        lambda n: F.transform(
            numbers(0, F.ceil(total / n) - 1),
            lambda i: F.struct(
                F.concat(F.lit("part"), (i + 1).cast("string")).alias("title"),
                (i * n + 1).cast("int").alias("start_page"),
                F.least((i + 1) * n, total).cast("int").alias("end_page"),
            ),
        ),
    )


def even_parts(total: Column, count: Column) -> Column:
    """(start, end) of `count` contiguous parts; the first `total mod count` hold one page more."""
    n = F.greatest(F.lit(1), F.least(count, total))
    base, extra = F.floor(total / n), total % n
    return F.transform(
        numbers(0, n - 1),
        lambda i: F.struct(
            (i * base + F.least(i, extra) + 1).cast("int").alias("start_page"),
            ((i + 1) * base + F.least(i + 1, extra)).cast("int").alias("end_page"),
        ),
    )


def prefix_sums(sizes: Column) -> Column:
    """The sum of the first n sizes, for every n from 1, in one pass over a book; books come in Arrow batches."""

    @F.pandas_udf("array<double>")
    def summed(books: pd.Series) -> pd.Series:
        return books.map(lambda book: None if book is None else np.cumsum(np.asarray(book, float)))

    return summed(sizes)


def range_size(sums: Column, start: Column, end: Column) -> Column:
    """The size of the pages from start to end, from prefix sums."""
    at = lambda n: F.coalesce(F.get(sums, n - 1), F.lit(0.0))
    return F.when(end >= start, at(end) - at(start - 1)).otherwise(F.lit(0.0))


def smallest_even_split(sizes: Column, cap: float) -> Column:
    """Part count whose even parts all fit the cap: 1 when all fits, else the smallest from ⌈size / cap⌉; null when none."""
    n = F.size(sizes)

    def search(sums: Column) -> Column:
        total = F.coalesce(F.get(sums, n - 1), F.lit(0.0))
        first = F.least(F.greatest(F.lit(2), F.ceil(total / cap).cast("int")), n)

        def fits(k: Column) -> Column:
            return ~F.exists(even_parts(n, k), lambda p: range_size(sums, p["start_page"], p["end_page"]) > cap)

        # counts after the first fit are not tried
        least = F.aggregate(
            numbers(first, n), F.lit(None).cast("int"), lambda found, k: F.when(found.isNotNull(), found).when(fits(k), k)
        )
        return F.when(total <= cap, F.lit(1)).otherwise(least)

    return let(prefix_sums(sizes), search)


def greedy_pack(sizes: Column, cap: float) -> Column:
    """Part number per page: each part takes as many pages as fit, and at least one.

    One search in the prefix sums of the book for each part; books come in Arrow batches.
    """

    def of_book(book: np.ndarray | None) -> np.ndarray | None:
        if book is None:
            return None
        sums = np.cumsum(np.asarray(book, float))
        starts, at = [], 0
        while at < len(sums):
            starts.append(at)
            before = sums[at - 1] if at else 0.0
            at = max(at + 1, int(np.searchsorted(sums, before + cap, "right")))
        parts = np.zeros(len(sums), np.int32)
        parts[starts] = 1
        return np.cumsum(parts, dtype=np.int32)

    @F.pandas_udf("array<int>")
    def packed(books: pd.Series) -> pd.Series:
        return books.map(of_book)

    return packed(sizes)


def bisect_oversized(parts: Column, sizes: Column, cap: float, depth: int = 4) -> Column:
    """Halve parts above the cap that have at least 3 pages, up to `depth` times."""
    return let(prefix_sums(sizes), lambda sums: _bisected(parts, sums, cap, depth))


def _bisected(parts: Column, sums: Column, cap: float, depth: int = 4) -> Column:
    def halve(p: Column) -> Column:
        mid = F.floor((p["start_page"] + p["end_page"]) / 2).cast("int")
        left = F.struct(
            F.concat(p["title"], F.lit("-1")).alias("title"), p["start_page"].alias("start_page"), mid.alias("end_page")
        )
        right = F.struct(
            F.concat(p["title"], F.lit("-2")).alias("title"), (mid + 1).alias("start_page"), p["end_page"].alias("end_page")
        )
        big = (range_size(sums, p["start_page"], p["end_page"]) > cap) & (p["end_page"] - p["start_page"] >= 2)
        return F.when(big, F.array(left, right)).otherwise(F.array(p))

    for _ in range(depth):
        parts = F.flatten(F.transform(parts, halve))
    return parts


def snap_cuts(start: Column, end: Column, count: Column, fine: Column) -> Column:
    """Cut pages of a part that is split into `count`: each target snaps to the nearest unused fine boundary.

    A boundary farther away than max(5, pages / (2 · count)) leaves the target itself.
    """
    pages = end - start + 1
    tolerance = F.greatest(F.lit(5), F.floor(pages / (2 * count)))
    usable = F.array_sort(F.array_distinct(F.filter(fine, lambda f: (f > start) & (f <= end))))
    state = F.struct(usable.cast("array<int>").alias("left"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, k: Column) -> Column:
        target = (start + F.bround(pages * k / count, 0)).cast("int")
        near = F.array_min(F.transform(acc["left"], lambda f: F.struct(F.abs(f - target).alias("d"), f.alias("f"))))
        hit = near["d"] <= tolerance
        return F.when(
            F.coalesce(hit, F.lit(False)),
            F.struct(
                F.array_remove(acc["left"], near["f"]).alias("left"),
                F.concat(acc["cuts"], F.array(near["f"])).alias("cuts"),
            ),
        ).otherwise(F.struct(acc["left"].alias("left"), F.concat(acc["cuts"], F.array(target)).alias("cuts")))

    return F.aggregate(
        numbers(1, count - 1),
        state,
        step,
        lambda acc: F.array_sort(F.array_distinct(F.filter(acc["cuts"], lambda c: (c > start) & (c <= end)))),
    )


def resplit_oversized(parts: Column, sizes: Column, fine: Column, cap: float) -> Column:
    """Split parts above the cap at snapped cuts, then halve what is still too large."""

    def split(p: Column, sums: Column) -> Column:
        size = range_size(sums, p["start_page"], p["end_page"])
        count = F.greatest(F.lit(2), F.ceil(size / cap).cast("int"))

        def pieces(cuts: Column) -> Column:
            starts = F.concat(F.array(p["start_page"]), cuts)
            return F.transform(
                starts,
                lambda s, i: F.struct(
                    F.concat(p["title"], F.lit(" (part"), (i + 1).cast("string"), F.lit(")")).alias("title"),
                    s.alias("start_page"),
                    F.coalesce(F.get(cuts, i) - 1, p["end_page"]).cast("int").alias("end_page"),
                ),
            )

        cut = let(snap_cuts(p["start_page"], p["end_page"], count, fine), pieces)
        return F.when(size > cap, _bisected(cut, sums, cap)).otherwise(F.array(p))

    return let(prefix_sums(sizes), lambda sums: F.flatten(F.transform(parts, lambda p: split(p, sums))))


def part_name(part: Column, number: Column) -> Column:
    """`NN_title_pA-B`."""
    return F.format_string(
        "%02d_%s_p%d-%d", number, part_title(part["title"]), part["start_page"], part["end_page"]
    )
