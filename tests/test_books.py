import difflib
import random

import pytest
from pyspark.sql import functions as F

from larkspan.functions import headings as H
from larkspan.operators import books as B
from larkspan.plans import chapters as C


def one(spark, column, **cols):
    df = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(column.alias("v")).first().v


def ints(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def test_heading_rows_with_two_keys_per_page(spark):
    pages = ["Chapter 1 A", "Chapter 1 A\nbody", "Chapter 1\nPart 2 x", "Part 2\nChapter 1", "no", "CHAPTER 9\n"]
    df = spark.createDataFrame([(1, pages)], "id int, pages array<string>")
    got = B.prepare(df).select(F.explode(B.heading_rows(F.col("clean"))).alias("h")).select("h.*").collect()
    # page 4 starts with the chapter accepted last, so its second heading counts
    assert [(r.title, r.page) for r in got] == [("Chapter 1", 1), ("Part 2", 3), ("Chapter 1", 4), ("CHAPTER 9", 6)]


def test_toc_run_ends_at_body(spark):
    rows = "\n".join(f"Chapter {i} x .... {i}" for i in range(1, 4))
    pages = ["Title", "目次\n" + rows, rows, "body\nbody", rows]
    df = spark.createDataFrame([(1, pages), (2, ["a", "b"]), (3, ["Contents"])], "id int, pages array<string>")
    got = {r.id: r.t for r in df.select("id", B.toc_run(F.col("pages")).alias("t")).collect()}
    assert (got[1]["first"], got[1]["last"]) == (2, 3)
    assert got[2] is None
    assert (got[3]["first"], got[3]["last"]) == (1, 1)


def cuts_by_hand(start, end, count, fine):
    pages, left, cuts = end - start + 1, sorted({f for f in fine if start < f <= end}), []
    reach = max(5, pages // (2 * count))
    for k in range(1, count):
        target = start + round(pages * k / count)
        near = min(left, key=lambda f: (abs(f - target), f), default=None)
        if near is not None and abs(near - target) <= reach:
            left.remove(near)
            cuts.append(near)
        else:
            cuts.append(target)
    return sorted({c for c in cuts if start < c <= end})


@pytest.mark.parametrize("seed", range(6))
def test_snap_cuts(spark, seed):
    rng = random.Random(seed)
    start, pages, count = rng.randrange(1, 30), rng.randrange(3, 90), rng.randrange(2, 7)
    fine = [rng.randrange(1, 130) for _ in range(rng.randrange(0, 12))]
    got = one(spark, B.snap_cuts(F.lit(start), F.lit(start + pages - 1), F.lit(count), ints(fine)))
    assert got == cuts_by_hand(start, start + pages - 1, count, fine)


@pytest.mark.parametrize("seed", range(4))
def test_parts_cover_every_page_once(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(5, 40)
    sizes = [rng.randrange(1, 100) for _ in range(n)]
    bounds = sorted(rng.sample(range(1, n + 1), rng.randrange(1, min(n, 6))))
    b = F.array(*[F.struct(F.lit(f"t{p}").alias("title"), F.lit(p).alias("page")) for p in bounds])
    s = ints(sizes)
    parts = one(spark, B.resplit_oversized(B.interval_ends(b, F.lit(n)), s, ints([]), 120.0))
    pages = [p for part in parts for p in range(part.start_page, part.end_page + 1)]
    assert pages == list(range(1, n + 1))
    assert (parts[0].title == "前付け" or parts[0].title.startswith("前付け ")) == (bounds[0] > 1)
    packed = one(spark, B.greedy_pack(s, 120.0))
    used, part, want = 0, 0, []
    for v in sizes:
        part, used = (part + 1, v) if part == 0 or used + v > 120 else (part, used + v)
        want.append(part)
    assert packed == want
    even = one(spark, B.even_parts(F.lit(n), F.lit(4)))
    lengths = [p.end_page - p.start_page + 1 for p in even]
    assert sum(lengths) == n and max(lengths) - min(lengths) <= 1 and lengths == sorted(lengths, reverse=True)


def test_equal_chunks_and_even_split(spark):
    got = one(spark, B.equal_chunks(F.lit(10), F.lit(35.0), 10.0))
    assert [(p.title, p.start_page, p.end_page) for p in got] == [("part1", 1, 3), ("part2", 4, 6), ("part3", 7, 9), ("part4", 10, 10)]
    assert one(spark, B.smallest_even_split(ints([5, 5, 5, 9]), 10.0)) == 3
    assert one(spark, B.smallest_even_split(ints([5, 6, 5, 9]), 10.0)) == 4
    assert one(spark, B.smallest_even_split(ints([11, 1]), 10.0)) is None
    assert one(spark, B.smallest_even_split(ints([1, 1]), 10.0)) == 1


def score_by_hand(title, text, contained, bonus):
    score = difflib.SequenceMatcher(None, title, text).ratio()
    return max(score, bonus) if contained else score


def books(spark):
    def book(i, offset, noise):
        rng = random.Random(i)
        names = ["Alpha beta", "Gamma", "Delta zeta", "Omega"]
        rows = "\n".join(f"Chapter {k + 1} {n} ..... {k * 2 + 1}" for k, n in enumerate(names))
        front = ["Contents\n" + "filler words " * 40 + "\n" + rows] + ["blank"] * (offset - 1)
        body = []
        for k, n in enumerate(names):
            title = f"Chapter {k + 1} {n}"
            if noise:
                title = "".join(c if rng.random() > 0.1 else "#" for c in title)
            body += [title, "text " * rng.randrange(1, 30)]
        return (i, front + body)

    return spark.createDataFrame([book(1, 1, False), book(2, 3, False), book(3, 2, True), book(4, 4, True)], "doc_id int, pages array<string>")


def squash(s):
    return "".join(s.split())


def test_blocks_method_matches_by_hand(spark):
    df = B.with_contents(B.prepare(books(spark)))
    got = {r.doc_id: r.offset for r in B.vote_offset(df, "doc_id", "entries", "blocks").collect()}
    found = {(r.doc_id, r.pos): r.page for r in B.title_pages(df, "doc_id", "entries", "blocks").collect()}
    for row in df.collect():
        pages, entries = row.pages, [e for e in row.entries if e.is_chapter]
        votes = {}
        for e in entries[:4]:
            best = None
            for off in range(-5, 60):
                at = e.printed_page + off
                if 1 <= at <= len(pages):
                    page = pages[at - 1]
                    t = squash(e.title)
                    s = score_by_hand(t, squash("".join(page.split("\n")[:6])), t in squash(page[:400]), 0.9)
                    if best is None or s > best[0]:
                        best = (s, off)
            if best and best[0] >= 0.55:
                votes[best[1]] = votes.get(best[1], 0) + 1
        top = min(votes, key=lambda o: (-votes[o], o)) if votes else None
        if top is not None and votes[top] < max(1, len(entries[:4]) // 2):
            top = None
        assert got.get(row.doc_id) == top
        for pos, e in enumerate(entries):
            t = squash(e.title)
            scores = [score_by_hand(t, squash("".join(p.split("\n")[:10])), t in squash("".join(p.split("\n")[:10])), 0.95) for p in pages]
            sure = [i for i, s in enumerate(scores, 1) if s >= 0.8]
            want = sure[0] if sure else (scores.index(max(scores)) + 1 if max(scores) >= 0.5 else None)
            assert found.get((row.doc_id, pos)) == want


def test_row_form_equals_exploded_form(spark):
    df = B.with_contents(B.prepare(books(spark)))
    far = {r.doc_id: r.offset for r in B.vote_offset(df, "doc_id", "entries").collect()}
    near = df.select(
        "doc_id",
        B.offset_in_row(F.col("clean"), F.col("tops"), F.col("entries")).alias("o"),
        B.titles_in_row(F.col("clean"), F.col("entries")).alias("t"),
    ).collect()
    pages = {}
    for r in B.title_pages(df, "doc_id", "entries").collect():
        pages.setdefault(r.doc_id, []).append((r.page, r.pos, r.title))
    for r in near:
        assert r.o == far.get(r.doc_id)
        assert [(b.title, b.page) for b in r.t] == [(t, p) for p, _, t in sorted(pages.get(r.doc_id, []))]


def test_both_methods_choose_the_contents_tier(spark):
    for method in ("levenshtein", "blocks"):
        got = {r.doc_id: (r.tier, r.offset) for r in C.boundaries_by_tier(books(spark), method=method).collect()}
        assert got[1] == ("contents", 1) and got[2] == ("contents", 3)
    parts = C.split_books(books(spark), 400.0).collect()
    for r in parts:
        assert [p for x in r.parts for p in range(x.start_page, x.end_page + 1)] == list(range(1, len(r.pages) + 1))


def test_pages_keep_private_use_characters(spark):
    df = spark.createDataFrame([(1, ["one  two", "ＡＢ\u0001", None])], "doc_id int, pages array<string>")
    r = B.prepare(df).first()
    assert r.clean == ["one  two", "AB\u0001", None] and r.n_pages == 3


def test_mark_in_text_is_no_contents_row(spark):
    row = H.contents_row(F.col("x"))
    df = spark.createDataFrame([("Intro\u0001 7",), ("Intro ..... 7",)], "x string").select(row["title"].alias("t"))
    assert [r.t for r in df.collect()] == [None, "Intro"]


def test_cuts_of_a_long_book(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(3000)]
    df = spark.createDataFrame([(sizes,), ([],), (None,)], "s array<int>")
    packed, sums, none = (r for r in df.select(B.greedy_pack(F.col("s"), 150.0).alias("p"), B.prefix_sums(F.col("s")).alias("t")).collect())
    used, part, want = 0, 0, []
    for v in sizes:
        part, used = (part + 1, v) if part == 0 or used + v > 150 else (part, used + v)
        want.append(part)
    assert packed.p == want and packed.t[-1] == sum(sizes) and packed.t[10] == sum(sizes[:11])
    assert (sums.p, sums.t, none.p, none.t) == ([], [], None, None)
    whole = F.array(F.struct(F.lit("b").alias("title"), F.lit(1).alias("start_page"), F.size("s").alias("end_page")))
    parts = df.limit(1).select(B.bisect_oversized(whole, F.col("s"), 20_000.0).alias("p")).first().p
    assert len(parts) == 8 and [x for p in parts for x in range(p.start_page, p.end_page + 1)] == list(range(1, 3001))
