"""Chapter detection and splitting over books derived from the documents.

Each document becomes a book with one page per line. The variant `doc_id % 5` decides what the book has:

  0  a contents page whose printed numbers are right, and headings
  1  a contents page, but no headings in the body
  2  no contents page, and a running header on every page
  3  neither
  4  a contents page with printed numbers beyond the book, and headings
"""

from pyspark.sql import functions as F

from larkspan.operators import books as B
from larkspan.plans import chapters as C
from larkspan.plans.once import once
from larkspan.registry import query

BOOKS_SQL = r"""
  src as (
    select doc_id, source, doc_id % 5 v, string_split(text, chr(10)) l from documents),
  body as (
    select doc_id, source, v, l, list_transform(range(1, len(l) + 1), lambda b:
      case when v in (0, 4) and b % 2 = 1 then 'Chapter ' || (b + 1) // 2 || ' ' || source || chr(10)
           when v = 2 then 'CHAPTER ' || (b + 1) // 2 || chr(10) else '' end || l[b]) body_pages from src),
  bk as (
    select doc_id, v, case when v in (0, 1, 4) then list_prepend('Contents' || chr(10) || repeat('preface words ', 30) || chr(10) ||
      array_to_string(list_transform(range(1, len(l) + 1, 2), lambda b: 'Chapter ' || (b + 1) // 2 || ' ' || source || ' ..... ' ||
        (case when v = 4 then b + 900 else b end)), chr(10)) || chr(10) || 'Section x   3', body_pages) else body_pages end pages from body),
  pg as (select doc_id, v, unnest(pages) page, generate_subscripts(pages, 1) page_no, len(pages) n_pages from bk),
  ln as (select doc_id, page_no, unnest(string_split(page, chr(10))) raw, generate_subscripts(string_split(page, chr(10)), 1) line_no from pg),
  lt as (select doc_id, page_no, line_no, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') line from ln),
  st as (
    select doc_id, page_no, count(*) filter (line <> '' and (regexp_matches(line, '^(.+?)\s*[\.․…⋯・‥…]{2,}\s*(\d{1,4})\s*$')
        or regexp_matches(line, '^(\S(?:.*\S)?)\s{2,}(\d{1,4})\s*$'))) hits, count(*) filter (line <> '') n,
      coalesce(bool_or(line_no <= 5 and regexp_matches(raw, '(?i)(目次|もくじ|Contents)')), false) word from lt group by 1, 2),
  sp as (
    select doc_id, min(page_no) filter (page_no <= 30 and (word or (hits >= 3 and hits / greatest(n, 1) >= 0.3))) f, max(page_no) n_pages
    from st group by 1),
  toc as (
    select sp.doc_id, f as first_page, coalesce(min(page_no) filter (page_no > f and page_no <= 40 and not (hits >= 3 or hits / greatest(n, 1) >= 0.3)) - 1,
      least(any_value(n_pages), 40)) last_page from sp join st using (doc_id) where f is not null group by 1, 2),
  er as (
    select doc_id, page_no, line_no, case when regexp_matches(line, '^(.+?)\s*[\.․…⋯・‥…]{2,}\s*(\d{1,4})\s*$')
        then regexp_extract(line, '^(.+?)\s*[\.․…⋯・‥…]{2,}\s*(\d{1,4})\s*$', 1) else regexp_extract(line, '^(\S(?:.*\S)?)\s{2,}(\d{1,4})\s*$', 1) end title,
      cast(regexp_extract(line, '(\d{1,4})\s*$', 1) as integer) printed
    from lt join toc using (doc_id) where page_no between first_page and last_page and
      (regexp_matches(line, '^(.+?)\s*[\.․…⋯・‥…]{2,}\s*(\d{1,4})\s*$') or regexp_matches(line, '^(\S(?:.*\S)?)\s{2,}(\d{1,4})\s*$'))),
  en as (
    select doc_id, row_number() over (partition by doc_id order by page_no, line_no) i, regexp_replace(title, '^[ .・‥…]+|[ .・‥…]+$', '', 'g') title, printed,
      regexp_matches(title, '(?i)^(Chapter\s*\d+|Appendix|Index)') is_chapter from er where printed > 0),
  ch as (select *, row_number() over (partition by doc_id order by i) ci, count(*) over (partition by doc_id) cn from en where is_chapter),
  hd as (
    -- titles are ASCII; DuckDB's distance counts bytes, so other characters of a head are one byte each
    select doc_id, page_no, page, n_pages, regexp_replace(regexp_replace(array_to_string(string_split(page, chr(10))[1:6], ''), '\s+', '', 'g'), '[^\x00-\x7F]', '?', 'g') head6,
      regexp_replace(regexp_replace(array_to_string(string_split(page, chr(10))[1:10], ''), '\s+', '', 'g'), '[^\x00-\x7F]', '?', 'g') head10, regexp_replace(left(page, 400), '\s+', '', 'g') top from pg),
  vs as (
    select doc_id, ci, cn, page_no - printed as off, 1 - levenshtein(regexp_replace(title, '\s+', '', 'g'), head6)::double / greatest(length(head6), length(regexp_replace(title, '\s+', '', 'g'))) lev,
      contains(top, regexp_replace(title, '\s+', '', 'g')) inside
    from ch join hd using (doc_id) where ci <= 4 and cn >= 2 and page_no - printed between -5 and 59),
  vb as (
    select doc_id, ci, least(any_value(cn), 4) n, arg_max(off, (case when inside then greatest(lev, 0.9) else lev end) * 1e6 - off) off,
      max(case when inside then greatest(lev, 0.9) else lev end) score from vs group by 1, 2 having score >= 0.55),
  vo as (
    select doc_id, off, agree from (
      select doc_id, off, count(*) agree, any_value(n) n, row_number() over (partition by doc_id order by count(*) desc, off) r from vb group by 1, 2)
    where r = 1 and agree >= greatest(1, n // 2)),
  ts as (
    select doc_id, ci, title, page_no, case when contains(head10, regexp_replace(title, '\s+', '', 'g')) then 0.95
      else 1 - levenshtein(regexp_replace(title, '\s+', '', 'g'), head10)::double / greatest(length(head10), length(regexp_replace(title, '\s+', '', 'g'))) end score
    from ch join hd using (doc_id) where regexp_replace(page, '^\s+|\s+$', '', 'g') <> ''),
  tp as (
    select doc_id, ci, any_value(title) title, coalesce(min(page_no) filter (score >= 0.8), arg_max(page_no, score * 1e6 - page_no)) page_no
    from ts group by 1, 2 having max(score) >= 0.5),
  hw as (
    select doc_id, page_no, line_no, regexp_extract(line, '(?i)^(Chapter\s+\d+|Part\s+\d+|Preface|Introduction|Prologue|Epilogue|Conclusion|Appendix|Index)(\s+|$)', 1) title
    from lt where line_no <= 15 and length(line) >= 2),
  hk as (select *, coalesce(nullif(regexp_extract(lower(title), '^chapter\s+(\d+)$', 1), ''), lower(title)) k from hw where title <> ''),
  hp as (select doc_id, page_no, k, arg_min(title, line_no) title, min(line_no) o from hk group by 1, 2, 3),
  h1 as (
    select doc_id, page_no, arg_min(k, o) k1, arg_min(title, o) t1, (list(k order by o))[2] k2, (list(title order by o))[2] t2,
      row_number() over (partition by doc_id order by page_no) r from hp group by 1, 2),
  hf as (
    select doc_id, r, page_no, k1 as last, t1 as title, true as taken from h1 where r = 1
    union all
    select h1.doc_id, h1.r, h1.page_no, case when k1 <> last then k1 when k2 is not null then k2 else last end,
      case when k1 <> last then t1 else t2 end, k1 <> last or k2 is not null
    from hf join h1 on h1.doc_id = hf.doc_id and h1.r = hf.r + 1),
  hr as (select doc_id, page_no, title from hf where taken),
  bd as (
    select doc_id, title, page_no from (
      select doc_id, title, printed + off as page_no, row_number() over (partition by doc_id, printed + off order by printed, i) r
      from ch join vo using (doc_id) join sp using (doc_id) where printed + off between 1 and n_pages) where r = 1),
  al as (
    select doc_id, 1 as tier, 'contents' as name, title, page_no, page_no as o from bd
    union all select doc_id, 2, 'title_search', title, page_no, page_no * 1000 + ci from tp
    union all select doc_id, 3, 'headings', title, page_no, page_no from hr),
  ok as (select *, count(*) over (partition by doc_id, tier) n from al),
  mt as (select doc_id, min(tier) tier from ok where n >= 2 group by 1),
  us as (select ok.* from ok join mt using (doc_id, tier)),
  bs as (select doc_id, tier, name, title, page_no, o from us union all select doc_id, any_value(tier), any_value(name), '前付け', 1, 0 from us group by 1 having min(page_no) > 1),
  iv as (
    select doc_id, name, title, page_no as start_page, coalesce(lead(page_no) over (partition by doc_id order by o) - 1, n_pages) end_page
    from bs join sp using (doc_id))
"""


def make_books(t):
    """(doc_id, source, pages): see the module text."""
    docs = t.documents.select("doc_id", "source", "text")
    lines = F.split("text", "\n")
    base = once(docs.select("doc_id", "source", "text", (F.col("doc_id") % 5).alias("v")), l=lines)
    number = lambda b: F.floor((b + 1) / 2).cast("string")

    def body_page(line, i):
        b = i + 1
        heading = F.when(
            F.col("v").isin(0, 4) & (b % 2 == 1), F.concat(F.lit("Chapter "), number(b), F.lit(" "), F.col("source"), F.lit("\n"))
        ).when(F.col("v") == 2, F.concat(F.lit("CHAPTER "), number(b), F.lit("\n")))
        return F.concat(F.coalesce(heading, F.lit("")), line)

    rows = F.transform(
        F.sequence(F.lit(1), F.size("l"), F.lit(2)),
        lambda b: F.concat(
            F.lit("Chapter "), number(b), F.lit(" "), F.col("source"), F.lit(" ..... "),
            F.when(F.col("v") == 4, b + 900).otherwise(b).cast("string"),
        ),
    )
    contents = F.concat(F.lit("Contents\n" + "preface words " * 30 + "\n"), F.array_join(rows, "\n"), F.lit("\nSection x   3"))
    body = F.transform("l", body_page)
    pages = F.when(F.col("v").isin(0, 1, 4), F.concat(F.array(contents), body)).otherwise(body)
    return base.select("doc_id", "source", pages.alias("pages"))


def with_entries(t):
    return B.with_contents(B.prepare(make_books(t)))


@query("W7", f"with recursive {BOOKS_SQL} select doc_id, first_page, last_page from toc")
def toc_run(t):
    found = make_books(t).select("doc_id", B.toc_run(F.col("pages")).alias("r")).filter("r is not null")
    return found.select(
        "doc_id", F.col("r.first").cast("long").alias("first_page"), F.col("r.last").cast("long").alias("last_page")
    )


@query("C28 W7", f"with recursive {BOOKS_SQL} select doc_id, i, title, printed as printed_page, is_chapter from en")
def toc_entries(t):
    e = with_entries(t).select("doc_id", F.posexplode("entries").alias("i", "e"))
    return e.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "e.title", "e.printed_page", "e.is_chapter")


@query("J13", f"with recursive {BOOKS_SQL} select doc_id, off as \"offset\", agree from vo")
def vote_offset(t):
    return B.vote_offset(with_entries(t), "doc_id", "entries").withColumn("offset", F.col("offset").cast("long"))


@query("J12", f"with recursive {BOOKS_SQL} select doc_id, title, page_no as page from tp")
def title_page_match(t):
    found = B.title_pages(with_entries(t), "doc_id", "entries")
    return found.select("doc_id", "title", F.col("page").cast("long").alias("page"))


@query("W8", f"with recursive {BOOKS_SQL} select doc_id, title, page_no as page from hr")
def heading_rows(t):
    books = B.prepare(make_books(t)).select("doc_id", F.explode(B.heading_rows(F.col("clean"))).alias("h"))
    return books.select("doc_id", "h.title", F.col("h.page").cast("long").alias("page"))


@query("W6", f"with recursive {BOOKS_SQL} select doc_id, title, page_no as page from bd")
def monotone_starts(t):
    rows = once(with_entries(t), offset=B.offset_in_row(F.col("clean"), F.col("tops"), F.col("entries")))
    placed = rows.filter("offset is not null").select(
        "doc_id", F.explode(B.monotone_starts(F.col("entries"), F.col("offset"), F.col("n_pages"))).alias("b")
    )
    return placed.select("doc_id", "b.title", F.col("b.page").cast("long").alias("page"))


@query(
    "U3",
    f"""
    with recursive {BOOKS_SQL} select sp.doc_id, coalesce(any_value(name), 'equal_chunks') tier, count(us.doc_id) boundaries, coalesce(sum(page_no), 0)::bigint page_sum
    from sp left join us using (doc_id) group by 1
    """,
)
def fallback_tiers(t):
    return C.boundaries_by_tier(make_books(t)).select(
        "doc_id", "tier", F.size("boundaries").cast("long").alias("boundaries"),
        F.aggregate("boundaries", F.lit(0).cast("long"), lambda a, b: a + b["page"]).alias("page_sum"),
    )


@query(
    "U3b",
    f"""
    with recursive {BOOKS_SQL} select sp.doc_id, case when sp.doc_id % 10 < 4 then 'explicit' else coalesce(any_value(name), 'equal_chunks') end tier,
      case when sp.doc_id % 10 < 4 then 2 else count(us.doc_id) end boundaries
    from sp left join us using (doc_id) group by 1
    """,
)
def explicit_boundaries(t):
    given = F.when(
        F.col("doc_id") % 10 < 4,
        F.array(
            F.struct(F.lit("Two").alias("title"), F.lit(2).alias("page")), F.struct(F.lit("One").alias("title"), F.lit(1).alias("page"))
        ),
    )
    books = make_books(t).withColumn("given", given)
    return C.boundaries_by_tier(books, explicit="given").select(
        "doc_id", "tier", F.size("boundaries").cast("long").alias("boundaries")
    )


@query("W5", f"with recursive {BOOKS_SQL} select doc_id, title, start_page, end_page from iv")
def interval_ends(t):
    parts = C.boundaries_by_tier(make_books(t)).select(
        "doc_id", F.explode(B.interval_ends(F.col("boundaries"), F.col("n_pages"))).alias("p")
    )
    return parts.select(
        "doc_id", "p.title", F.col("p.start_page").cast("long").alias("start_page"), F.col("p.end_page").cast("long").alias("end_page")
    )


@query(
    "J14",
    f"""
    with recursive {BOOKS_SQL} select pg.doc_id, pg.page_no as page, iv.title from pg join iv on iv.doc_id = pg.doc_id and pg.page_no between start_page and end_page
    """,
)
def assign_to_interval(t):
    parts = C.boundaries_by_tier(make_books(t)).withColumn("parts", B.interval_ends(F.col("boundaries"), F.col("n_pages")))
    pages = parts.filter(F.size("parts") > 0).select(
        "doc_id", F.explode(
            F.transform(
                B.numbers(1, F.col("n_pages")),
                lambda i: F.struct(i.cast("long").alias("page"), B.part_of_page(F.col("parts"), i)["title"].alias("title")),
            )
        ).alias("x")
    )
    return pages.select("doc_id", "x.page", "x.title")


SIZES_SQL = r"""
  sz as (
    select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) s,
      generate_subscripts(string_split(text, chr(10)), 1) i, len(string_split(text, chr(10))) n from documents),
  tt as (select doc_id, sum(s)::double total, any_value(n)::bigint n from sz group by 1)
"""
CAP = 1000.0


def sized(t):
    """Documents with the byte size of each line as page sizes."""
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", "text").select(
        "doc_id", F.transform(lines, lambda x: F.octet_length(x)).alias("sizes")
    )


def _spans(df, parts):
    e = df.select("doc_id", F.posexplode(parts).alias("k", "p"))
    return e.select(
        "doc_id", (F.col("k") + 1).cast("long").alias("part"), F.col("p.start_page").cast("long").alias("start_page"),
        F.col("p.end_page").cast("long").alias("end_page"),
    )


@query(
    "W10",
    f"""
    with {SIZES_SQL}, k as (select doc_id, n, ceil(n / greatest(1, ceil(total / {CAP})))::bigint c from tt)
    select sz.doc_id, (i - 1) // c + 1 as part, min(i) start_page, max(i) end_page from sz join k using (doc_id) group by 1, 2
    """,
)
def equal_chunks(t):
    books = sized(t)
    return _spans(books, B.equal_chunks(F.size("sizes"), B.array_sum(F.col("sizes")), CAP))


@query(
    "W24",
    f"""
    with {SIZES_SQL}, k as (select doc_id, n, least(greatest(1, doc_id % 7), n) c from tt),
    x as (select sz.doc_id, sz.i, row_number() over (partition by sz.doc_id order by sz.i) - 1 r, k.n // c base, k.n % c extra, c from sz join k using (doc_id)),
    y as (select doc_id, i, case when r < extra * (base + 1) then r // (base + 1) else extra + (r - extra * (base + 1)) // base end + 1 as part from x)
    select doc_id, part, min(i) start_page, max(i) end_page from y group by 1, 2
    """,
)
def even_parts(t):
    return _spans(sized(t), B.even_parts(F.size("sizes"), (F.col("doc_id") % 7).cast("int")))


@query(
    "W25",
    f"""
    with {SIZES_SQL},
    c as (select doc_id, n, total, unnest(range(least(greatest(2, ceil(total / {CAP})::bigint), n), n + 1)) k from tt where total > {CAP}),
    x as (select c.doc_id, k, s, i - 1 as r, c.n // k base, c.n % k extra from c join sz using (doc_id)),
    y as (select doc_id, k, case when r < extra * (base + 1) then r // (base + 1) else extra + (r - extra * (base + 1)) // base end p, sum(s) s from x group by 1, 2, 3),
    z as (select doc_id, k, max(s) m from y group by 1, 2)
    select tt.doc_id, case when total <= {CAP} then 1 else min(k) filter (m <= {CAP}) end parts from tt left join z using (doc_id) group by tt.doc_id, total
    """,
)
def smallest_even_split(t):
    return sized(t).select("doc_id", B.smallest_even_split(F.col("sizes"), CAP).cast("long").alias("parts"))


@query(
    "W23",
    f"""
    with recursive {SIZES_SQL},
    g as (
      select doc_id, i, s, 1::bigint part, s::double used from sz where i = 1
      union all
      select sz.doc_id, sz.i, sz.s, case when used + sz.s > {CAP} then part + 1 else part end, case when used + sz.s > {CAP} then sz.s::double else used + sz.s end
      from g join sz on sz.doc_id = g.doc_id and sz.i = g.i + 1)
    select doc_id, part, min(i) start_page, max(i) end_page from g group by 1, 2
    """,
)
def greedy_pack(t):
    pages = sized(t).select("doc_id", F.posexplode(B.greedy_pack(F.col("sizes"), CAP)).alias("i", "part"))
    return pages.groupBy("doc_id", F.col("part").cast("long").alias("part")).agg(
        (F.min("i") + 1).cast("long").alias("start_page"), (F.max("i") + 1).cast("long").alias("end_page")
    )


@query(
    "W18",
    f"""
    with recursive {SIZES_SQL},
    ps as (select doc_id, i, sum(s) over (partition by doc_id order by i) c from sz),
    b as (
      select doc_id, 'all' title, 1::bigint a, n as z, 0 depth, total as size from tt
      union all
      select b.doc_id, title || '-' || h, case h when 1 then a else (a + z) // 2 + 1 end, case h when 1 then (a + z) // 2 else z end, depth + 1,
        (p2.c - coalesce(p1.c, 0))::double
      from b cross join (values (1), (2)) v(h)
      join ps p2 on p2.doc_id = b.doc_id and p2.i = case h when 1 then (a + z) // 2 else z end
      left join ps p1 on p1.doc_id = b.doc_id and p1.i = case h when 1 then a - 1 else (a + z) // 2 end
      where size > {CAP} and depth < 4 and z - a >= 2)
    select doc_id, title, a as start_page, z as end_page from b where not (size > {CAP} and depth < 4 and z - a >= 2)
    """,
)
def bisect_oversized(t):
    whole = F.array(F.struct(F.lit("all").alias("title"), F.lit(1).alias("start_page"), F.size("sizes").alias("end_page")))
    parts = sized(t).select("doc_id", F.explode(B.bisect_oversized(whole, F.col("sizes"), CAP)).alias("p"))
    return parts.select(
        "doc_id", "p.title", F.col("p.start_page").cast("long").alias("start_page"), F.col("p.end_page").cast("long").alias("end_page")
    )


@query("W19 U3")
def resplit_oversized(t):
    split = C.split_books(make_books(t), CAP)
    e = split.select("doc_id", "tier", F.posexplode("parts").alias("k", "p"))
    return e.select(
        "doc_id", "tier", (F.col("k") + 1).alias("part"), B.part_name(F.col("p"), F.col("k") + 1).alias("name"), "p.start_page", "p.end_page"
    )


@query(
    "J11",
    f"""
    with {SIZES_SQL}, f as (select doc_id, i from sz where i > 1 and i % 7 = 1),
    t as (select doc_id, n, k, 1 + round_even(n * k / 4.0, 0)::bigint target, greatest(5, n // 8) tol from tt, (values (1), (2), (3)) v(k)),
    d as (select t.*, f.i, row_number() over (partition by t.doc_id, k order by abs(f.i - target), f.i) r from t left join f on f.doc_id = t.doc_id)
    select doc_id, k, case when i is not null and abs(i - target) <= tol then i else target end cut from d where r = 1
    """,
)
def nearest_cuts(t):
    """Each target alone: the nearest fine boundary within the tolerance, else the target."""
    books = sized(t).select("doc_id", F.size("sizes").alias("n"))
    fine = F.filter(B.numbers(2, F.col("n")), lambda i: i % 7 == 1)
    rows = books.select("doc_id", "n", fine.alias("fine"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    target = 1 + F.bround(F.col("n") * F.col("k") / 4, 0).cast("int")
    near = F.array_min(F.transform("fine", lambda f: F.struct(F.abs(f - F.col("target")).alias("d"), f.alias("f"))))
    hit = near["d"] <= F.greatest(F.lit(5), F.floor(F.col("n") / 8))
    return rows.withColumn("target", target).select(
        "doc_id", F.col("k"), F.when(hit, near["f"]).otherwise(F.col("target")).cast("long").alias("cut")
    )


@query("J11")
def snap_cuts(t):
    """All targets of a book together: a boundary is used once."""
    books = sized(t).select("doc_id", F.size("sizes").alias("n"))
    fine = F.filter(B.numbers(2, F.col("n")), lambda i: i % 7 == 1)
    cuts = B.snap_cuts(F.lit(1), F.col("n"), F.lit(4), fine)
    return books.select("doc_id", F.explode(cuts).alias("cut"))


@query("S10 U3")
def chapter_report(t):
    from larkspan.sources.documents import report_json

    return report_json(C.report(C.split_books(make_books(t), CAP)), "doc_id")


@query(
    "W9",
    "select conv_id, turn, row_number() over (order by conv_id, turn) as page_no, 0 as part from conversations",
)
def renumber(t):
    from larkspan.plans import ordered

    rows = t.conversations.select("conv_id", "turn")
    return ordered.rank(rows, ["conv_id", "turn"], "page_no").withColumn("part", F.lit(0))


