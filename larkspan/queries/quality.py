"""Quality measures: texts against a truth, and documents seen as rasters."""

from pyspark.sql import functions as F

from larkspan.operators import quality as Q
from larkspan.plans.once import once
from larkspan.queries.scalar_measures import ONE_BYTE_SQL, one_byte
from larkspan.registry import query


@query(
    "J6",
    "select b.item_id, length(b.text) truth_len, length(coalesce(d.text, '')) output_len from benchmark b left join documents d on d.doc_id = b.item_id",
)
def pair_texts(t):
    docs = t.documents.select(F.col("doc_id").alias("item_id"), "text")
    pairs = Q.pair_texts(t.benchmark, docs, "item_id")
    return pairs.select(
        "item_id", F.length("truth").cast("long").alias("truth_len"), F.length("output").cast("long").alias("output_len")
    )


@query(
    "A6 J6",
    f"""
    with p as (
      select c.role, regexp_replace({ONE_BYTE_SQL.format('c.text')}, '\\s+', '', 'g') truth,
        regexp_replace({ONE_BYTE_SQL.format("coalesce(b.text, '')")}, '\\s+', '', 'g') outp
      from conversations c left join benchmark b on b.item_id = c.conv_id)
    select role, sum(levenshtein(outp, truth))::bigint errors, sum(length(truth))::bigint total, round(sum(levenshtein(outp, truth)) / sum(length(truth)), 6) cer
    from p group by 1
    """,
)
def cer(t):
    # the output has boilerplate lines and full-width digits, which the truth has not
    raw = F.concat(F.lit("Kindle\n"), F.translate("text", "0123456789", "０１２３４５６７８９"), F.lit("\n 42% "))
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    truth = turns.select(F.col("conv_id").alias("item_id"), "role", one_byte(Q.comparable(F.col("text"))).alias("text"))
    output = t.benchmark.select("item_id", one_byte(Q.comparable(raw)).alias("text"))
    pairs = Q.pair_texts(truth, output, "item_id")
    return Q.error_rate(pairs, ["role"]).withColumn("cer", F.round("cer", 6))


@query(
    "A6 A7 A8 A9",
    f"""
    with p as (
      select c.role, c.turn, c.text, regexp_replace({ONE_BYTE_SQL.format('c.text')}, '\\s+', '', 'g') truth,
        regexp_replace({ONE_BYTE_SQL.format("coalesce(b.text, '')")}, '\\s+', '', 'g') outp, b.text is not null found
      from conversations c left join benchmark b on b.item_id = c.conv_id)
    select role as engine, count(*) pages, round(sum(levenshtein(outp, truth)) / sum(length(truth)), 6) cer,
      sum(len(regexp_extract_all(text, '[ \\t]+')))::bigint blanks, count(*) filter (found) hits, round(avg(turn + 0.5), 6) mean_s
    from p group by 1
    """,
)
def engine_comparison(t):
    """Error rate, blanks, pages with an output and mean time of every engine, from one join and one aggregate."""
    turns = t.conversations.select(F.col("conv_id").alias("item_id"), "turn", F.col("role").alias("engine"), "text")
    output = t.benchmark.select("item_id", F.col("text").alias("output"))
    rows = turns.join(output, "item_id", "left")
    truth, out = one_byte(Q.comparable(F.col("text"))), one_byte(Q.comparable(F.col("output")))
    return rows.groupBy("engine").agg(
        F.count("*").alias("pages"),
        F.round(F.sum(F.levenshtein(out, truth)) / F.sum(F.length(truth)), 6).alias("cer"),
        F.sum(F.regexp_count("text", F.lit("[ \\t]+"))).cast("long").alias("blanks"),
        F.count("output").alias("hits"),
        F.round(F.avg(F.col("turn") + 0.5), 6).alias("mean_s"),
    )


@query(
    "A8",
    """
    with d as (select d.lang engine, l.* from labels l join documents d using (doc_id))
    select engine, count(*) filter (quality = 1 and toxic = 0) hits, count(*) filter (toxic = 0) expected, count(*) filter (quality = 1 and toxic = 1) false_hits
    from d where quality = 1 or toxic = 0 group by 1
    """,
)
def hit_metrics(t):
    rows = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("engine")), "doc_id")
    return Q.hit_metrics(rows.filter("quality = 1"), rows.filter("toxic = 0"), "engine", "doc_id")


@query(
    "A9",
    r"""
    with w as (select doc_id, string_split_regex(text, '[ \t　]+') w from documents),
    p as (select doc_id, unnest(w[1:len(w) - 1]) a, unnest(w[2:len(w)]) b from w)
    select w.doc_id, coalesce(n, 0) n from w left join (
      select doc_id, count(*) n from p where regexp_matches(right(a, 1), '^[a-z]$') and regexp_matches(left(b, 1), '^[a-z]$') group by 1) using (doc_id)
    """,
)
def spurious_spaces(t):
    return t.documents.select("doc_id", Q.spurious_spaces(F.col("text"), "[a-z]").cast("long").alias("n"))


@query(
    "A11",
    "select round(avg(toxic), 6) as share, avg(toxic) <= 0.25 passed from labels",
)
def failure_gate(t):
    return Q.failure_gate(t.labels, F.col("toxic") == 1).withColumn("share", F.round("share", 6))


@query(
    "A12",
    """
    select source, count(*) total, count(*) filter (not (n_chars < 300 or contains(text, '|') or not contains(text, chr(10)))) ok,
      count(*) filter (n_chars < 300) short, count(*) filter (contains(text, '|')) cells, count(*) filter (not contains(text, chr(10))) one_line
    from documents group by 1
    """,
)
def qc_summary(t):
    flags = {
        "short": F.col("n_chars") < 300,
        "cells": F.col("text").contains("|"),
        "one_line": ~F.col("text").contains("\n"),
    }
    return Q.qc_summary(t.documents, ["source"], flags)


RASTER_SQL = r"""
  pg as (select doc_id, string_split(text, chr(10)) l from documents),
  dm as (select doc_id, l, len(l)::bigint h, list_max(list_transform(l, lambda s: length(s)))::bigint w from pg)
"""


def rasters(t):
    docs = t.documents.select("doc_id", "text")
    lines = once(docs, l=F.split("text", "\n")).select("doc_id", "l")
    return once(lines, w=Q.width_of(F.col("l")))


@query(
    "A10",
    rf"""
    with {RASTER_SQL},
    m as (select *, least(greatest(10, h * 2 // 100), h) mh, least(greatest(10, w * 2 // 100), w) mw from dm),
    i as (select *, list_sum(list_transform(l, lambda s: length(replace(s, ' ', '')))) page,
      list_sum(list_transform(l[1:mh], lambda s: length(replace(s, ' ', '')))) top, list_sum(list_transform(l[h - mh + 1:h], lambda s: length(replace(s, ' ', '')))) bottom,
      list_sum(list_transform(l, lambda s: length(replace(substr(s, 1, mw), ' ', '')))) lft, list_sum(list_transform(l, lambda s: length(replace(substr(s, w - mw + 1, mw), ' ', '')))) rgt from m)
    select doc_id, round(page / (w * h), 6) page, round(top / (w * mh), 6) top, round(bottom / (w * mh), 6) bottom, round(lft / (mw * h), 6) "left", round(rgt / (mw * h), 6) "right"
    from i
    """,
)
def region_density(t):
    d = once(rasters(t), d=Q.region_density(F.col("l")))
    return d.select("doc_id", *[F.round(F.col("d")[n], 6).alias(n) for n in ("page", "top", "bottom", "left", "right")])


@query(
    "A10 A12",
    rf"""
    with {RASTER_SQL},
    m as (select *, least(greatest(10, h * 2 // 100), h) mh, least(greatest(10, w * 2 // 100), w) mw from dm),
    i as (select doc_id, list_sum(list_transform(l, lambda s: length(replace(s, ' ', '')))) / (w * h) page,
      list_sum(list_transform(l[1:mh], lambda s: length(replace(s, ' ', '')))) / (w * mh) top, list_sum(list_transform(l[h - mh + 1:h], lambda s: length(replace(s, ' ', '')))) / (w * mh) bottom,
      list_sum(list_transform(l, lambda s: length(replace(substr(s, 1, mw), ' ', '')))) / (mw * h) lft,
      list_sum(list_transform(l, lambda s: length(replace(substr(s, w - mw + 1, mw), ' ', '')))) / (mw * h) rgt from m)
    select doc_id, array_to_string(list_filter([case when top > greatest(0.1, page * 0.5) then 'top' end, case when bottom > greatest(0.1, page * 0.5) then 'bottom' end,
      case when lft > greatest(0.1, page * 0.5) then 'left' end, case when rgt > greatest(0.1, page * 0.5) then 'right' end], lambda x: x is not null), ',') clipped
    from i
    """,
)
def clipped_sides(t):
    d = once(rasters(t), d=Q.region_density(F.col("l")))
    return d.select("doc_id", F.array_join(Q.clipped_sides(F.col("d")), ",").alias("clipped"))


@query(
    "A10b",
    rf"""
    with {RASTER_SQL}, u as (select doc_id, w, h, unnest(l) s, generate_subscripts(l, 1) - 1 y from dm),
    k as (select doc_id, min(length(s) - length(ltrim(s, ' '))) x0, min(y) y0, max(length(rtrim(s, ' ')) - 1) x1, max(y) y1 from u where replace(s, ' ', '') <> '' group by 1)
    select dm.doc_id, coalesce(x0, 0) x0, coalesce(y0, 0) y0, coalesce(x1, w - 1) x1, coalesce(y1, h - 1) y1 from dm left join k using (doc_id)
    """,
)
def content_bbox(t):
    b = once(rasters(t), b=Q.content_bbox(F.col("l")))
    return b.select("doc_id", *[F.col("b")[n].cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")])


BAND_SQL = rf"""
  {RASTER_SQL},
  bd as (select doc_id, l, h, w, floor(w * 0.4)::bigint a, floor(w * 0.6)::bigint b from dm),
  li as (select doc_id, unnest(l) s from dm),
  co as (select doc_id, w, h, a, b, unnest(range(greatest(a - greatest(w // 80, 1), 0), least(b + greatest(w // 80, 1), w))) x from bd),
  pr as (select co.doc_id, any_value(w) w, any_value(a) a, any_value(b) b, x, count(*) filter (substr(s, x + 1, 1) not in ('', ' ')) ink
    from co join li on li.doc_id = co.doc_id group by 1, x)
"""


@query(
    "W13",
    rf"""
    with {BAND_SQL},
    z as (select doc_id, w, x, x - row_number() over (partition by doc_id order by x) g from pr where ink = 0 and x >= a and x < b),
    r as (select doc_id, any_value(w) w, min(x) s, count(*) n from z group by doc_id, g),
    c as (select doc_id, s + n // 2 m, abs(s + n // 2 - w // 2) d from r where n >= greatest(w * 2 // 100, 1) and n <= w * 8 // 100)
    select dm.doc_id, arg_min(m, d * 1000000 + m) seam from dm left join c using (doc_id) group by 1
    """,
)
def gap_nearest_centre(t):
    r = rasters(t)
    a, b = Q.seam_band(F.col("w"))
    p = once(r, a=a, p=Q.column_profile(F.col("l"), a, b - a))
    seam = Q.gap_nearest_centre(F.col("p"), F.col("a"), F.col("w"))
    return p.select("doc_id", seam.cast("long").alias("seam"))


@query(
    "W16",
    rf"""
    with {BAND_SQL},
    s as (select doc_id, w, a, b, x, sum(ink) over v / count(*) over v as sm from pr
      window v as (partition by doc_id order by x rows between 80 preceding and 80 following)),
    k as (select p.doc_id, any_value(p.w) w, p.x, sum(q.ink) / count(*) sm from pr p join pr q on q.doc_id = p.doc_id
        and q.x between p.x - greatest(p.w // 80, 1) and p.x + greatest(p.w // 80, 1) where p.x >= p.a and p.x < p.b group by 1, 3),
    f as (select doc_id, x, sm + ((x - w / 2) / (w / 4)) * ((x - w / 2) / (w / 4)) * 1000.0::double score from k),
    o as (select doc_id, x, row_number() over (partition by doc_id order by score, x) r from f)
    select doc_id, x as seam from o where r = 1
    """,
)
def smoothed_argmin(t):
    r = rasters(t)
    a, b = Q.seam_band(F.col("w"))
    r = once(r, a=a, b=b, k=F.greatest(F.floor(F.col("w") / 80).cast("int"), F.lit(1)))
    first = F.greatest(F.col("a") - F.col("k"), F.lit(0))
    last = F.least(F.col("b") + F.col("k"), F.col("w"))
    p = once(r, first=first, p=Q.column_profile(F.col("l"), first, last - first))
    seam = Q.smoothed_argmin(F.col("p"), F.col("first"), F.col("w"), F.col("a"), F.col("b"), F.col("k"))
    return p.select("doc_id", seam.cast("long").alias("seam")).filter("seam is not null")


@query(
    "W17",
    rf"""
    with {RASTER_SQL}, i as (
      select doc_id, list_sum(list_transform(l, lambda s: length(replace(substr(s, 1, floor(w * 0.4)::bigint), ' ', '')))) lft,
        list_sum(list_transform(l, lambda s: length(replace(substr(s, floor(w * 0.6)::bigint + 1), ' ', '')))) rgt from dm)
    select doc_id, case when rgt > lft * 1.2 then 'right_first' else 'left_first' end page_order from i
    """,
)
def page_order_default(t):
    w, lines = F.col("w"), F.col("l")
    left = Q.band_ink(lines, F.lit(0), F.floor(w * 0.4).cast("int"))
    start = F.floor(w * 0.6).cast("int")
    return rasters(t).select("doc_id", Q.page_order(left, Q.band_ink(lines, start, w - start)).alias("page_order"))


@query(
    "W20",
    rf"""
    with {RASTER_SQL}, i as (
      select doc_id, h, floor(w * 0.35)::bigint - floor(w * 0.05)::bigint n, floor(w * 0.95)::bigint - floor(w * 0.65)::bigint m,
        list_sum(list_transform(l, lambda s: length(replace(substr(s, floor(w * 0.05)::bigint + 1, floor(w * 0.35)::bigint - floor(w * 0.05)::bigint), ' ', '')))) lft,
        list_sum(list_transform(l, lambda s: length(replace(substr(s, floor(w * 0.65)::bigint + 1, floor(w * 0.95)::bigint - floor(w * 0.65)::bigint), ' ', '')))) rgt from dm),
    d as (select doc_id, coalesce(lft / nullif(n * h, 0), 0) a, coalesce(rgt / nullif(m * h, 0), 0) b from i)
    select doc_id, case when b < 0.008 and a > b * 5 and a > 0.003 then 'right' when a < 0.008 and b > a * 5 and b > 0.003 then 'left' end blank from d
    """,
)
def blank_side(t):
    w, lines = F.col("w"), F.col("l")
    sides = once(rasters(t), a=Q.side_density(lines, w, 0.05, 0.35), b=Q.side_density(lines, w, 0.65, 0.95))
    return sides.select("doc_id", Q.blank_side(F.col("a"), F.col("b")).alias("blank"))


@query(
    "A19",
    """
    with e as (select p_brand, p_retailprice x, p_size * 2.0 y, case when p_size % 5 = 0 then null when p_size % 7 = 0 then 0 else p_size * 1.5 end w, p_size * 1.0 h from part)
    select p_brand, min(x) min_x, min(y)::double min_y, max(x + coalesce(nullif(w, 0), 100)) max_x, max(y + coalesce(nullif(h, 0), 50))::double max_y,
      floor(max(y + coalesce(nullif(h, 0), 50)) + 60.5)::double next_y, floor(max(x + coalesce(nullif(w, 0), 100)) + 80.5)::double next_x
    from e group by 1
    """,
)
def bounds(t):
    size = F.col("p_size").cast("double")
    w = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 7 == 0, F.lit(0.0)).otherwise(size * 1.5)
    return Q.bounds(t.part, ["p_brand"], F.col("p_retailprice"), size * 2, w, size)
