"""Catalogue joins, aggregates, sorts and set operations."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import dates as D
from larkspan.functions.text import norm_text
from larkspan.operators import catalog as O
from larkspan.operators import filters as FI
from larkspan.plans import ordered
from larkspan.registry import query
from larkspan.session import cut_lineage, work_path
from larkspan.sources import documents as S

CATS_SQL = "case when p_size % 9 = 0 then [] else string_split(p_name, ' ') end"


def items(t):
    none = F.array().cast("array<string>")
    cats = F.when(F.col("p_size") % 9 == 0, none).otherwise(F.split("p_name", " "))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", cats.alias("cats"))


def category_dim(t):
    """All words of the catalogue, with a rank; here the words are the dimension."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("category")).distinct()
    extra = t.spark.range(1).select(F.explode(F.array(F.lit("none"), F.lit("zzz unused"))).alias("category"))
    return words.unionByName(extra)


@query(
    "A1 F1 O7",
    f"""
    with e as (select unnest(case when len(c) = 0 then ['none'] else c end) category from
        (select {CATS_SQL} c from part where contains(p_name || ' ' || p_brand || ' ' || p_type, 'S'))),
    d as (select distinct unnest(string_split(p_name, ' ')) category from part union all select unnest(['none', 'zzz unused']))
    select d.category, coalesce(n, 0) n from d left join (select category, count(*) n from e group by 1) using (category)
    """,
)
def facet_counts(t):
    found = FI.keyword_filter(items(t), "S", [F.col("p_name"), F.col("p_brand"), F.col("p_type")])
    return O.facet_counts(found, "cats", category_dim(t)).select("category", "n")


@query(
    "A1b",
    f"select category, count(*) n from (select unnest({CATS_SQL}) category from part where p_size > 20) group by 1",
)
def facet_counts_found(t):
    return O.facet_counts(items(t).filter("p_size > 20"), "cats", zero=False)


FEEDS_SQL = """
  select c_nationkey k, 0 f, c_custkey o, c_name title, c_mktsegment cat, upper(c_mktsegment) lab from customer
  union all select s_nationkey, 1, s_suppkey, s_name, case when s_suppkey % 3 = 0 then null else 'S' || s_suppkey % 4 end, 'L' || s_suppkey % 5 from supplier
  union all select n_nationkey, 2, n_regionkey, n_name, n_name, n_name from nation
"""


def feeds(t):
    c = t.customer.select(
        F.col("c_nationkey").alias("k"), F.lit(0).alias("f"), F.col("c_custkey").alias("o"), F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("cat"), F.upper("c_mktsegment").alias("lab"),
    )
    key = F.col("s_suppkey")
    s = t.supplier.select(
        F.col("s_nationkey").alias("k"), F.lit(1).alias("f"), key.alias("o"), F.col("s_name").alias("title"),
        F.when(key % 3 != 0, F.concat(F.lit("S"), (key % 4).cast("string"))).alias("cat"),
        F.concat(F.lit("L"), (key % 5).cast("string")).alias("lab"),
    )
    n = t.nation.select(
        F.col("n_nationkey").alias("k"), F.lit(2).alias("f"), F.col("n_regionkey").cast("long").alias("o"),
        F.col("n_name").alias("title"), F.col("n_name").alias("cat"), F.col("n_name").alias("lab"),
    )
    return c.unionByName(s).unionByName(n)


@query(
    "A2",
    f"""
    with r as ({FEEDS_SQL}),
    c as (select k, cat, min(f * 1000000000 + o) m from r where cat is not null group by 1, 2),
    l as (select k, lab, min(f * 1000000000 + o) m from r group by 1, 2)
    select r.k, arg_min(title, f * 1000000000 + o) title, arg_min(cat, f * 1000000000 + o) filter (cat is not null) category,
      (select string_agg(cat, '|' order by m) from c where c.k = r.k) categories,
      (select string_agg(lab, '|' order by m) from l where l.k = r.k) labels,
      (select string_agg('<' || cat || '>', '|' order by m) from c where c.k = r.k) relabelled
    from r group by r.k
    """,
)
def merge_feeds(t):
    r = feeds(t)
    own = O.merge_feeds(r, ["k"], ["f", "o"], ["title"], "cat", "lab")
    relabelled = F.array_join(F.transform("categories", lambda c: F.concat(F.lit("<"), c, F.lit(">"))), "|")
    return own.select(
        "k", "title", "category", F.array_join("categories", "|").alias("categories"),
        F.array_join("labels", "|").alias("labels"), relabelled.alias("relabelled"),
    )


@query(
    "A2",
    f"""
    with r as ({FEEDS_SQL}),
    c as (select k, cat, min(f * 1000000000 + o) m from r where cat is not null group by 1, 2)
    select r.k, (select string_agg(case cat when 'MACHINERY' then 'Maschinen' when 'FURNITURE' then 'Möbel' else '未分類' end, '|' order by m)
       from c where c.k = r.k) labels from r group by r.k
    """,
)
def merge_feeds_relabelled(t):
    lookup = F.create_map(*[F.lit(v) for v in ("MACHINERY", "Maschinen", "FURNITURE", "Möbel")])
    own = O.merge_feeds(feeds(t), ["k"], ["f", "o"], ["title"], "cat", "lab", lookup)
    return own.select("k", F.array_join("labels", "|").alias("labels"))


@query(
    "A3 O8",
    """
    select c_mktsegment as label, case c_mktsegment when 'HOUSEHOLD' then 2 when 'BUILDING' then 0 when 'MACHINERY' then 0 else 1 end band,
      case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 0 end dim_rank, min(c_custkey) first_seen
    from customer group by 1
    """,
)
def ordered_labels(t):
    dim = t.spark.range(1).select(F.posexplode(F.array(F.lit("MACHINERY"), F.lit("BUILDING"))).alias("rank", "label"))
    return O.ordered_labels(t.customer, "c_mktsegment", "c_custkey", dim, "HOUSEHOLD").select(
        "label", "band", "dim_rank", "first_seen"
    ).orderBy("band", "dim_rank", "first_seen")


@query("A4", "select o_custkey, count(*) total, count(*) filter (o_orderstatus = 'F') saved from orders group by 1")
def overview(t):
    return O.overview(t.orders, "o_custkey", F.col("o_orderstatus") == "F")


@query(
    "A14",
    """
    with m as (select o_orderpriority as module, count(*) n, count(*) filter (o_orderstatus <> 'P') cov from orders group by 1)
    select module, n, cov, round(100.0 * cov / n, 6) pct, round(100.0 * (select sum(cov) from m) / (select sum(n) from m), 6) total_pct,
      cov < n and module like '%H%' gated from m
    """,
)
def coverage_rollup(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("module")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "P").alias("cov")
    )
    total = m.agg((F.sum("cov") * 100.0 / F.sum("n")).alias("total_pct"))
    return m.select(
        "module", "n", "cov", F.round(F.col("cov") * 100.0 / F.col("n"), 6).alias("pct"),
        F.round(total.scalar(), 6).alias("total_pct"), ((F.col("cov") < F.col("n")) & F.col("module").contains("H")).alias("gated"),
    )


@query(
    "A16",
    """
    select l_orderkey, arg_min(l_shipdate, (l_linenumber, l_partkey, l_shipdate)) filter (l_returnflag = 'R') shipped from lineitem group by 1
    """,
)
def first_valid_method(t):
    # by number, then part; lines that share both go by their date
    ranked = t.lineitem.select(
        "l_orderkey", "l_returnflag", F.col("l_shipdate").alias("shipped"),
        F.struct("l_linenumber", "l_partkey", "l_shipdate").alias("rank"),
    )
    return O.first_valid(ranked, "l_orderkey", "rank", F.col("l_returnflag") == "R", "shipped")


@query(
    "A13",
    """
    select lang, arg_max(source, n * 1000 - r) variant, max(n) score from (
      select lang, source, cast(substr(source, 4) as integer) r, sum(len(string_split(text, ' ')))::bigint n from documents group by 1, 2) group by lang
    """,
)
def best_variant(t):
    words = t.documents.groupBy("lang", "source").agg(F.sum(F.size(F.split("text", " "))).alias("n"))
    rank = F.substring("source", 4, 10).cast("int")
    return O.best_variant(words, "lang", "source", F.col("n"), rank)


@query(
    "A18 G2",
    """
    with c as (select event_type as relation, case when value < 10 then 'EXTRACTED' when value < 60 then 'INFERRED' else 'AMBIGUOUS' end confidence, value from events)
    select confidence, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 6) pct, round(avg(value), 6) mean_value from c group by 1
    """,
)
def breakdown_pct(t):
    v = F.col("value")
    c = t.events.select(
        F.when(v < 10, "EXTRACTED").when(v < 60, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"), "value"
    )
    g = c.groupBy("confidence").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    whole = g.agg(F.sum("n").alias("total"))
    return g.select(
        "confidence", "n", F.round(F.col("n") * 100.0 / whole.scalar(), 6).alias("pct"), F.round("mean_value", 6).alias("mean_value")
    )


@query(
    "A20",
    """
    select count(*) filter (o_orderstatus = 'F') done, count(*) filter (o_orderstatus = 'P') failed from orders
    where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')
    """,
)
def outcome_counts(t):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed")
    saved = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.outcome_counts(t.orders, saved, ["o_orderkey"], status)


@query(
    "A5 A5b",
    """
    select source as store, sum(n_chars)::bigint size, max(doc_id) newest, sum(n_chars) > 60000 as over from documents group by 1
    """,
)
def store_size(t):
    from larkspan.operators.matching import store_status

    docs = t.documents.select(F.col("source").alias("store"), "n_chars", "doc_id")
    return store_status(docs, ["store"], "n_chars", "doc_id", warn=60000)


# -- joins ---------------------------------------------------------------------------------


@query(
    "J1",
    "select c_custkey, coalesce(n_name, '未分類') as label from customer left join nation on n_nationkey = c_nationkey + case when c_custkey % 5 = 0 then 100 else 0 end",
)
def label_join(t):
    # every fifth customer has a code that is not in the table
    code = F.col("c_nationkey") + F.when(F.col("c_custkey") % 5 == 0, 100).otherwise(0)
    rows = t.customer.select("c_custkey", code.alias("code"))
    return O.label_join(rows, t.nation, "code", "n_nationkey", "n_name").select(
        "c_custkey", "label"
    )


@query(
    "J2",
    """
    with p as (select page_id, url, cast(regexp_extract(url, '/(\\d+)', 1) as bigint) doc_id from pages)
    select page_id, p.doc_id, url, coalesce(d.source, 'stub_' || p.doc_id) title, d.doc_id is not null known
    from p left join documents d on d.doc_id = p.doc_id
    """,
)
def resolve_or_stub(t):
    p = t.pages.select("page_id", F.regexp_extract("url", r"/(\d+)", 1).try_cast("long").alias("doc_id"), "url")
    cat = t.documents.select("doc_id", F.col("source").alias("title"))
    stub = {"title": F.concat(F.lit("stub_"), F.col("doc_id").cast("string"))}
    return O.resolve_or_stub(p, cat, ["doc_id"], stub)


@query(
    "J3",
    """
    select o_orderkey, 'saved' as kind from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and (l_returnflag = 'R' or l_linenumber = 7))
    union all
    select o_orderkey, 'unsaved' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and (l_returnflag = 'R' or l_linenumber = 7))
    """,
)
def saved_keys(t):
    line = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber")
    events = t.orders.select("o_orderkey")
    saved = O.saved_keys(events, line.filter("l_returnflag = 'R'"), line.filter("l_linenumber = 7"), ["o_orderkey"])
    rest = events.join(saved, ["o_orderkey"], "left_anti")
    return saved.withColumn("kind", F.lit("saved")).unionByName(rest.withColumn("kind", F.lit("unsaved")))


# -- sorts ---------------------------------------------------------------------------------


def listed_events(t):
    """Orders as events: text date (every 5th unreadable), time and duration words."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    orders = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice", "o_orderstatus")
    return orders.select(
        key.alias("pos"),
        F.col("o_orderpriority").alias("title"),
        F.when(key % 5 == 0, F.lit("n/a")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("date"),
        F.date_format(d, "yyyy-MM-dd").alias("shown"),
        F.format_string("%02d:00", key % 24).alias("time"),
        D.format_duration((F.floor(F.col("o_totalprice") / 7) - 3000).cast("long")).alias("duration"),
        (F.col("o_orderstatus") == "F").alias("saved"),
    )


def _sort_keys(t, *columns):
    """`pos` and the sort key of each wanted column, a struct."""
    cols = [F.col(c) for c in ("title", "date", "shown", "time", "duration", "saved")]
    keys = {c: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(O.event_sort_keys(c, *cols))]) for c in columns if c != "date"}
    rows = listed_events(t)
    if "date" in columns:
        rows = O.day_sort_keys(rows, "date", "shown", "_day")
        keys["date"] = F.struct("_day", norm_text(F.col("time")).alias("k4"), norm_text(F.col("title")).alias("k5"))
    return rows.select("pos", *[keys[c].alias(c) for c in columns])


LIST_SQL = """
  select o_orderkey as pos, o_orderpriority as title, o_orderkey % 5 <> 0 ok, cast(o_orderdate as date) d,
    lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':00' as tm, greatest(cast(floor(o_totalprice / 7) - 3000 as bigint), 0) dur,
    o_orderstatus = 'F' as saved from orders
"""
DATE_KEYS = "ok {0}, case when ok then d end {0} nulls {1}, tm {0}, title {0}"


@query(
    "O1",
    f"""
    with e as ({LIST_SQL})
    select pos, row_number() over (order by {DATE_KEYS.format('asc', 'first')}, pos) by_date,
      row_number() over (order by {DATE_KEYS.format('desc', 'last')}, pos desc) by_date_desc,
      row_number() over (order by dur, title, pos) by_duration,
      row_number() over (order by saved, title, pos) by_saved, row_number() over (order by title, pos) by_title
    from e
    """,
)
def sort_events(t):
    columns = ("date", "duration", "saved", "title")
    keys = cut_lineage(_sort_keys(t, *columns))
    out = keys.select("pos")
    for c in columns:
        out = out.join(ordered.rank(keys.select("pos", c), [c, "pos"], f"by_{c}").drop(c), "pos")
    total = keys.agg(F.count("*").alias("n")).scalar()
    return out.withColumn("by_date_desc", total + 1 - F.col("by_date"))


@query(
    "O1b",
    f"with e as ({LIST_SQL}) select pos, row_number() over (order by {DATE_KEYS.format('desc', 'last')}, pos) as rank from e",
)
def sort_events_stable(t):
    # descending with ties in the order of the list: the ascending order of the turned list, counted from its end
    keys = cut_lineage(_sort_keys(t, "date").withColumn("turned", -F.col("pos")))
    total = t.orders.agg(F.count("*").alias("n")).scalar()
    return ordered.rank(keys, ["date", "turned"], "up").select("pos", (total + 1 - F.col("up")).alias("rank"))


@query("O2", "select p_partkey, p_name, row_number() over (order by p_name, p_partkey) as rank from part")
def sort_items(t):
    rows = t.part.select("p_partkey", "p_name")
    return ordered.rank(rows, ["p_name", "p_partkey"], "rank")


@query("O3")
def sort_locale(t):
    """Language-aware order of catalogue titles; the order itself is checked in the tests."""
    titles = t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    return titles.orderBy(F.collate("title", "ja"), "page_id")


@query(
    "O4",
    """
    select c_custkey, lower(c_mktsegment) || lpad(cast(length(digits) as varchar), 10, '0') || digits as sort_key from (
      select c_custkey, c_mktsegment, regexp_replace(c_custkey || case when c_custkey % 4 = 0 then '12345678901234567890123' else '' end, '^0+(\\d)', '\\1') as digits from customer)
    """,
)
def natural_sort(t):
    from larkspan.functions.text import natural_key

    # leading zeros, and numbers longer than any fixed width
    zeros, more = F.when(F.col("c_custkey") % 3 == 0, "000").otherwise(""), F.when(F.col("c_custkey") % 4 == 0, "12345678901234567890123").otherwise("")
    label = F.concat("c_mktsegment", zeros, F.col("c_custkey").cast("string"), more)
    return t.customer.select("c_custkey", natural_key(label).alias("sort_key")).orderBy("sort_key", "c_custkey")


@query(
    "O5",
    """
    select p_partkey, case p_brand when 'Brand#1' then -1 when 'Brand#2' then 1 else 0 end band,
      row_number() over (order by case p_brand when 'Brand#1' then -1 when 'Brand#2' then 1 else 0 end, p_partkey) z from part
    """,
)
def z_order(t):
    band = O.z_band(F.col("p_brand"), F.array(F.lit("Brand#1")), F.array(F.lit("Brand#2")))
    rows = t.part.select("p_partkey", band.alias("band"))
    return ordered.rank(rows, ["band", "p_partkey"], "z")


@query("O6", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 25")
def newest_jobs(t):
    return (
        t.orders.filter("o_orderstatus = 'F'")
        .orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
        .limit(25)
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "O9",
    """
    select site || '_' || corner as key, min(nm) as name from (
      select trim(case when n_nationkey % 6 = 0 then ' ' else n_name end) nm, r_name site, cast(n_nationkey % 3 as varchar) corner
      from nation join region on r_regionkey = n_regionkey) where nm <> '' group by 1
    """,
)
def corner_list(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.when(F.col("n_nationkey") % 6 == 0, F.lit("　")).otherwise(F.col("n_name")).alias("name"),
        F.col("r_name").alias("site"), (F.col("n_nationkey") % 3).cast("string").alias("corner"),
    )
    return O.corner_list(rows, "name", "site", "corner").orderBy("name", "key")


# -- set operations ---------------------------------------------------------------------------


@query(
    "U1",
    """
    with r as (select c_nationkey k, 0 f, c_custkey o, c_name nm from customer union all select s_nationkey, 1, s_suppkey, s_name from supplier)
    select k, arg_min(nm, f * 1000000000 + o) nm, min(f) feed_rank from r group by k
    """,
)
def union_first(t):
    c = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("o"), F.col("c_name").alias("nm"))
    s = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), F.col("s_name").alias("nm"))
    return O.union_first([c, s], ["k"], ["o"]).select("k", "nm", "feed_rank")


@query(
    "U2",
    """
    select 'both' as part, doc_id from (select doc_id from labels where quality = 1 intersect select doc_id from labels where toxic = 0)
    union all select 'only detected', doc_id from (select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 0)
    """,
)
def page_sets(t):
    found, truth = t.labels.filter("quality = 1").select("doc_id"), t.labels.filter("toxic = 0").select("doc_id")
    both = found.intersect(truth).select(F.lit("both").alias("part"), "doc_id")
    return both.unionByName(found.subtract(truth).select(F.lit("only detected").alias("part"), "doc_id"))


@query(
    "U4",
    """
    with s as (
      select o_custkey k, 0 r, 'fresh' as source, max(o_orderkey) v from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1998-01-01' group by 1
      union all select o_custkey, 1, 'network', max(o_orderkey) from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' group by 1
      union all select o_custkey, 2, 'stale', max(o_orderkey) from orders where o_orderstatus = 'F' group by 1)
    select c_custkey k, arg_min(v, r) v, coalesce(arg_min(source, r), 'error') as source from customer left join s on s.k = c_custkey group by 1
    """,
)
def freshest(t):
    def tier(rows):
        return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))

    cached = t.orders.filter("o_orderstatus = 'F'")
    sources = {
        "fresh": tier(cached.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))),
        "network": tier(t.orders.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")),
        "stale": tier(cached),
    }
    return O.freshest(sources, ["k"], "v", t.customer.select(F.col("c_custkey").alias("k")))


# -- documents of sources --------------------------------------------------------------------


@query(
    "S1",
    """
    select event_id, event_type = 'error' failed, case when event_type <> 'error' then 0 end pos,
      case when event_type <> 'error' then 'S' || user_id end series, case when event_type <> 'error' then event_type end title
    from events where event_type <> 'view'
    union all
    select event_id, false, 2, 'X', cast(json_extract(props, '$.k') as varchar) from events where event_type = 'click'
    """,
)
def read_feed_rows(t):
    uid = F.col("user_id").cast("string")
    first = F.concat(F.lit('{"series_site_id":"S'), uid, F.lit('","title":"'), "event_type", F.lit('","other":1}'))
    second = F.concat(F.lit(',{"series_site_id":"X","title":"'), F.get_json_object("props", "$.k"), F.lit('"}'))
    doc = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("["), first, F.lit("]")))
        .when(F.col("event_type") == "view", F.lit('{"corners":[]}'))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"corners":['), first, F.lit(",3"), second, F.lit(',"x",null]}')))
        .otherwise(F.concat(F.lit('{"corners":['), first, F.lit("]}")))
    )
    rows = S.parse_feed(t.events.select("event_id", doc.alias("doc")), "doc", "corners")
    return rows.select(
        "event_id", "failed", "pos", F.col("item.series_site_id").alias("series"), F.col("item.title").alias("title")
    )


@query(
    "S2",
    """
    select o_orderkey, case when o_orderkey % 3 = 0 then 1 else 0 end as pos, o_custkey item from orders
    where o_orderkey % 4 in (0, 1) and epoch(timestamp '1998-06-01') - epoch(o_orderdate) <= 86400 * 365
    """,
)
def read_ttl_docs(t):
    k = F.col("o_orderkey")
    stamp = D.epoch_seconds(F.col("o_orderdate")).cast("string")
    doc = F.concat(
        F.lit('{"schema_version":'), F.when(k % 4 == 3, "2").otherwise("1"), F.lit(',"fetched_at":'),
        F.when(k % 4 == 2, F.lit("true")).when(k % 4 == 0, stamp).otherwise(F.concat(stamp, F.lit(".0"))),
        F.lit(',"items":['), F.when(k % 3 == 0, '{"bad":1},').otherwise(""), F.col("o_custkey").cast("string"), F.lit(',"x"]}'),
    )
    now = D.epoch_seconds(F.lit("1998-06-01").cast("timestamp_ntz"))
    return S.read_ttl_docs(t.orders.select("o_orderkey", doc.alias("doc")), "doc", now, 86400 * 365, 1, T.LongType())


@query(
    "S5",
    """
    with e as (select l_orderkey, cast(l_suppkey % 5 as varchar) as key, l_linenumber * 1000000 + l_partkey as rank, l_partkey,
        l_returnflag from lineitem where l_returnflag <> 'N')
    select l_orderkey, key, arg_max('folder' || l_partkey || '/f' || l_partkey || '.mp3', rank) as path from e group by 1, 2
    """,
)
def read_manifests(t):
    p = F.col("l_partkey").cast("string")
    good = F.concat(
        F.lit('{"paths":{"'), (F.col("l_suppkey") % 5).cast("string"), F.lit('":"f'), p, F.lit('.mp3"}}')
    )
    docs = t.lineitem.select(
        "l_orderkey", (F.col("l_linenumber") * F.lit(1000000) + F.col("l_partkey")).alias("rank"),
        F.concat(F.lit("folder"), p).alias("folder"),
        F.when(F.col("l_returnflag") == "N", F.lit("[1]")).otherwise(good).alias("doc"),
    )
    return S.parse_manifests(docs, "doc", ["l_orderkey"], "rank", "folder")


@query(
    "S7",
    r"""
    select doc_id, i - 1 as line_no, length(line) width, md5(line) digest from (
      select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents)
    where regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''
    """,
)
def to_lines(t):
    rows = S.to_lines(t.documents.select("doc_id", "text"), "text")
    return rows.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.length("line").cast("long").alias("width"),
        F.md5(F.col("line").cast("binary")).alias("digest"),
    )


@query("S3", "select page_id, url, 3 as schema_version from pages")
def document_round_trip(t):
    """Documents replaced with a version stamp, read back from the shared folder."""
    path = work_path(t.spark, "documents")
    for version in (2, 3):
        S.write_docs(t.pages.select("page_id", "url"), path, version)
    return t.spark.read.parquet(path)


TERMS_SQL = """
  select distinct p_name || ' "' || p_partkey || '", x' as reading, p_brand || chr(10) || p_type as target, p_size % 2 = 0 as is_enabled from part
"""


def part_terms(t):
    """Terms with quotes, commas and line feeds."""
    k = F.col("p_partkey").cast("string")
    return t.part.select(
        F.concat("p_name", F.lit(' "'), k, F.lit('", x')).alias("reading"),
        F.concat("p_brand", F.lit("\n"), "p_type").alias("target"),
        (F.col("p_size") % 2 == 0).alias("is_enabled"),
    )


@query("S6", TERMS_SQL)
def terms_csv_round_trip(t):
    path = work_path(t.spark, "terms")
    S.write_terms_csv(part_terms(t), path)
    return S.read_terms_csv(t.spark, path)


@query("S6b", TERMS_SQL)
def terms_json_round_trip(t):
    path = work_path(t.spark, "terms")
    S.write_terms_json(part_terms(t), path)
    return S.read_terms_json(t.spark, path)


@query(
    "S8 A7",
    """
    select l_returnflag as engine, count(*) pages, round(avg(l_quantity), 6) mean_s, min(l_quantity) min_s, max(l_quantity) max_s,
      round(quantile_cont(l_quantity, 0.5), 6) p50, round(quantile_cont(l_quantity, 0.95), 6) p95
    from lineitem group by 1
    """,
)
def mean_time(t):
    doc = F.concat(F.lit('{"p'), F.col("l_linenumber").cast("string"), F.lit('":'), F.col("l_quantity").cast("string"), F.lit("}"))
    timings = S.parse_timings(t.lineitem.select(F.col("l_returnflag").alias("engine"), doc.alias("doc")), "doc")
    timings = cut_lineage(timings)
    middle = ordered.quantiles(timings, ["engine"], "seconds", {"p50": 0.5, "p95": 0.95})
    means = timings.groupBy("engine").agg(
        F.count("*").alias("pages"), F.round(F.avg("seconds"), 6).alias("mean_s"), F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"),
    )
    return means.join(middle, "engine", "left").withColumns({p: F.round(p, 6) for p in ("p50", "p95")})


@query(
    "S10",
    """
    select source, '{"documents":' || count(*) || ',"chars":' || sum(n_chars)::bigint || ',"first":{"doc_id":' || min(doc_id) || '}}' report
    from documents group by 1
    """,
)
def report_json(t):
    g = t.documents.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.struct(F.min("doc_id").alias("doc_id")).alias("first")
    )
    return S.report_json(g, "source")


@query(
    "S11",
    """
    with m as (select o_orderpriority as module, count(*) n from orders group by 1)
    select -1 as band, null as module, '| module | rows |' as line union all select 0, null, '|---|---|'
    union all select 1, module, '| ' || module || ' | ' || n || ' |' from m union all select 2, null, '| total | ' || sum(n)::bigint || ' |' from m
    """,
)
def markdown_table(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("module")).agg(F.count("*").alias("n"))
    cells = {"module": F.col("module"), "rows": F.col("n").cast("string")}
    total = {"module": F.lit("total"), "rows": F.sum("n").cast("string")}
    return S.markdown_rows(m, cells, ["module"], total).orderBy("band", "module")
