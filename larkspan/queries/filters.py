"""Filter operators over catalogue-like tables."""

from pyspark.sql import functions as F

from larkspan.functions import urls as L
from larkspan.operators import filters as O
from larkspan.registry import query


@query("F1", "select p_partkey, p_name from part where contains(p_name || ' ' || p_brand || ' ' || p_type, 'red widget Brand#1')")
def keyword_filter_items(t):
    rows = O.keyword_filter(t.part, " red widget　Brand#1", [F.col("p_name"), F.col("p_brand"), F.col("p_type")])
    return rows.select("p_partkey", "p_name")


@query(
    "F2",
    "select doc_id, source from documents where contains(lang || ' ' || text || ' ' || source, 'the thnt')",
)
def keyword_filter_events(t):
    rows = O.keyword_filter(t.documents, "the thnt　", [F.col("lang"), F.col("text"), F.col("source")])
    return rows.select("doc_id", "source")


@query("F3", "select doc_id from documents where contains(replace(lower(text || ' ' || source || ' ' || lang), 'ß', 'ss'), 'the thnt')")
def search_filter_items(t):
    return O.search_filter(t.documents, "  ＴＨＥ thnt ", [F.col("text"), F.col("source")], F.array("lang")).select("doc_id")


@query(
    "F3b",
    "select event_id from events where contains(lower(event_type || ' ' || strftime(ts, '%Y%m%d') || ' ' || props), 'purchase 20240115')",
)
def search_filter_events(t):
    day = F.date_format("ts", "yyyyMMdd")
    return O.search_filter(t.events, "Purchase 20240115", [F.col("event_type"), day, F.col("props")]).select("event_id")


@query("F3c", "select p_partkey, p_name from part where contains(lower(p_name), 'blue b')")
def title_filter(t):
    return O.title_filter(t.part, "BLUE B", F.col("p_name")).select("p_partkey", "p_name")


@query(
    "F4",
    """
    select c_custkey from customer where coalesce(nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, ''),
      case when c_nationkey < 10 then 'MACHINERY' else 'OTHER' end) = 'MACHINERY'
    """,
)
def label_filter(t):
    label = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    known = F.when(F.col("c_nationkey") < 10, F.lit("MACHINERY")).otherwise(F.lit("OTHER"))
    return O.label_filter(t.customer, "MACHINERY", label, known).select("c_custkey")


@query(
    "F5 F5b",
    """
    with p as (select p_partkey, case when p_size % 9 = 0 then [] else string_split(p_name, ' ') end cats,
      case when p_size % 9 = 0 then 'none' else p_brand end public from part)
    select p_partkey, 'red' wanted, public from p where list_contains(cats, 'red')
    union all select p_partkey, 'none', public from p where len(cats) = 0
    """,
)
def category_filter(t):
    none = F.array().cast("array<string>")
    cats = F.when(F.col("p_size") % 9 == 0, none).otherwise(F.split("p_name", " "))
    internal = F.when(F.col("p_size") % 9 == 0, F.lit("")).otherwise(F.col("p_brand"))
    p = t.part.select("p_partkey", cats.alias("cats"), O.public_category(internal).alias("public"))

    def pick(wanted):
        return O.category_filter(p, wanted, F.col("cats")).select("p_partkey", F.lit(wanted).alias("wanted"), "public")

    return pick("red").unionByName(pick("none"))


@query(
    "F6",
    """
    select o_orderkey, 'saved' mode from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
    union all
    select o_orderkey, 'unsaved' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
    """,
)
def saved_filter(t):
    saved = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = t.orders.select("o_orderkey")
    yes = O.saved_filter(orders, saved, ["o_orderkey"], saved_only=True, unsaved_only=True)
    no = O.saved_filter(orders, saved, ["o_orderkey"], unsaved_only=True)
    return yes.withColumn("mode", F.lit("saved")).unionByName(no.withColumn("mode", F.lit("unsaved")))


@query("F6b", "select o_orderkey from orders where coalesce(nullif(o_orderstatus, 'O'), 'pending') = 'pending'")
def status_filter(t):
    return O.status_filter(t.orders, "pending", F.nullif(F.col("o_orderstatus"), F.lit("O"))).select("o_orderkey")


@query(
    "F7",
    """
    select page_id, url from pages where regexp_matches(url, '^https?://(spam-farm\\.example\\.org|www\\.cheap-pills\\.example\\.com)([/?#:]|$)')
    """,
)
def url_allowed(t):
    hosts = ["spam-farm.example.org", "www.cheap-pills.example.com"]
    return t.pages.filter(L.url_allowed(F.col("url"), hosts)).select("page_id", "url")


def address_urls(t):
    """The page URLs, and URLs whose host is an address or a local name made from the page id."""
    k = F.col("page_id")
    made = F.when(
        k % 3 == 0, F.format_string("https://%d.%d.0.1/x", k % 256, k % 300 % 256)
    ).when(k % 3 == 1, F.format_string("http://172.%d.9.9:80/", k % 40)).otherwise(
        F.concat(
            F.lit("http://"),
            F.element_at(
                F.array(*[F.lit(h) for h in HOSTS]), (k % len(HOSTS) + 1).cast("int")
            ),
            F.lit("/"),
        )
    )
    return t.pages.select("page_id", F.col("url")).unionByName(t.pages.select("page_id", made.alias("url")))


HOSTS = ["localhost", "a.local", "[::1]", "[fd00::2]", "[::ffff:7f00:1]", "[::ffff:808:808]", "fdn.example.org", "192.168.3.4", "169.254.9.9",
    "127.1", "2130706433", "0x7f.0.0.1", "0177.0.0.1", "[0:0:0:0:0:0:0:1]", "[::ffff:127.0.0.1]", "[::ffff:8.8.8.8]", "134744072", "8.8.2056",
]
HOST_LIST = ", ".join(f"'{h}'" for h in HOSTS)


@query(
    "F8",
    f"""
    with m as (
      select page_id, url from pages union all
      select page_id, case when page_id % 3 = 0 then 'https://' || page_id % 256 || '.' || page_id % 300 % 256 || '.0.1/x'
        when page_id % 3 = 1 then 'http://172.' || page_id % 40 || '.9.9:80/' else 'http://' || ([{HOST_LIST}])[page_id % 18 + 1] || '/' end from pages),
    h as (select page_id, url, lower(regexp_extract(url, '^https?://(\\[[^\\]]*\\]|[^/?#:]+)', 1)) host from m),
    o as (select *, try_cast(regexp_extract(host, '^(\\d+)\\.(\\d+)\\.(\\d+)\\.(\\d+)$', 1) as int) a,
        try_cast(regexp_extract(host, '^(\\d+)\\.(\\d+)\\.(\\d+)\\.(\\d+)$', 2) as int) b from h)
    select page_id, url from o where not (host in ('localhost', '[::1]', '[fd00::2]', '[::ffff:7f00:1]', '127.1', '2130706433', '0x7f.0.0.1', '0177.0.0.1', '[0:0:0:0:0:0:0:1]', '[::ffff:127.0.0.1]') or host like '%.local'
      or coalesce(a in (0, 10, 127) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254), false))
    """,
)
def url_is_public(t):
    return address_urls(t).filter(L.url_is_public(F.col("url")))


@query(
    "F9",
    """
    select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') page_no, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') ref
    from pages where regexp_matches(url, '[?&]page=')
    """,
)
def extract_key(t):
    url = F.col("url")
    return t.pages.select("page_id", L.query_value(url, "page").alias("page_no"), L.query_value(url, "ref").alias("ref")).filter(
        "page_no is not null"
    )


@query(
    "F10",
    """
    with p as (select page_id, regexp_extract(url, '/([a-z]{2})/', 1) lang, page_id % 4 k from pages)
    select page_id, case k when 0 then '/store/' || lang || '/a' when 1 then '/store/b' when 2 then '/storehouse/c' else '/' || lang end path,
      k in (0, 1) inside
    from p
    """,
)
def path_within(t):
    lang, k = F.regexp_extract("url", "/([a-z]{2})/", 1), F.col("page_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("/store/./"), lang, F.lit("//a/")))
        .when(k == 1, F.concat(F.lit("/store/"), lang, F.lit("/../b")))
        .when(k == 2, F.lit("/store/../storehouse/c"))
        .otherwise(F.concat(F.lit("/store/../../../"), lang))
    )
    return t.pages.select("page_id", L.normal_path(raw).alias("path"), L.path_within(raw, "/store/").alias("inside"))


NAME_SQL = """
  select p_partkey, case p_size % 7 when 0 then p_name || '.MP3' when 1 then p_name || '.mp3.part-Frag3' when 2 then '.downloaded.json'
    when 3 then p_name || '.m4a.bak' when 4 then p_name || '.ytdl' when 5 then p_name || '.mp4' else p_name end as name from part
"""


def file_names(part):
    k, name = F.col("p_size") % 7, F.col("p_name")
    made = F.lit(".downloaded.json")
    for i, tail in ((0, ".MP3"), (1, ".mp3.part-Frag3"), (3, ".m4a.bak"), (4, ".ytdl"), (5, ".mp4"), (6, "")):
        made = F.when(k == i, F.concat(name, F.lit(tail))).otherwise(made)
    return part.select("p_partkey", made.alias("name"))


@query(
    "F11",
    f"""
    select p_partkey, case when name = '.downloaded.json' then 'manifest' when contains(name, '.part') or name like '%.ytdl' then 'temp'
      when name like '%.bak' or name like '%.old' then 'backup' when lower(name) like '%.mp3' then 'media' else 'other' end audio,
      case when name = '.downloaded.json' then 'manifest' when contains(name, '.part') or name like '%.ytdl' then 'temp'
      when name like '%.bak' or name like '%.old' then 'backup' when lower(name) like '%.mp3' or name like '%.mp4' then 'media' else 'other' end any_media
    from ({NAME_SQL})
    """,
)
def classify_file(t):
    name = F.col("name")
    return file_names(t.part).select(
        "p_partkey", O.classify_file(name, backups=(".bak", ".old")).alias("audio"), O.classify_file(name, audio_only=False, backups=(".bak", ".old")).alias("any_media")
    )


@query("F12", "select c_custkey, c_name from customer where c_custkey = 77")
def lookup(t):
    return O.lookup(t.customer, c_custkey=77).select("c_custkey", "c_name")


@query(
    "F13",
    """
    select p_partkey, case when p_size % 4 = 0 then 'P' || p_partkey else p_brand end site_id,
      case when p_size % 3 = 0 then '01' else p_type end sub_id,
      case when p_size % 5 = 0 then case when p_size % 2 = 0 then (case when p_size % 4 = 0 then 'P' || p_partkey else p_brand end) || '_' ||
        (case when p_size % 3 = 0 then '01' else p_type end) else p_type end else p_name end title
    from part
    """,
)
def normalise_raw(t):
    size = F.col("p_size")
    cols = O.normalise_raw(
        F.when(size % 4 == 0, F.lit("")).otherwise(F.col("p_brand")),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")),
        F.when(size % 3 != 0, F.col("p_type")),
        F.when(size % 5 != 0, F.col("p_name")),
        F.when(size % 2 == 0, F.lit(" ")).otherwise(F.col("p_type")),
    )
    return t.part.select("p_partkey", *[c.alias(n) for n, c in cols.items()])


@query(
    "F14",
    """
    with l as (select doc_id, unnest(string_split(x, chr(10))) line, generate_subscripts(string_split(x, chr(10)), 1) i
      from (select doc_id, 'Kindle' || chr(10) || text || chr(10) || ' 42% ' x from documents))
    select doc_id, md5(string_agg(line, chr(10) order by i)) digest from l
    where not regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^(Kindle|\\d+%)$') group by doc_id
    """,
)
def drop_boilerplate_lines(t):
    text = F.concat(F.lit("Kindle\n"), "text", F.lit("\n 42% "))
    return t.documents.select("doc_id", F.md5(O.drop_lines(text).cast("binary")).alias("digest"))


@query(
    "F15",
    """
    with a as (select n_nationkey, case n_nationkey % 3 when 0 then 'a' when 1 then '3, 1,x,99,3' else '' || n_nationkey end answer, n_regionkey + 3 n from nation),
    e as (select n_nationkey, n, unnest(case when answer = 'a' then range(1, n + 1) else list_distinct(list_transform(string_split(answer, ','), lambda p: try_cast(trim(p) as bigint))) end) pick from a)
    select n_nationkey, pick from e where pick between 1 and n
    """,
)
def parse_selection(t):
    k = F.col("n_nationkey")
    answer = F.when(k % 3 == 0, F.lit("a")).when(k % 3 == 1, F.lit("3, 1,x,99,3")).otherwise(k.cast("string"))
    picks = t.nation.select("n_nationkey", F.explode(O.selection(answer, F.col("n_regionkey") + 3)).alias("pick"))
    return picks.select("n_nationkey", F.col("pick").cast("long").alias("pick"))


@query(
    "F16",
    """
    select p_partkey, case when contains(i, '#') or contains(i, ' ') then '' else i end safe_id,
      case when p_size % 2 = 0 then 'http://x/' || p_partkey when contains(i, '#') or contains(i, ' ') then '' else 'http://item/' || i end link
    from (select *, case p_size % 3 when 0 then p_brand when 1 then p_type else p_name end i from part)
    """,
)
def valid_id(t):
    k = F.col("p_size")
    item = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.col("p_type")).otherwise(F.col("p_name"))
    url = F.when(k % 2 == 0, F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))).otherwise(F.lit(""))
    return t.part.select("p_partkey", O.valid_id(item).alias("safe_id"), O.safe_or(url, item, "http://item/").alias("link"))


@query(
    "F17",
    r"""
    select page_id, pos, url from (
      select page_id, unnest(u) url, generate_subscripts(u, 1) - 1 pos from (
        select page_id, regexp_extract_all(html || ' see ' || url || '.PNG?v=1 and (' || url || '/a.jpeg) ' || url,
          '(?i)https?://[^\s"''<>)]+\.(?:webp|png|jpe?g|gif|svg)(?:\?[^\s"''<>]*)?') u from pages))
    """,
)
def extract_urls(t):
    text = F.concat("html", F.lit(" see "), "url", F.lit(".PNG?v=1 and ("), "url", F.lit("/a.jpeg) "), "url")
    return t.pages.select("page_id", F.posexplode(L.image_urls(text)).alias("pos", "url")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "url"
    )
