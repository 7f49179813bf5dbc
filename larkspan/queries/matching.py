"""File matching, retention and clean-up plans."""

from pyspark.sql import functions as F

from larkspan.functions import dates as D
from larkspan.operators import matching as M
from larkspan.plans.once import once
from larkspan.registry import query

# Orders are events of a customer's folder; line items are stored files of an order.
FILES_SQL = """
  select o_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity q,
    case l_linenumber % 4 when 0 then strftime(o_orderdate, '%Y%m%d') when 1 then strftime(o_orderdate + interval 1 day, '%Y%m%d')
      when 2 then strftime(o_orderdate - interval 1 day, '%Y%m%d') else 'x' end
    || '_item ' || cast(o_custkey as varchar) || '_' || o_orderpriority ||
      case when l_suppkey % 6 = 0 then ' extra' else '' end || case l_suppkey % 3 when 0 then '.mp3' when 1 then '.m4a' else '.mp4.part' end as name
  from lineitem join orders on o_orderkey = l_orderkey
"""


def stored_files(t):
    d, n, s = F.col("o_orderdate"), F.col("l_linenumber"), F.col("l_suppkey")
    day = lambda shift: F.date_format(d + F.expr(f"interval '{shift}' day"), "yyyyMMdd")
    date = F.when(n % 4 == 0, day(0)).when(n % 4 == 1, day(1)).when(n % 4 == 2, day(-1)).otherwise(F.lit("x"))
    name = F.concat(
        date, F.lit("_item "), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderpriority",
        F.when(s % 6 == 0, " extra").otherwise(""), F.when(s % 3 == 0, ".mp3").when(s % 3 == 1, ".m4a").otherwise(".mp4.part"),
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    made = once(joined, name=name, path=F.format_string("%d/%d/%d/%d", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return made.select(F.col("o_custkey").alias("dir"), "path", "name", F.col("l_quantity").alias("mtime"))


def stored_events(t):
    d = F.col("o_orderdate")
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    shown = D.format_day(F.to_date(d + F.expr("interval '1' day")))
    made = once(
        orders,
        item_titles=F.array(F.concat(F.lit("item "), F.col("o_custkey").cast("string"))),
        dates=M.two_dates(F.date_format(d, "yyyyMMdd"), shown),
    )
    return made.select(
        F.col("o_custkey").alias("dir"), F.col("o_orderkey").alias("event_key"), "item_titles",
        F.col("o_orderpriority").alias("title"), "dates",
    )


MATCH_SQL = f"""
  with f as ({FILES_SQL})
  select o.o_orderkey event_key, f.o_orderkey || '/' || f.l_linenumber || '/' || f.l_partkey || '/' || f.l_suppkey as path, f.*
  from orders o join f on f.o_custkey = o.o_custkey
    and (contains(name, strftime(o.o_orderdate, '%Y%m%d')) or contains(name, strftime(o.o_orderdate + interval 1 day, '%Y%m%d')))
  where contains(name, 'item ' || o.o_custkey) and (name like '%.mp3' or name like '%.m4a')
"""


@query(
    "J4 J15",
    f"""
    select distinct event_key, path from ({MATCH_SQL}) x join orders o on o.o_orderkey = event_key
    where contains(name, '_' || o.o_orderpriority || '.')
    """,
)
def match_files(t):
    return M.match_files(stored_events(t), stored_files(t))


@query(
    "J4b",
    f"""
    select distinct event_key, path from ({MATCH_SQL}) x join orders o on o.o_orderkey = event_key
    where contains(name, o.o_orderpriority)
    """,
)
def match_files_contains(t):
    return M.match_files(stored_events(t), stored_files(t), mode="contains")


@query(
    "J5",
    """
    select l_orderkey, arg_min(p, (case when date_first then 0 else 1 end) * 1e12 + (case when exact then 0 else 1 end) * 1e11 + sr * 1e9 - q * 1e7 + n) as path
    from (select l_orderkey, l_linenumber || '/' || l_partkey || '/' || l_suppkey p, l_returnflag = 'R' date_first, l_linestatus = 'O' exact,
        case l_suppkey % 3 when 0 then 0 when 1 then 1 else 99 end sr, l_quantity q, row_number() over (partition by l_orderkey order by
        l_linenumber || '/' || l_partkey || '/' || l_suppkey) n from lineitem) group by 1
    """,
)
def best_match(t):
    s = F.col("l_suppkey")
    rows = t.lineitem.withColumn("path", F.format_string("%d/%d/%d", "l_linenumber", "l_partkey", "l_suppkey"))
    suffix = F.when(s % 3 == 0, "MP3").when(s % 3 == 1, "m4a").otherwise("ogg")
    return M.best_match(
        rows, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", suffix, F.col("l_quantity"), "path"
    )


@query(
    "J5b",
    """
    with m as (select l_orderkey k, 'm' || min(l_partkey) p from lineitem where l_returnflag = 'R' group by 1),
    s as (select l_orderkey k, 's' || max(l_partkey) p from lineitem where l_returnflag = 'A' group by 1)
    select o_orderkey k, coalesce(m.p, s.p) as path, case when m.p is not null then 'manifest' when s.p is not null then 'scan' else 'none' end origin
    from orders left join m on m.k = o_orderkey left join s on s.k = o_orderkey
    """,
)
def find_path(t):
    def side(flag, mark, agg):
        rows = t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("k"))
        return rows.agg(F.concat(F.lit(mark), agg("l_partkey").cast("string")).alias("path"))

    return M.find_path(t.orders.select(F.col("o_orderkey").alias("k")), side("R", "m", F.min), side("A", "s", F.max), "k")


@query(
    "J15",
    """
    select o_orderkey, l_linenumber, l_partkey from orders join lineitem on l_orderkey = o_orderkey
      and cast(l_shipdate as date) in (cast(o_orderdate as date), cast(o_orderdate + interval 33 hour as date))
    """,
)
def two_date_match(t):
    d = F.col("o_orderdate")
    shown = D.format_day(F.to_date(d + F.expr("interval '33' hour")))
    keys = t.orders.select(
        "o_orderkey", F.explode(M.two_dates(F.date_format(d, "yyyyMMdd"), shown)).alias("day")
    )
    files = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd").alias("day")
    )
    return keys.join(files, ["o_orderkey", "day"]).select("o_orderkey", "l_linenumber", "l_partkey")


@query(
    "J9",
    """
    with b as (
      select l_orderkey dir, l_partkey part from lineitem where l_returnflag = 'R' group by 1, 2 having min(l_quantity) >= 5),
    a as (select distinct l_orderkey dir, l_partkey part from lineitem where l_returnflag = 'A'),
    p as (select distinct o_orderkey dir from orders where o_orderstatus = 'P')
    select b.dir, 'p' || b.part || '.mp3.bak' as name, 'p' || b.part || '.mp3' as original, case when a.part is null then 'restore' else 'delete' end as action
    from b anti join p on b.dir = p.dir left join a on a.dir = b.dir and a.part = b.part
    """,
)
def restore_plan(t):
    flag = F.col("l_returnflag")
    name = F.concat(
        F.lit("p"), F.col("l_partkey").cast("string"),
        F.when(flag == "R", ".mp3.bak").when(flag == "A", ".mp3").otherwise(".txt.bak"),
    )
    files = t.lineitem.groupBy(F.col("l_orderkey").alias("dir"), name.alias("name")).agg(
        (F.lit(1000) - F.min("l_quantity")).alias("mtime")
    )
    active = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("dir"))
    return M.restore_plan(files, active, F.lit(1000), 5)


@query(
    "W1",
    """
    with f as (select source, doc_id, n_chars, sum(n_chars) over (partition by source) total,
        coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) before from documents)
    select source, doc_id, n_chars from f where total > 50000 and total - before > 50000
    """,
)
def evict_plan(t):
    files = t.documents.select("source", "doc_id", "n_chars")
    return M.evict_plan(files, ["source"], ["doc_id"], "n_chars", F.floor(F.col("doc_id") / 4096), 50000)
