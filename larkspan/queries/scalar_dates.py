"""Day, time and duration texts over orders and events."""

from pyspark.sql import functions as F

from larkspan.functions import dates as D
from larkspan.registry import query

# The same order dates written in seven ways.
TEXT_SQL = """
  select o_orderkey, case o_orderkey % 7
    when 0 then strftime(o_orderdate, '%Y%m%d')
    when 1 then strftime(o_orderdate, '%Y-%m-%d')
    when 2 then strftime(o_orderdate, '%Y/%m/%d') || '(火)'
    when 3 then cast(year(o_orderdate) as varchar) || '年' || cast(month(o_orderdate) as varchar) || '月' || cast(day(o_orderdate) as varchar) || '日放送'
    when 4 then '第3回 ' || cast(year(o_orderdate) as varchar) || '年' || cast(month(o_orderdate) as varchar) || '月' || cast(day(o_orderdate) as varchar) || '日 夜'
    when 5 then strftime(o_orderdate, '%Y%m%d') || 'T0900'
    else o_orderpriority end s,
    cast(o_orderdate as date) d
  from orders
"""
DAY_SQL = "case o_orderkey % 7 when 6 then null else d end"
SHOW_SQL = "strftime({0}, '%Y-%m-%d') || '(' || ['月','火','水','木','金','土','日'][isodow({0})] || ')'"
EPOCH_SQL = "epoch(date_trunc('second', ts))::bigint"


def day_texts(t):
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    ymd = F.concat(
        F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日")
    )
    s = (
        F.when(key % 7 == 0, F.date_format(d, "yyyyMMdd"))
        .when(key % 7 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(key % 7 == 2, F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit("(火)")))
        .when(key % 7 == 3, F.concat(ymd, F.lit("放送")))
        .when(key % 7 == 4, F.concat(F.lit("第3回 "), ymd, F.lit(" 夜")))
        .when(key % 7 == 5, F.concat(F.date_format(d, "yyyyMMdd"), F.lit("T0900")))
        .otherwise(F.col("o_orderpriority"))
    )
    return t.orders.select("o_orderkey", s.alias("s"), "o_orderdate")


@query("C14", f"select o_orderkey, {SHOW_SQL.format('cast(o_orderdate as date)')} shown from orders")
def format_day(t):
    return t.orders.select("o_orderkey", D.format_day(F.to_date("o_orderdate")).alias("shown"))


@query("C15", f"with x as ({TEXT_SQL}) select o_orderkey, {DAY_SQL} as day from x")
def parse_day(t):
    return day_texts(t).select("o_orderkey", D.parse_day(F.col("s")).alias("day"))


@query(
    "C16",
    f"""
    with x as ({TEXT_SQL})
    select o_orderkey, case when o_orderkey % 2 = 0 then {SHOW_SQL.format('cast(d + interval 1 day as date)')}
      when o_orderkey % 7 = 6 then s else {SHOW_SQL.format('d')} end shown
    from x
    """,
)
def format_onair(t):
    started = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T15:30:00Z")))
    return day_texts(t).select("o_orderkey", D.format_onair(F.col("s"), started).alias("shown"))


@query(
    "C17",
    f"""
    with x as ({TEXT_SQL})
    select o_orderkey, case when o_orderkey % 7 = 6 then s else {SHOW_SQL.format('d')} end shown from x
    """,
)
def format_event_date(t):
    return day_texts(t).select("o_orderkey", D.format_event_date(F.col("s")).alias("shown"))


@query(
    "C18",
    """
    select event_id, strftime(ts + interval 9 hour, '%H:%M') local_time, strftime(ts, '%H:%M:%S') utc_time from events
    """,
)
def local_time(t):
    epoch = D.epoch_seconds(F.col("ts"))
    return t.events.select(
        "event_id", D.local_time(epoch).alias("local_time"), D.local_time(epoch, seconds=True, offset=0).alias("utc_time")
    )


@query("C19", "select event_id, strftime(ts + interval 9 hour, '%Y%m%d') local_date from events")
def local_date(t):
    return t.events.select("event_id", D.local_date(D.epoch_seconds(F.col("ts"))).alias("local_date"))


SECONDS_SQL = "cast(floor(o_totalprice / 7) - 3000 as bigint)"


def seconds_col():
    return (F.floor(F.col("o_totalprice") / 7) - 3000).cast("long")


WORDS_SQL = """case when x <= 0 then '' when x >= 3600 then (x // 3600) || '時間' || (x % 3600 // 60) || '分' || (x % 60) || '秒'
    when x >= 60 then (x // 60) || '分' || (x % 60) || '秒' else x || '秒' end"""


@query("C20", f"select o_orderkey, {WORDS_SQL} words from (select o_orderkey, {SECONDS_SQL} x from orders)")
def format_duration(t):
    return t.orders.select("o_orderkey", D.format_duration(seconds_col()).alias("words"))


@query(
    "C20b",
    f"""
    select o_orderkey, case when x <= 0 then ''
      when x >= 3600 then case when x >= 360000 then cast(x // 3600 as varchar) else lpad(cast(x // 3600 as varchar), 2, '0') end
        || ':' || lpad(cast(x % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(x % 60 as varchar), 2, '0')
      when x >= 60 then '--:' || lpad(cast(x // 60 as varchar), 2, '0') || ':' || lpad(cast(x % 60 as varchar), 2, '0')
      else '--:--:' || lpad(cast(x as varchar), 2, '0') end clock
    from (select o_orderkey, {SECONDS_SQL} x from orders)
    """,
)
def format_duration_clock(t):
    return t.orders.select("o_orderkey", D.format_duration_clock(seconds_col()).alias("clock"))


@query(
    "C21",
    f"""
    with x as ({TEXT_SQL})
    select o_orderkey, case when o_orderkey % 7 = 6 then 0 else 1 end ok,
      case when o_orderkey % 7 = 6 then 0 else date_diff('day', date '1970-01-01', d) + 719163 end as day_no
    from x
    """,
)
def sort_day(t):
    k = D.sort_day(F.col("s"))
    return day_texts(t).select("o_orderkey", k["ok"].alias("ok"), k["day"].cast("long").alias("day_no"))


@query(
    "C22",
    f"""
    select event_id, case event_id % 4 when 3 then 0 else 1 end ok,
      case event_id % 4 when 3 then 0.0 when 0 then {EPOCH_SQL}::double when 1 then {EPOCH_SQL}::double
        else ({EPOCH_SQL} - 19800)::double end secs
    from events
    """,
)
def sort_ts(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    s = (
        F.when(kind == 0, F.concat(iso, F.lit("Z")))
        .when(kind == 1, D.epoch_seconds(F.col("ts")).cast("string"))
        .when(kind == 2, F.concat(iso, F.lit("+05:30")))
        .otherwise(F.col("event_type"))
    )
    k = D.sort_ts(s)
    return t.events.select("event_id", k["ok"].alias("ok"), k["ts"].alias("secs"))


@query(
    "C23",
    f"""
    select o_orderkey, case when x > 0 then 1 else 0 end ok, case when x > 0 then x else 0 end secs
    from (select o_orderkey, {SECONDS_SQL} x from orders)
    """,
)
def sort_duration(t):
    k = D.sort_duration(D.format_duration(seconds_col()))
    return t.orders.select("o_orderkey", k["ok"].alias("ok"), k["seconds"].alias("secs"))
