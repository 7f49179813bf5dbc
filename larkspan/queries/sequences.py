"""Ordered sequences over events, conversations and parts."""

from pyspark.sql import functions as F

from larkspan.functions import progress as P
from larkspan.operators import sequences as O
from larkspan.operators import terms as TM
from larkspan.queries.scalar_measures import LINE_SQL, log_lines
from larkspan.registry import query

ORDER = ["ts", "event_id"]


def hours():
    """Pieces of an event sequence: one per key and hour."""
    return F.date_trunc("hour", "ts")


RUNS_SQL = """
  a as (select *, row_number() over (partition by user_id order by ts, event_id) r,
      lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type n from events),
  b as (select *, r - max(case when n or r = 1 then r end) over (partition by user_id order by r) since from a)
"""


@query(
    "W2",
    f"""
    with {RUNS_SQL}, e as (select user_id, min(r) z from b where since = 3 group by 1)
    select b.user_id, event_id, event_type from b left join e using (user_id) where since = 0 and (z is null or r < z)
    """,
)
def drop_repeats(t):
    events = t.events.select("user_id", "ts", "event_id", "event_type")
    return O.drop_repeats(events, ["user_id"], ORDER, hours(), "event_type").select("user_id", "event_id", "event_type")


def _recent_sql(value: str, history: int) -> str:
    return f"""
    with recursive a as (select user_id, event_id, {value} as v, row_number() over (partition by user_id order by ts, event_id) r from events),
    f as (
      select user_id, event_id, r, v, [v] recent, 0 same, true taken, 1 n from a where r = 1
      union all
      select a.user_id, a.event_id, a.r, a.v, case when list_contains(recent, a.v) then recent
          else list_append(recent, a.v)[greatest(len(recent) + 2 - {history}, 1):] end,
        case when list_contains(recent, a.v) then same + 1 else 0 end, not list_contains(recent, a.v),
        n + case when list_contains(recent, a.v) then 0 else 1 end
      from f join a on a.user_id = f.user_id and a.r = f.r + 1 where same < 3 and n < 200)
    select user_id, event_id, v as event_type from f where taken
    """


@query("W3", _recent_sql("event_type", 2))
def drop_recent_repeats(t):
    events = t.events.select("user_id", "ts", "event_id", "event_type")
    kept = O.drop_recent_repeats(events, "user_id", ORDER, hours(), "event_type", max_pages=200, history=2)
    return kept.select("user_id", "event_id", "event_type")


@query("W3", _recent_sql("event_type || event_id % 4", 5))
def drop_recent_repeats_default(t):
    """The default history, over values of which more than five are met."""
    value = F.concat("event_type", (F.col("event_id") % 4).cast("string"))
    events = t.events.select("user_id", "ts", "event_id", value.alias("event_type"))
    kept = O.drop_recent_repeats(events, "user_id", ORDER, hours(), "event_type", max_pages=200)
    return kept.select("user_id", "event_id", "event_type")


@query(
    "W4",
    f"with {RUNS_SQL} select user_id, arg_min(event_id, r) event_id, arg_min(event_type, r) event_type from b where since >= 2 group by 1",
)
def stable_points(t):
    events = t.events.select("user_id", "ts", "event_id", "event_type")
    return O.stable_points(events, ["user_id"], ORDER, hours(), "event_type").select("user_id", "event_id", "event_type")


@query(
    "W11",
    """
    select p_partkey, 100.0::double + coalesce(sum(p_size + 30) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::double x
    from part
    """,
)
def flow_layout(t):
    rows = t.part.select("p_partkey", "p_brand", "p_size")
    out = O.flow_layout(rows, ["p_brand"], ["p_partkey"], F.floor(F.col("p_partkey") / 4096), F.col("p_size").cast("double"))
    return out.select("p_partkey", "x")


@query(
    "W12",
    """
    with s as (select page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: trim(x) <> '') p from pages)
    select page_id, unnest(p[1:len(p) - 1]) as source, unnest(p[2:len(p)]) target from s where len(p) > 1
    """,
)
def chain_edges(t):
    chain = F.replace(F.regexp_replace("url", "[?#].*$", ""), F.lit("/"), F.lit(" -> "))
    return t.pages.select("page_id", F.explode(O.chain_edges(chain)).alias("e")).select("page_id", "e.source", "e.target")


TERM_SQL = "case when event_id % 2 = 0 then upper(event_type) else event_type end || ' ' || cast(cast(floor(value) as bigint) % 20 as varchar)"


def search_terms(t):
    kind = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    term = F.concat(kind, F.lit(" "), (F.floor("value").cast("long") % 20).cast("string"))
    return t.events.select("user_id", "ts", "event_id", term.alias("term"))


@query(
    "W14",
    f"""
    with x as (select user_id, {TERM_SQL} term, ts, event_id from events),
    g as (select user_id, lower(term) k, arg_max(term, (ts, event_id)) term, max((ts, event_id)) m from x group by 1, 2),
    r as (select user_id, term, row_number() over (partition by user_id order by m desc) as rank from g)
    select user_id, term, cast(rank as integer) as rank from r where rank <= 30
    """,
)
def recent_distinct(t):
    return O.recent_distinct(search_terms(t), "user_id", "term", ORDER)


@query(
    "W14b",
    f"""
    with x as (select user_id, {TERM_SQL} term, ts, event_id from events),
    g as (select user_id, term, max((ts, event_id)) m from x group by 1, 2),
    r as (select user_id, term, row_number() over (partition by user_id order by m desc) as rank from g)
    select user_id, term, cast(rank as integer) as rank from r where rank <= 10 and contains(lower(term), 'click')
    """,
)
def recent_exact(t):
    recent = O.recent_distinct(search_terms(t), "user_id", "term", ORDER, limit=10, fold=False)
    return recent.filter(F.lower("term").contains("click"))


@query(
    "W15",
    """
    with a as (select *, coalesce(sum(case when event_type in ('purchase', 'error') then 1 else 0 end)
        over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) ep from events),
    j as (select *, first_value(event_id) over (partition by user_id, ep order by ts, event_id) job from a where event_type = 'signup')
    select user_id, event_id, job as job_id, job = event_id is_new from j
    """,
)
def dedupe_active_jobs(t):
    kind = F.col("event_type")
    events = t.events.select("user_id", "ts", "event_id", "event_type")
    return O.active_jobs(events, "user_id", ORDER, hours(), "event_id", kind == "signup", kind.isin("purchase", "error"))


@query(
    "W21",
    f"""
    with l as (select user_id, ts, event_id, trim(line) line from ({LINE_SQL}))
    select user_id, coalesce(arg_max(case when trim(substr(line, 7)) = '' then line else trim(substr(line, 7)) end, (ts, event_id))
      filter (line like 'ERROR:%'), 'exit code 1') reason from l group by 1
    """,
)
def last_error_line(t):
    return O.last_error(log_lines(t.events), "user_id", ORDER, P.error_reason(F.col("line")), F.lit(1))


@query(
    "W22",
    """
    select conv_id, turn, case when role = 'user' then 'user' else 'model' end as role, md5(text) digest from (
      select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 6
    """,
)
def last_n_per_group(t):
    rows = O.last_n(t.conversations, "conv_id", "turn", 6)
    return rows.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("model").alias("role"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
    )


@query(
    "J14",
    """
    select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls)
      over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) last_purchase from events
    """,
)
def last_purchase_as_of(t):
    events = t.events.select("user_id", "ts", "event_id", "event_type")
    out = O.as_of(events, ["user_id"], ORDER, hours(), F.col("event_type") == "purchase", "event_id", "last_purchase")
    return out.select("event_id", "last_purchase")


@query(
    "T4 C44",
    """
    with a as (select user_id, ts, event_id, value > 10 s, row_number() over (partition by user_id order by ts, event_id) r from events),
    b as (select *, r - row_number() over (partition by user_id, s order by r) g from a)
    select user_id, min(ts) as start, max(ts) as end, count(*) chunks from b where s group by user_id, g
    """,
)
def speaking_segments(t):
    events = t.events.select("user_id", "ts", "event_id", "value")
    return O.speaking_segments(events, ["user_id"], ORDER, hours(), F.col("value") > 10, "ts")


@query("A15", "select event_type as status, count(*) n from events group by 1")
def jobs_by_status(t):
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query(
    "J10",
    """
    select doc_id, md5(replace(replace(replace(text, 'tion ', 'TION-'), 'the', 'DER'), 'an', 'EIN')) digest from documents
    """,
)
def apply_terms(t):
    # the dictionary: three enabled words and one disabled one, drawn from the table of nations
    row = F.element_at(
        F.array(
            *[
                F.struct(F.lit(a).alias("reading"), F.lit(b).alias("target"), F.lit(c).alias("is_enabled"))
                for a, b, c in (("the", "DER", True), ("an", "EIN", True), ("tion ", "TION-", True), ("en", "XX", False))
            ]
        ),
        (F.col("n_nationkey") % 4 + 1).cast("int"),
    )
    terms = t.nation.select(row.alias("r")).select("r.*").distinct()
    out = TM.apply_terms(t.documents.select("doc_id", "text"), "text", terms)
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
