"""Graph queries over the links of the pages, and over nations."""

from pyspark.sql import functions as F

from larkspan.operators import graph as G
from larkspan.registry import query
from larkspan.session import cut_lineage

LINK_SQL = """
  ed as (select 'p' || page_id as source, 'h' || unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as target from pages),
  nd as (select 'p' || page_id id from pages union select target from ed),
  un as (select source, target from ed union select target, source from ed)
"""


def links(t):
    e = G.link_edges(t.pages.select("page_id", "html"), "page_id", "html")
    return e.select(F.concat(F.lit("p"), F.col("source").cast("string")).alias("source"), F.concat(F.lit("h"), "target").alias("target"))


def written(t):
    """(nodes, edges), each worked out once and written for the many uses that follow."""
    edges = cut_lineage(links(t))
    pages = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"))
    return cut_lineage(pages.unionByName(edges.select(F.col("target").alias("id"))).distinct()), edges


@query("G10", f"with {LINK_SQL} select source, target, count(*) n from ed group by 1, 2")
def link_extraction(t):
    return links(t).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("G1", f"with {LINK_SQL} select id, count(*) degree from (select source id from ed union all select target from ed) group by 1")
def degree(t):
    return G.degree(links(t))


@query(
    "O7 G1",
    f"with {LINK_SQL} select id, count(*) degree from (select source id from ed union all select target from ed) group by 1 order by degree desc, id limit 10",
)
def top_hubs(t):
    return G.degree(links(t)).orderBy(F.col("degree").desc(), "id").limit(10)


@query(
    "G3",
    f"""
    with {LINK_SQL}, d as (select id, count(*) degree from (select source id from ed union all select target from ed) group by 1),
    n as (select id from nd union all select 's' || s_suppkey from supplier)
    select n.id, coalesce(degree, 0) degree from n left join d using (id) where coalesce(degree, 0) <= 1
    """,
)
def isolated_nodes(t):
    more = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    nodes, edges = written(t)
    return G.isolated(nodes.unionByName(more), edges)


@query(
    "G4",
    f"""
    with recursive {LINK_SQL}, rc as (select id, id as r from nd union select rc.id, un.target from rc join un on un.source = rc.r)
    select id, min(r) component from rc group by 1
    """,
)
def connected_components(t):
    return G.components(*written(t))


def _round_sql(i: int) -> str:
    return f"""
  v{i} as (select un.source id, l.c, count(*) n from un join l{i - 1} l on l.id = un.target group by 1, 2),
  b{i} as (select id, c from (select id, c, row_number() over (partition by id order by n desc, c) r from v{i}) where r = 1),
  l{i} as (select l.id, coalesce(b.c, l.c) c from l{i - 1} l left join b{i} b using (id))"""


COMMUNITY_SQL = f"{LINK_SQL}, l0 as (select id, id as c from nd), " + ", ".join(_round_sql(i) for i in (1, 2, 3))


@query("G4", f"with {COMMUNITY_SQL} select id, c as community from l3")
def communities(t):
    return G.communities(*written(t), rounds=3)


@query("G4", f"with {COMMUNITY_SQL} select c as community, count(*) n, count(*) < 3 as thin from l3 group by 1")
def community_sizes(t):
    return G.community_sizes(G.communities(*written(t), rounds=3))


@query(
    "G5",
    f"""
    with {COMMUNITY_SQL}, s as (select c, count(*) n from l3 group by 1 having count(*) >= 2),
    e as (select distinct least(source, target) a, greatest(source, target) b from ed where source <> target),
    i as (select x.c, count(*) k from e join l3 x on x.id = a join l3 y on y.id = b where x.c = y.c group by 1)
    select c as community, n, coalesce(k, 0) inside, round(coalesce(k, 0) * 2.0 / (n * (n - 1)), 6) cohesion from s left join i using (c)
    """,
)
def cohesion(t):
    nodes, edges = written(t)
    return G.cohesion(G.communities(nodes, edges, rounds=3), edges).withColumn("cohesion", F.round("cohesion", 6))


@query(
    "G7",
    f"""
    with {COMMUNITY_SQL} select source, target, x.c from_community, y.c to_community, count(*) n from ed join l3 x on x.id = source join l3 y on y.id = target
    where length(target) % 3 = 0 and x.c <> y.c group by all
    """,
)
def crossing_edges(t):
    nodes, edges = written(t)
    inferred = F.length("target") % 3 == 0
    out = G.crossing_edges(edges, G.communities(nodes, edges, rounds=3), inferred)
    return out.groupBy("source", "target", "from_community", "to_community").agg(F.count("*").alias("n"))


@query(
    "G6",
    f"""
    with recursive {LINK_SQL}, nb as (select source, target from un where source <> target),
    w(s, v, d, p) using key (s, v) as (
      select id, id, 0, 1::double from nd
      union
      select w.s, nb.target, w.d + 1, sum(w.p) from w join nb on nb.source = w.v
      where not exists (select 1 from recurring.w r where r.s = w.s and r.v = nb.target) group by 1, 2, 3),
    b as (
      select x.v id, sum(x.p * y.p / z.p) score from w x join w y on y.s = x.v join w z on z.s = x.s and z.v = y.v and z.d = x.d + y.d
      where x.s <> x.v and y.v <> x.v group by 1)
    select id, round(coalesce(score, 0), 6) score from nd left join b using (id)
    """,
)
def bridge_scores(t):
    """Betweenness with all nodes as sources."""
    nodes, edges = written(t)
    return G.bridge_scores(edges, nodes).withColumn("score", F.round("score", 6))


@query(
    "G8",
    """
    with recursive e as (select distinct c_nationkey s, cast(floor(c_acctbal) as integer) % 25 t from customer),
    w as (
      select [s] p, s f, t nx, 1 len from e where t >= s
      union all
      select list_append(p, nx), f, e.t, len + 1 from w join e on e.s = w.nx where nx > f and not list_contains(p, nx) and e.t >= f and len < 3)
    select array_to_string(p, '>') as cycle, len as n_nodes from w where nx = f
    """,
)
def import_cycles(t):
    e = t.customer.select(
        F.col("c_nationkey").alias("source"), (F.floor("c_acctbal").cast("int") % 25).alias("target")
    )
    return G.cycles(e, 3).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("n_nodes"))


@query(
    "G9",
    f"""
    with {LINK_SQL}, i as (select * from ed where length(target) % 3 = 0),
    b as (select source id, target o from i union all select target, source from i),
    f as (select id, o, row_number() over (partition by id order by o) r from (select distinct id, o from b))
    select id, n, examples from (select id, count(*) n from b group by 1) join (select id, string_agg(o, '|' order by o) examples from f where r <= 2 group by 1) using (id)
    """,
)
def audit_list(t):
    out = G.audit_list(links(t), F.length("target") % 3 == 0)
    return out.select("id", "n", F.array_join("examples", "|").alias("examples"))


@query(
    "S9",
    f"""
    with {LINK_SQL} select 'node' kind, id as a, null as b, count(*) n from nd group by id
    union all select 'edge', source, target, count(*) from ed group by all
    """,
)
def parse_graph(t):
    link_list = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]+)"'), F.lit(1))
    page = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    node = lambda i: F.struct(i.alias("id"), i.alias("label"), F.lit("page").alias("file_type"))
    doc = F.to_json(
        F.struct(
            F.concat(F.array(node(page)), F.transform(link_list, lambda h: node(F.concat(F.lit("h"), h)))).alias("nodes"),
            F.transform(
                link_list, lambda h: F.struct(page.alias("source"), F.concat(F.lit("h"), h).alias("target"), F.lit("links").alias("relation"))
            ).alias("edges"),
        )
    )
    nodes, edges, _ = G.parse_graph(t.pages.select(doc.alias("doc")), "doc")
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    return n.unionByName(e).groupBy("kind", "a", "b").agg(F.count("*").alias("n"))


@query(
    "J16",
    """
    with n as (select s_suppkey id, 'Brand#' || s_nationkey as label from supplier),
    l as (select label, count(*) c, min(id) target from n group by 1)
    select p_partkey as source, p_brand callee, target, case when c is null then 'UNRESOLVED' when c > 1 then 'AMBIGUOUS' else 'INFERRED' end confidence
    from part left join l on l.label = p_brand
    """,
)
def resolve_calls(t):
    label = F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"))
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), label.alias("label"))
    calls = t.part.select(F.col("p_partkey").alias("caller"), F.col("p_brand").alias("callee"))
    return G.resolve_calls(calls, nodes)
