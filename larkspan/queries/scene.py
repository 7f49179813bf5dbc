"""Scene tables made from parts and customers."""

from pyspark.sql import functions as F

from larkspan.operators import scene as S
from larkspan.registry import query


@query(
    "E1",
    """
    select p_partkey, case when p_size % 3 = 0 then 'rectangle' else p_type end "type", case when p_size % 4 = 0 then 100 else p_retailprice end x, 100.0::double y,
      case when p_size % 5 = 0 then 140 else p_size::double end width, case when p_size % 7 = 0 then 2.0 when p_size % 2 = 0 then 2 else p_size end::double stroke_width,
      case when p_brand = 'Brand#7' then 'transparent' else p_brand end background_color
    from part
    """,
)
def format_elements(t):
    k, size = F.col("p_size"), F.col("p_size").cast("string")
    cols = S.format_element(
        {
            "type": F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_type")),
            "x": F.when(k % 4 != 0, F.col("p_retailprice")),
            "y": F.lit("not a number"),
            "width": F.when(k % 5 != 0, size),
            "stroke_width": F.when(k % 7 == 0, F.lit("0")).when(k % 2 != 0, size),
            "background_color": F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")),
        }
    )
    wanted = ("type", "x", "y", "width", "stroke_width", "background_color")
    return t.part.select("p_partkey", *[cols[n].alias(n) for n in wanted])


POINT_SQL = """
  o as (select c_custkey id, c_acctbal x, c_nationkey * 7.0::double y from customer),
  n as (select s_suppkey + 700 id, s_acctbal x, s_nationkey * 7.0::double y from supplier)
"""


def points(t):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 7.0).alias("y"))
    new = t.supplier.select((F.col("s_suppkey") + 700).alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 7.0).alias("y"))
    return old, new


@query(
    "J7",
    f"""
    with {POINT_SQL} select 'within 10' as rule, id from o where not exists (select 1 from n where n.id <> o.id and abs(n.x - o.x) <= 10 and abs(n.y - o.y) <= 10)
    union all select 'below 20', id from o where not exists (select 1 from n where n.id <> o.id and abs(n.x - o.x) < 20 and abs(n.y - o.y) < 20)
    """,
)
def proximity_anti(t):
    old, new = points(t)
    a = S.proximity_anti(old, new).select(F.lit("within 10").alias("rule"), "id")
    b = S.proximity_anti(old, new, tol=20.0, inclusive=False).select(F.lit("below 20").alias("rule"), "id")
    return a.unionByName(b)


@query(
    "J8",
    """
    with d as (select o_custkey + 100 k, arg_max(case when o_orderkey % 3 = 0 then null else o_orderpriority end, o_orderkey) seg,
        arg_max(o_totalprice, o_orderkey) bal, max(o_orderkey) from orders group by 1),
    dd as (select k, (select case when o_orderkey % 3 = 0 then null else o_orderpriority end from orders where o_orderkey = m) seg, bal from (
        select o_custkey + 100 k, max(o_orderkey) m, arg_max(o_totalprice, o_orderkey) bal from orders group by 1))
    select coalesce(c_custkey, k) as id, coalesce(seg, c_mktsegment) segment, coalesce(bal, c_acctbal) balance,
      case when c_custkey is not null and k is not null then c_nationkey + case when c_nationkey = 0 then 2 else 1 end when c_custkey is not null then c_nationkey else 1 end as version
    from customer full outer join dd on k = c_custkey
    """,
)
def upsert_by_id(t):
    base = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("version"),
    )
    delta = t.orders.select(
        (F.col("o_custkey") + 100).alias("id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("segment"), F.col("o_totalprice").alias("balance"),
    )
    return S.upsert_by_id(base, delta, "id", ["segment", "balance"], seq="seq")


ANCHOR_SQL = """
  e as (select cast(p_partkey as varchar) id, p_retailprice x, p_size * 2.0::double y, case when p_size % 6 = 0 then null else p_size * 1.0::double end w, 50.0::double h from part),
  a as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, case l_suppkey % 3 when 0 then cast(l_partkey as varchar) when 1 then l_linenumber || ', ' || l_suppkey else 'gone' end f,
     case l_suppkey % 4 when 0 then 'x,' || l_linenumber when 1 then null else cast(l_partkey as varchar) end g from lineitem)
"""


@query(
    "J17",
    f"""
    with {ANCHOR_SQL}
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case l_suppkey % 3 when 0 then p.x + coalesce(p.w, 0) / 2 when 1 then l_linenumber else 1.0 end::double from_x,
      case l_suppkey % 3 when 0 then p.y + p.h / 2 when 1 then l_suppkey else 2.0 end::double from_y,
      case l_suppkey % 4 when 0 then 9.0 when 1 then 9.0 else q.x + coalesce(q.w, 0) / 2 end::double to_x,
      case l_suppkey % 4 when 0 then l_linenumber when 1 then 8.0 else q.y + q.h / 2 end::double to_y
    from a left join e p on p.id = f left join e q on q.id = g
    """,
)
def anchor_join(t):
    size = F.col("p_size").cast("double")
    elements = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("x"), (size * 2).alias("y"),
        F.when(F.col("p_size") % 6 != 0, size).alias("width"), F.lit(50.0).alias("height"),
    )
    s, n, p = F.col("l_suppkey"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    arrows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(s % 3 == 0, p).when(s % 3 == 1, F.concat(n, F.lit(", "), s.cast("string"))).otherwise("gone").alias("f"),
        F.when(s % 4 == 0, F.concat(F.lit("x,"), n)).when(s % 4 != 1, p).alias("g"),
    )
    out = S.resolve_anchor(arrows, elements, "f", "from", (1.0, 2.0))
    return S.resolve_anchor(out, elements, "g", "to", (9.0, 8.0), target=True).drop("f", "g")


def scene(t):
    """Customers as elements, all of them visible or hidden by their nation."""
    k = F.col("c_custkey")
    groups = F.when(F.col("c_nationkey") % 4 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>"))
    return t.customer.select(
        k.cast("string").alias("id"), F.col("c_acctbal").alias("x"), F.lit(7.0).alias("y"), F.array(F.array(F.lit(2.0), F.lit(3.0))).alias("points"), F.lit(40.0).alias("width"), F.lit(20.0).alias("height"),
        F.lit(0.5).alias("angle"), F.when(F.col("c_nationkey") % 3 == 0, 0.0).otherwise(80.0).alias("opacity"),
        F.when(F.col("c_nationkey") % 3 == 0, 60.0).alias("prev_opacity"), groups.alias("groups"),
        F.lit(None).cast("string").alias("link"), F.lit(1).alias("version"),
    )


OPS = ["delete", "hide", "show", "group", "ungroup", "link", "front", "back", "move", "move_by", "scale", "resize", "rotate", "rotate_by"]


def changes(t):
    """Every order of a customer is a change of that element; the operation follows from the order."""
    op = F.element_at(F.array(*[F.lit(o) for o in OPS]), (F.col("o_orderkey") % 14 + 1).cast("int"))
    seldom = F.when((op == "delete") & (F.col("o_orderpriority") != "1-URGENT"), F.lit("show")).otherwise(op)
    return t.orders.select(
        F.col("o_orderkey").alias("seq"), seldom.alias("op"), F.col("o_custkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("text"), F.col("o_orderkey").cast("double").alias("number"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("double")).alias("second"),
    )


CHANGE_SQL = """
  ch as (
    select o_orderkey seq, cast(o_custkey as varchar) id, o_orderpriority txt, o_orderkey::double num, case when o_orderkey % 3 <> 0 then o_custkey::double end num2,
      case when o_orderkey % 14 = 0 and o_orderpriority <> '1-URGENT' then 'show'
      else (['delete','hide','show','group','ungroup','link','front','back','move','move_by','scale','resize','rotate','rotate_by'])[o_orderkey % 14 + 1] end op from orders),
  cm as (
    select id, bool_or(op = 'delete') del, bool_or(op = 'hide') hid, arg_max(num, seq) filter (op = 'show') sho, arg_max(txt, seq) filter (op = 'group') grp,
      bool_or(op = 'ungroup') ung, arg_max(txt, seq) filter (op = 'link') lnk, bool_or(op = 'front') fro, bool_or(op = 'back') bac,
      arg_max({'op': op, 'a': num, 'b': num2}, seq) filter (op in ('move', 'move_by')) mv, arg_max({'op': op, 'a': num, 'b': num2}, seq) filter (op in ('scale', 'resize')) sz,
      arg_max({'op': op, 'a': num, 'b': num2}, seq) filter (op in ('rotate', 'rotate_by')) ro, bool_or(op not in ('delete', 'front', 'back')) touched
    from ch group by 1),
  el as (
    select cast(c_custkey as varchar) id, c_acctbal x, case when c_nationkey % 3 = 0 then 0.0 else 80.0 end::double opacity, case when c_nationkey % 3 = 0 then 60.0 end::double prev,
      case when c_nationkey % 4 = 0 then 'old' else '' end g from customer)
"""


@query(
    "U6 E2 E3 C49",
    f"""
    with {CHANGE_SQL}
    select el.id, case when hid then 0.0 when sho is not null then sho else opacity end opacity,
      case when hid then case when opacity <> 0 then opacity else coalesce(prev, 100) end else prev end prev_opacity,
      case when grp is not null then case when g = '' then grp else g || '|' || grp end when ung then '' else g end groups,
      lnk as link, case when mv.op = 'move_by' then x + coalesce(mv.a, 0) else coalesce(mv.a, x) end x,
      case when mv.op = 'move_by' then 7 + coalesce(mv.b, 0) else coalesce(mv.b, 7) end::double y,
      case when sz.op = 'scale' then case when sz.a > 0 then floor(40 * sz.a + 0.5) else 40 end else coalesce(sz.a, 40) end::double width,
      case when sz.op = 'scale' then case when sz.a > 0 then floor(20 * sz.a + 0.5) else 20 end else coalesce(sz.b, 20) end::double height,
      case when sz.op = 'scale' and sz.a > 0 then 3 * sz.a else 3 end::double py,
      case when ro.op = 'rotate_by' then 0.5 + ro.a when ro.op = 'rotate' then ro.a else 0.5 end::double angle,
      case when touched then 2 else 1 end as version, case when bac then -1 when fro then 1 else 0 end band
    from el left join cm using (id) where not coalesce(del, false)
    """,
)
def apply_changes(t):
    out = S.apply_changes(scene(t), changes(t))
    return out.select(
        "id", "opacity", "prev_opacity", F.array_join("groups", "|").alias("groups"), "link", "x", "y", "width", "height",
        F.col("points")[0][1].alias("py"), "angle", "version", "band",
    )


@query(
    "U6",
    """
    with ch as (
      select o_orderkey seq, cast(o_custkey * 2 as varchar) id, o_orderpriority txt, o_orderkey::double num,
        (['delete','hide','show','group','ungroup','link','move_by'])[o_orderkey % 7 + 1] op from orders),
    cm as (
      select id, bool_or(op = 'delete') del, bool_or(op = 'hide') hid, arg_max(num, seq) filter (op = 'show') sho, arg_max(txt, seq) filter (op = 'group') grp,
        bool_or(op = 'ungroup') ung, arg_max(txt, seq) filter (op = 'link') lnk, arg_max(num, seq) filter (op = 'move_by') mv, bool_or(op <> 'delete') touched
      from ch group by 1),
    el as (
      select cast(c_custkey as varchar) id, c_acctbal x, case when c_nationkey % 3 = 0 then 0.0 else 80.0 end::double opacity, case when c_nationkey % 3 = 0 then 60.0 end::double prev,
        case when c_nationkey % 4 = 0 then 'old' else '' end g from customer),
    ad as (select cast(s_suppkey * 20 as varchar) id, s_acctbal x, case when s_suppkey % 2 = 0 then 30.0 end::double opacity, case when s_suppkey % 3 = 0 then 'new' end g from supplier),
    kept as (select el.*, true as old from el left join cm using (id) where not coalesce(del, false)),
    al as (
      select coalesce(k.id, a.id) id, coalesce(a.x, k.x) x, coalesce(a.opacity, k.opacity) opacity, k.prev, coalesce(a.g, k.g) g, k.id is null fresh, k.id is not null and a.id is not null repl
      from kept k full outer join ad a on k.id = a.id)
    select al.id, case when hid then 0.0 when sho is not null then sho else opacity end opacity,
      case when hid then case when fresh then opacity when opacity <> 0 then opacity else coalesce(prev, 100) end else prev end prev_opacity,
      case when grp is not null then case when coalesce(g, '') = '' then grp else g || '|' || grp end when ung and not fresh then '' else g end groups,
      lnk as link, x + coalesce(mv, 0) x, case when fresh then 1 when repl or coalesce(touched, false) then 2 else 1 end as version
    from al left join cm using (id)
    """,
)
def merge_batch(t):
    ops = F.array(*[F.lit(o) for o in ("delete", "hide", "show", "group", "ungroup", "link", "move_by")])
    commands = t.orders.select(
        F.col("o_orderkey").alias("seq"), F.element_at(ops, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("op"), (F.col("o_custkey") * 2).cast("string").alias("id"),
        F.col("o_orderpriority").alias("text"), F.col("o_orderkey").cast("double").alias("number"),
    )
    old = scene(t)
    none = {f.name: F.lit(None).cast(f.dataType) for f in old.schema}
    k = F.col("s_suppkey")
    given = none | {
        "id": (k * 20).cast("string"), "x": F.col("s_acctbal"), "opacity": F.when(k % 2 == 0, 30.0), "groups": F.when(k % 3 == 0, F.array(F.lit("new"))), "version": F.lit(1),
    }
    out = S.merge_batch(old, t.supplier.select(*[c.alias(n) for n, c in given.items()]), commands)
    return out.select("id", "opacity", "prev_opacity", F.array_join("groups", "|").alias("groups"), "link", "x", "version")


@query(
    "E2",
    """
    select p_partkey, case when p_size % 3 = 0 then p_brand || '|' || p_type when p_size % 3 = 1 then '' else p_brand end tags from part
    """,
)
def group_tags(t):
    k = F.col("p_size") % 3
    tags = S.group_tags(F.array("p_brand"), F.when(k == 0, F.col("p_type")), k == 1)
    return t.part.select("p_partkey", F.array_join(tags, "|").alias("tags"))


@query(
    "E3",
    """
    select p_partkey, case when p_size % 3 = 0 then 0.0 when p_size % 3 = 1 then p_size else p_retailprice end::double opacity,
      case when p_size % 3 = 0 then p_retailprice else 7.0 end::double prev from part
    """,
)
def hide_show(t):
    k = F.col("p_size") % 3
    opacity, prev = S.hide_show(F.col("p_retailprice"), F.lit(7.0), k == 0, F.when(k <= 1, F.col("p_size").cast("double")))
    return t.part.select("p_partkey", opacity.alias("opacity"), prev.alias("prev"))
