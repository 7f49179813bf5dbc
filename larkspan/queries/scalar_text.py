"""Scalar text functions over the driver tables."""

from pyspark.sql import functions as F

from larkspan.functions import text as X
from larkspan.functions import unicode as U
from larkspan.registry import query

FOLD_SQL = "replace(lower({0}), 'ß', 'ss')"


@query(
    "C1",
    r"""
    select doc_id, length(n) n_chars, md5(n) digest
    from (select doc_id, regexp_replace(replace(coalesce(text, ''), '　', ' '), '^\s+|\s+$', '', 'g') n from documents)
    """,
)
def norm_text(t):
    n = X.norm_text(F.col("text"))
    return t.documents.select("doc_id", F.length(n).cast("long").alias("n_chars"), X.fingerprint(n).alias("digest"))


@query(
    "C2 X1",
    rf"""
    select doc_id, md5({FOLD_SQL.format("trim(text)")}) digest from documents
    """,
)
def fold_text(t):
    return t.documents.select("doc_id", X.fingerprint(X.fold_text(F.col("text"))).alias("digest"))


@query(
    "C3",
    r"""
    select conv_id, turn, regexp_replace(text, '\s+', '', 'g') squashed from conversations
    """,
)
def squash(t):
    return t.conversations.select("conv_id", "turn", X.squash(F.col("text")).alias("squashed"))


SAFE_SQL = r"""rtrim(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[\\/:*?"<>|\x00-\x1f\x7f]', '_', 'g'), ' .')"""


@query(
    "C4 C7",
    f"""
    with clean as (select doc_id, {SAFE_SQL.format("text")} n from documents),
    base as (
      select doc_id, case when regexp_matches(split_part(n, '.', 1), '^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$')
        then split_part(n, '.', 1) || '_' || substr(n, length(split_part(n, '.', 1)) + 1) else n end n
      from clean),
    cut as (
      select doc_id, case when strlen(n) <= 255 then n else rtrim(left(n, list_max(list_filter(
          range(0, 256), lambda k: strlen(left(n, k)) <= 255))), ' .') end n
      from base
    )
    select doc_id, case when n = '' then 'unknown' else n end safe from cut
    union all
    select -1 - p_partkey, case when p_size % 5 = 0 then 'CON_.txt' when p_size % 5 = 1 then 'lpt1_'
        else {SAFE_SQL.format("p_name || '/' || p_brand || ' ?. '")} end
    from part
    """,
)
def safe_name(t):
    docs = t.documents.select("doc_id", X.safe_name(F.col("text")).alias("safe"))
    kind = F.col("p_size") % 5
    raw = F.when(kind == 0, "CON.txt").when(kind == 1, "lpt1 ").otherwise(
        F.concat("p_name", F.lit("/"), "p_brand", F.lit(" ?. "))
    )
    return docs.unionByName(t.part.select((-1 - F.col("p_partkey")).alias("doc_id"), X.safe_name(raw).alias("safe")))


@query(
    "C4b",
    r"""
    select page_id, rtrim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g'), ' .') safe from pages
    """,
)
def safe_name_plain(t):
    return t.pages.select("page_id", X.safe_name(F.col("url"), strict=False).alias("safe"))


@query(
    "C5",
    r"""
    select page_id, left(replace(trim(regexp_replace(url, '[\\/:*?"<>|]', '', 'g')), ' ', '_'), 40) part_title from pages
    """,
)
def part_title(t):
    return t.pages.select("page_id", X.part_title(F.col("url")).alias("part_title"))


@query(
    "C5b",
    r"""
    select doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(text,
        '[<>:"/\\|?*\n\r\t]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 80), '^\s+|\s+$', '', 'g') folder
    from documents
    """,
)
def capture_title(t):
    return t.documents.select("doc_id", X.capture_title(F.col("text")).alias("folder"))


@query(
    "C6",
    """
    with x as (
      select p_partkey, case when p_size % 3 = 0 then '' else p_brand end s,
             case when p_size % 4 = 0 then '' when p_size % 5 = 0 then p_brand else p_name end i
      from part)
    select p_partkey, case when s <> '' and i <> '' and s <> i then '[' || s || '] ' || i
        when s <> '' then s when i <> '' then i else '(無題)' end shown
    from x
    """,
)
def display_title(t):
    size = F.col("p_size")
    series = F.when(size % 3 == 0, F.lit("")).otherwise(F.col("p_brand"))
    item = F.when(size % 4 == 0, F.lit(None)).when(size % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.display_title(series, item).alias("shown"))


@query(
    "C7",
    """
    select conv_id, turn, left(text, list_max(list_filter(range(0, 101), lambda k: strlen(left(text, k)) <= 100))) cut,
           strlen(text) n_bytes
    from conversations
    """,
)
def truncate_bytes(t):
    return t.conversations.select(
        "conv_id",
        "turn",
        X.truncate_bytes(F.col("text"), 100).alias("cut"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )


@query("C7b", "select conv_id, turn, greatest(205 - strlen(text), 30) budget from conversations")
def title_budget(t):
    return t.conversations.select("conv_id", "turn", X.title_budget(F.col("text")).cast("long").alias("budget"))


@query(
    "C8",
    """
    select event_id, length(w) + length(w) - length(regexp_replace(w, '[月火水木金土日時間分秒（）]', '', 'g')) width
    from (select event_id, event_type || '（' || cast(event_id as varchar) || '分）月' || props w from events)
    """,
)
def display_width(t):
    label = F.concat("event_type", F.lit("（"), F.col("event_id").cast("string"), F.lit("分）月"), "props")
    return t.events.select("event_id", X.display_width(label).cast("long").alias("width"))


@query(
    "C9",
    """
    select p_partkey, case when p_size % 3 = 0 then array_to_string(list_transform(string_split(p_name, ' '),
             lambda w: case w when 'red' then 'Rot' when 'blue' then 'Blau' when 'small' then 'Klein' else '未分類' end), ' / ')
           when p_size % 3 = 1 then array_to_string(string_split(p_name, ' '), ' / ')
           else '未分類' end labels
    from part
    """,
)
def label_text(t):
    lookup = F.create_map(*[F.lit(v) for v in ("red", "Rot", "blue", "Blau", "small", "Klein")])
    words = F.split("p_name", " ")
    none = F.array().cast("array<string>")
    kind = F.col("p_size") % 3
    labels = F.when(kind == 1, words).otherwise(none)
    codes = F.when(kind == 0, words).otherwise(none)
    return t.part.select("p_partkey", X.label_text(labels, codes, lookup).alias("labels"))


@query(
    "C10",
    """
    with k as (select l_orderkey, l_linenumber, case when l_linenumber = 7 then cast(l_orderkey as varchar)
        else cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) || '_' || l_returnflag end k from lineitem)
    select l_orderkey, l_linenumber, k as item_key,
        case when contains(k, '_') then string_split(k, '_')[1] end head,
        case when contains(k, '_') then substr(k, instr(k, '_') + 1) end tail
    from k
    """,
)
def item_keys(t):
    key = F.when(F.col("l_linenumber") == 7, F.col("l_orderkey").cast("string")).otherwise(
        X.item_key(F.col("l_orderkey").cast("string"), X.item_key(F.col("l_linenumber").cast("string"), F.col("l_returnflag")))
    )
    parts = X.split_key(key)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag").select(
        "l_orderkey", "l_linenumber", key.alias("item_key"), parts["head"].alias("head"), parts["tail"].alias("tail")
    )


@query(
    "C11",
    """
    select o_orderkey, case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y%m%d') || ':' || o_orderpriority
        else cast(o_orderkey as varchar) end event_key
    from orders
    """,
)
def event_keys(t):
    key = F.col("o_orderkey")
    event_id = F.when(key % 4 == 0, F.lit("  ")).otherwise(key.cast("string"))
    return t.orders.select(
        "o_orderkey",
        X.event_key(event_id, F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderpriority")).alias("event_key"),
    )


@query(
    "C12 U5",
    """
    with v as (
      select p_partkey, p_name, p_brand, p_type, case when p_size % 2 = 0 then '' else p_brand end site from part)
    select p_partkey,
      case when site <> '' then site || '_' || p_type else p_name end storage_id,
      array_to_string(case when site = '' then [p_name, p_brand, p_type] else [p_name, p_brand, site || '_' || p_type] end, '|') variants,
      array_to_string(list_prepend(case when site <> '' then site || '_' || p_type else p_name end,
        list_transform(case when site = '' then [p_name, p_brand, p_type] else [p_name, p_brand, site || '_' || p_type] end,
          lambda n: 'shelf/' || n)), '|') dirs
    from v
    """,
)
def storage_names(t):
    site = F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_brand"))
    args = (site, F.col("p_type"), F.col("p_name"), F.col("p_brand"))
    variants = X.title_variants(*args)
    home = X.storage_id(*args)
    dirs = F.array_distinct(F.concat(F.array(home), F.transform(variants, lambda n: F.concat(F.lit("shelf/"), n))))
    return t.part.select(
        "p_partkey",
        home.alias("storage_id"),
        F.array_join(variants, "|").alias("variants"),
        F.array_join(dirs, "|").alias("dirs"),
    )


@query(
    "C13",
    """
    with d as (
      select o_orderkey, o_orderpriority p, o_orderstatus s, strftime(o_orderdate, '%Y%m%d') a,
             strftime(o_orderdate + interval 1 day, '%Y%m%d') b from orders)
    select o_orderkey, a || '_' || p || '_' || s || '.mp3' name, '3_' || a || '_' || p || '_' || s || '.mp3' numbered,
      a || '_' || p || '_' || s || '|' || b || '_' || p || '_' || s || '|' || a || '_' || p || '_x' || s || '|' ||
      b || '_' || p || '_x' || s stems
    from d
    """,
)
def output_names(t):
    a = F.date_format("o_orderdate", "yyyyMMdd")
    b = F.date_format(F.col("o_orderdate") + F.expr("interval 1 day"), "yyyyMMdd")
    item, title = F.col("o_orderpriority"), F.col("o_orderstatus")
    stems = X.name_stems(F.array(a, b), F.array(item), F.array(title, F.concat(F.lit("x"), title)))
    return t.orders.select(
        "o_orderkey",
        X.output_name(a, item, title, "mp3").alias("name"),
        X.output_name(a, item, title, "mp3", F.lit(3)).alias("numbered"),
        F.array_join(stems, "|").alias("stems"),
    )


@query(
    "C38",
    r"""
    select page_id, replace(replace(replace(replace(replace(x, '\\', chr(1)), '\n', chr(10)), '\t', chr(9)), '\r', chr(13)), chr(1), '\') plain
    from (select page_id, replace(replace(url, '/', '\n'), '.', '\\t') || '\\\n' x from pages)
    """,
)
def unescape(t):
    raw = F.concat(
        F.replace(F.replace(F.col("url"), F.lit("/"), F.lit("\\n")), F.lit("."), F.lit("\\\\t")), F.lit("\\\\\\n")
    )
    return t.pages.select("page_id", X.unescape(raw).alias("plain"))


@query(
    "C40",
    """
    with w as (
      select doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
        lambda x: x <> '') ws, source from documents),
    e as (select doc_id, unnest(list_append(ws, source)) x, generate_subscripts(list_append(ws, source), 1) i from w),
    f as (select doc_id, x, min(i) i from e group by 1, 2)
    select doc_id, count(*) n_distinct, md5(string_agg(x, ' ' order by i)) digest from f group by 1
    """,
)
def ordered_distinct_strings(t):
    values = X.ordered_distinct(F.split("text", " "), F.col("source"))
    return t.documents.select(
        "doc_id",
        F.size(values).cast("long").alias("n_distinct"),
        X.fingerprint(F.array_join(values, " ")).alias("digest"),
    )


@query("C46", "select doc_id, md5(text) digest from documents")
def fingerprint(t):
    return t.documents.select("doc_id", X.fingerprint(F.col("text")).alias("digest"))


@query(
    "C47 X3",
    """
    with l as (
      select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no
      from documents),
    p as (select doc_id, line_no, lower(line) line, string_split(lower(line), 'the') parts from l where contains(lower(line), 'the')),
    s as (select doc_id, line_no, unnest(range(1, len(parts))) k, parts from p)
    select doc_id, line_no, cast(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 3 * (k - 1) as integer) start_col,
      cast(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 3 * k as integer) end_col
    from s
    """,
)
def find_all(t):
    lines = t.documents.select("doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hits = lines.filter(F.col("line").ilike("%the%") | ~F.col("line").rlike(U.ASCII_ONLY))
    spans = hits.select("doc_id", "line_no", F.explode(U.folded_spans(F.col("line"), "THE")).alias("s"))
    return spans.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("s.start").alias("start_col"), F.col("s.end").alias("end_col")
    )


@query(
    "C48",
    """
    select p_partkey, unnest(string_split(p_name, ' ')) code, unnest(string_split(upper(p_name), ' ')) label from part
    """,
)
def genre_pairs(t):
    pairs = X.strict_pairs(F.split("p_name", " "), F.split(F.upper("p_name"), " "))
    return t.part.select("p_partkey", F.explode(pairs).alias("p")).select(
        "p_partkey", F.col("p.a").alias("code"), F.col("p.b").alias("label")
    )
