"""Readers and writers of JSON, CSV and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions.text import strip
from larkspan.plans.once import once

# The field names of a feed.
FEED_FIELDS = (
    "series_site_id", "id", "corner_site_id", "title", "corner_name", "thumbnail_url", "onair_date", "started_at", "genre_label", "url",
)
FEED_ROW = T.StructType([T.StructField(n, T.StringType()) for n in FEED_FIELDS])
TERM_ROW = T.StructType(
    [
        T.StructField("reading", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("is_enabled", T.BooleanType()),
    ]
)
NUMBER_TYPES = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


# -- feeds -----------------------------------------------------------------------------


def good_elements(array: Column, row: T.DataType, name: str = "item") -> Column:
    """An array of structs (pos, item) of those elements of a variant array that have the type `row`.

    Every element is taken by itself, so one bad element costs neither the document nor its neighbours. Positions
    are those of the document.
    """
    elements = F.try_variant_get(array, "$", "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    if isinstance(row, T.StructType):
        fits = lambda v: F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))
        text = lambda v, n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.to_json(F.try_variant_get(v, f"$.{n}", "variant")))
        field = lambda v, f: text(v, f.name) if isinstance(f.dataType, T.StringType) else F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString())
        made = lambda v: F.struct(*[field(v, f).alias(f.name) for f in row.fields])
    else:
        fits = lambda v: F.try_variant_get(v, "$", row.simpleString()).isNotNull()
        made = lambda v: F.try_variant_get(v, "$", row.simpleString())
    numbered = F.transform(elements, lambda v, i: F.struct(i.alias("pos"), v.alias("v")))
    return F.transform(F.filter(numbered, lambda e: fits(e["v"])), lambda e: F.struct(e["pos"].alias("pos"), made(e["v"]).alias(name)))


def parse_feed(df: DataFrame, document: str, root: str, row: T.StructType = FEED_ROW) -> DataFrame:
    """One row per object in the array field `root`, with its position in the document.

    A document that is no object gives one row with `failed` set and a null item; elements that are no objects are
    left out.
    """
    v = F.try_parse_json(F.col(document))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = good_elements(F.try_variant_get(v, f"$.{root}", "variant"), row)
    parsed = df.withColumn("failed", ~is_object).withColumn("_items", F.when(is_object, found))
    kept = parsed.filter(F.col("failed") | (F.size("_items") > 0))
    rows = kept.select(*[c for c in df.columns if c != document], "failed", F.explode_outer("_items").alias("_e"))
    return rows.select(*[c for c in rows.columns if c != "_e"], "_e.pos", "_e.item")


def read_feed(spark: SparkSession, path: str, root: str, row: T.StructType = FEED_ROW) -> DataFrame:
    """`parse_feed` over a folder of JSON documents."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("doc"))
    return parse_feed(docs, "doc", root, row)


# -- documents with a version and an age ---------------------------------------------------


def parse_ttl_docs(df: DataFrame, document: str, now: Column, ttl: float, version: int, item: T.DataType, items="items"):
    """Add `hit` and the parsed `items` of cached documents.

    A hit has the version, a numeric (not boolean) `fetched_at`, an array of items, and an age up to `ttl`.
    """
    v = F.col("_parsed")
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = F.schema_of_variant(part("fetched_at"))
    numeric = kind.isin(*NUMBER_TYPES) | kind.startswith("DECIMAL")
    is_list = F.schema_of_variant(part(items)).startswith("ARRAY")
    fetched = F.when(numeric, F.try_variant_get(v, "$.fetched_at", "double"))
    same = F.try_variant_get(v, "$.schema_version", "int") == version
    parsed = once(df, _parsed=F.try_parse_json(F.col(document)))  # once, not for each of its fields
    dated = once(parsed, fetched_at=fetched, _sound=same & is_list)
    hit = F.coalesce(F.col("_sound") & (now - F.col("fetched_at") <= ttl), F.lit(False))
    return dated.withColumn("hit", hit).withColumn("items", F.when(F.col("hit"), good_elements(part(items), item))).drop("_parsed", "_sound")


def read_ttl_docs(df: DataFrame, document: str, now: Column, ttl: float, version: int, item: T.DataType) -> DataFrame:
    """The good items of fresh documents, one row each, with their position in the document."""
    hits = parse_ttl_docs(df, document, now, ttl, version, item).filter("hit")
    return hits.select(*[c for c in df.columns if c != document], F.explode("items").alias("_e")).select(
        *[c for c in df.columns if c != document], "_e.pos", "_e.item"
    )


def write_docs(df: DataFrame, path: str, version: int, fmt: str = "parquet") -> None:
    """Replace the documents at `path` with a version stamp; the commit protocol makes it all or nothing."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").format(fmt).save(path)


# -- manifests -----------------------------------------------------------------------------


def parse_manifests(df: DataFrame, document: str, item: list[str], rank: str, folder: str) -> DataFrame:
    """Saved path per (item, key): later manifests overwrite earlier ones; malformed ones are skipped.

    A relative path of a later manifest (rank > 0) is taken from the folder of that manifest.
    """
    schema = T.StructType([T.StructField("paths", T.MapType(T.StringType(), T.StringType()))])
    entries = df.select(*item, rank, folder, F.explode(F.from_json(document, schema)["paths"]).alias("key", "raw"))
    path = F.when(
        (F.col(rank) > 0) & ~F.col("raw").startswith("/"), F.concat(F.col(folder), F.lit("/"), F.col("raw"))
    ).otherwise(F.col("raw"))
    return entries.groupBy(*item, "key").agg(F.max_by(path, F.col(rank)).alias("path"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents below a folder, with the folder of each."""
    docs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return docs.select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder"), F.col("value").alias("doc"))


# -- term dictionaries -----------------------------------------------------------------------


def read_terms_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows `reading,target,isEnabled`; rows with fewer than two fields are dropped, a missing flag is true."""
    raw = spark.read.csv(
        path, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=True,
        schema="reading string, target string, flag string",
    )
    return raw.filter("reading is not null and target is not null").select(
        "reading", "target", (F.lower(F.trim(F.coalesce("flag", F.lit("true")))) == "true").alias("is_enabled")
    )


def write_terms_csv(df: DataFrame, path: str) -> None:
    out = df.select("reading", "target", F.col("is_enabled").cast("string").alias("isEnabled"))
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_terms_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Terms as one object a line, as they are written; without `lines` a file is one array of objects."""
    raw = spark.read.json(path, multiLine=not lines, schema="reading string, target string, isEnabled boolean")
    return raw.select("reading", "target", F.coalesce("isEnabled", F.lit(True)).alias("is_enabled"))


def write_terms_json(df: DataFrame, path: str) -> None:
    df.select("reading", "target", F.col("is_enabled").alias("isEnabled")).write.mode("overwrite").json(path)


# -- lines and timings -------------------------------------------------------------------------


def to_lines(df: DataFrame, text: str, keep_blank: bool = False) -> DataFrame:
    """One row per line with its 0-based number; blank lines only when asked for."""
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows if keep_blank else rows.filter(strip(F.col("line")) != "")


def parse_timings(df: DataFrame, document: str) -> DataFrame:
    """One row per (group, page) of documents that map a page to its seconds."""
    return df.select(
        *[c for c in df.columns if c != document],
        F.explode(F.from_json(document, T.MapType(T.StringType(), T.DoubleType()))).alias("page", "seconds"),
    )


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """`<engine>/timings.json` files below a folder."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "timings.json").text(
        path, wholetext=True
    )
    engine = F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1)
    return parse_timings(docs.select(engine.alias("engine"), F.col("value").alias("doc")), "doc")


# -- files -------------------------------------------------------------------------------------


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with size and time; the content column is never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(
        "path",
        name.alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"),
    )


# -- reports -----------------------------------------------------------------------------------


def report_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json) with all other columns nested in one document."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("report"))


def write_report_json(df: DataFrame, key: str, path: str) -> None:
    report_json(df, key).select("report").write.mode("overwrite").text(path)


def markdown_rows(df: DataFrame, cells: dict[str, Column], order: list[str], total: dict[str, Column]) -> DataFrame:
    """Markdown lines of a table: heading, rule, one line per row, and a total row.

    The lines stay rows (`band`, the order columns, `line`), so the table never is one string in one task;
    sort by them to write the text.
    """
    spark_row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells.values()), F.lit(" |"))
    body = df.select(F.lit(1).alias("band"), *order, spark_row.alias("line"))
    foot = F.concat(F.lit("| "), F.concat_ws(" | ", *total.values()), F.lit(" |"))
    sums = df.agg(foot.alias("line"))
    heads = F.array(
        F.lit("| " + " | ".join(cells) + " |"),
        F.lit("|" + "---|" * len(cells)),
    )
    empty = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    top = df.sparkSession.range(1).select(F.posexplode(heads).alias("i", "line"))
    return (
        body.unionByName(top.select((F.col("i") - 1).alias("band"), *empty, "line"))
        .unionByName(sums.select(F.lit(2).alias("band"), *empty, "line"))
    )


