import random
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.operators import catalog as O
from larkspan.operators import filters as FI
from larkspan.operators import quality as Q
from larkspan.operators import terms as TM
from larkspan.sources import documents as S


def test_terms_csv_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([("えー", "", True), ('say "hi"', "a,b", False), ("two\nlines", "x", True)], "reading string, target string, is_enabled boolean")
    path = str(tmp_path / "terms")
    S.write_terms_csv(terms.filter("target <> ''"), path)
    got = {tuple(r) for r in S.read_terms_csv(spark, path).collect()}
    assert got == {('say "hi"', "a,b", False), ("two\nlines", "x", True)}
    (tmp_path / "hand.csv").write_text("reading,target,isEnabled\na,b\nlonely\nc,d,false\n")
    got = {tuple(r) for r in S.read_terms_csv(spark, str(tmp_path / "hand.csv")).collect()}
    assert got == {("a", "b", True), ("c", "d", False)}


def test_terms_json_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([("a", "b", True), ("c", "d", False)], "reading string, target string, is_enabled boolean")
    S.write_terms_json(terms, str(tmp_path / "t"))
    assert {tuple(r) for r in S.read_terms_json(spark, str(tmp_path / "t")).collect()} == {("a", "b", True), ("c", "d", False)}
    S.write_terms_json(terms.coalesce(1), str(tmp_path / "one"))
    assert S.read_terms_json(spark, str(tmp_path / "one")).count() == 2
    (tmp_path / "array.json").write_text('[{"reading":"a","target":"b"},\n{"reading":"c","target":"d","isEnabled":false}]')
    assert {tuple(r) for r in S.read_terms_json(spark, str(tmp_path / "array.json"), lines=False).collect()} == {("a", "b", True), ("c", "d", False)}


def test_write_docs_replaces_all(spark, tmp_path):
    path = str(tmp_path / "docs")
    S.write_docs(spark.range(5), path, 1)
    S.write_docs(spark.range(2), path, 2)
    got = spark.read.parquet(path)
    assert got.count() == 2 and {r.schema_version for r in got.collect()} == {2}


def test_ttl_documents(spark):
    docs = {
        "fresh": '{"schema_version":1,"fetched_at":100.5,"items":[1,2]}', "whole": '{"schema_version":1,"fetched_at":100,"items":[3]}',
        "old": '{"schema_version":1,"fetched_at":10,"items":[1]}', "bool": '{"schema_version":1,"fetched_at":true,"items":[1]}',
        "text": '{"schema_version":1,"fetched_at":"100","items":[1]}', "version": '{"schema_version":2,"fetched_at":100,"items":[1]}',
        "list": "[1]", "broken": "{", "no list": '{"schema_version":1,"fetched_at":100,"items":{"a":1}}', "empty": '{"schema_version":1,"fetched_at":100,"items":[]}',
    }
    df = spark.createDataFrame(list(docs.items()), "name string, doc string")
    got = S.parse_ttl_docs(df, "doc", F.lit(120), 60, 1, T.LongType()).collect()
    assert {r.name for r in got if r.hit} == {"fresh", "whole", "empty"}
    assert {(r.name, r["item"]) for r in S.read_ttl_docs(df, "doc", F.lit(120), 60, 1, T.LongType()).collect()} == {("fresh", 1), ("fresh", 2), ("whole", 3)}
    row = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    mixed = spark.createDataFrame([('{"schema_version":1,"fetched_at":100,"items":[{"id":"a","n":"x"},3,null,{"id":7}]}',)], "doc string")
    rows = S.read_ttl_docs(mixed, "doc", F.lit(120), 60, 1, row).collect()
    assert [(r.pos, r["item"].id, r["item"].n) for r in rows] == [(0, "a", None), (3, "7", None)]


def test_feed_and_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"corners":[{"title":"t","extra":1},{"id":"2"}]}')
    (tmp_path / "b.json").write_text("[1]")
    rows = S.read_feed(spark, str(tmp_path), "corners").collect()
    assert sorted((r.failed, r.pos, r["item"].title if r["item"] else None) for r in rows if not r.failed) == [(False, 0, "t"), (False, 1, None)]
    assert [r["item"] for r in rows if r.failed] == [None]
    docs = [("i", 0, "/p", '{"paths":{"k":"a","j":"b"}}'), ("i", 1, "/old", '{"paths":{"k":"c","m":"/abs"}}'), ("i", 2, "/x", "[]")]
    df = spark.createDataFrame(docs, "item string, rank int, folder string, doc string")
    got = {r.key: r.path for r in S.parse_manifests(df, "doc", ["item"], "rank", "folder").collect()}
    assert got == {"k": "/old/c", "j": "b", "m": "/abs"}


def test_timings_and_files(spark, tmp_path):
    for engine, text in (("x", '{"p1":1.0,"p2":3.0}'), ("y", '{"p1":2.0}')):
        (tmp_path / engine).mkdir()
        (tmp_path / engine / "timings.json").write_text(text)
    t = S.read_timings(spark, str(tmp_path)).groupBy("engine").agg(F.avg("seconds").alias("m")).collect()
    assert {r.engine: r.m for r in t} == {"x": 2.0, "y": 2.0}
    files = S.list_files(spark, str(tmp_path)).collect()
    assert {(r.name, r.suffix) for r in files} == {("timings.json", ".json")} and sum(r.size for r in files) == 29
    assert "content" not in S.list_files(spark, str(tmp_path)).columns


def test_report_and_table(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 3)], "m string, n int")
    S.write_report_json(df, "m", str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"n":2}', '{"n":3}']
    lines = S.markdown_rows(df, {"m": F.col("m"), "n": F.col("n").cast("string")}, ["m"], {"m": F.lit("sum"), "n": F.sum("n").cast("string")})
    assert [r.line for r in lines.orderBy("band", "m").collect()] == ["| m | n |", "|---|---|", "| a | 2 |", "| b | 3 |", "| sum | 5 |"]


def test_terms_are_applied_longest_first_over_several_chunks(spark):
    docs = spark.createDataFrame([(1, "abc ab a zz")], "i int, text string")
    terms = spark.createDataFrame([("a", "1", True), ("ab", "2", True), ("abc", "3", True), ("z", "!", False)], "reading string, target string, is_enabled boolean")
    for chunk in (1, 2, 100):
        assert TM.apply_terms(docs, "text", terms, chunk).first().text == "3 2 1 zz"


def test_terms_that_make_others_occur(spark):
    """Equal to replacing term by term, also where a target makes a later reading occur or repeats its own."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(1, n)))
    data = [(word(4), rng.choice([word(4), "", word(3)])) for _ in range(40)] + [("ab", "ab"), ("a", "aa"), ("a", "b"), ("zz" * 40, "x")]
    texts = ["".join(rng.choice("abécd") for _ in range(n)) for n in (0, 1, 3, 30, 400, 5000)] + [None, "zz" * 90]
    terms = spark.createDataFrame([(r, t, True) for r, t in data] + [("b", "off", False), ("", "all", True), ("c", None, True)], "reading string, target string, is_enabled boolean")
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    order = sorted(set(data), key=lambda x: (-len(x[0]), x))
    for chunk in (7, 50_000):
        got = {r.i: r.text for r in TM.apply_terms(docs, "text", terms, chunk).collect()}
        for i, text in enumerate(texts):
            for reading, target in order if text is not None else []:
                text = text.replace(reading, target)
            assert got[i] == text



def test_merge_feeds(spark):
    rows = [("k", 0, 0, "first", None, ""), ("k", 0, 1, "second", "b", "B"), ("k", 1, 0, "third", "a", "A"), ("k", 1, 5, "x", "b", "B2"), ("m", 1, 1, "m", None, None)]
    df = spark.createDataFrame(rows, "k string, f int, o int, title string, cat string, lab string")
    got = {r.k: r for r in O.merge_feeds(df, ["k"], ["f", "o"], ["title"], "cat", "lab").collect()}
    assert (got["k"].title, got["k"].category, got["k"].categories, got["k"].labels) == ("first", "b", ["b", "a"], ["B", "A", "B2"])
    assert (got["m"].category, got["m"].categories, got["m"].labels) == (None, [], [])
    again = O.merge_feeds(df.unionByName(df), ["k"], ["f", "o"], ["title"], "cat", "lab").orderBy("k").collect()
    assert [tuple(r) for r in again] == [tuple(got[k]) for k in ("k", "m")]


def test_facets_keep_zero_rows(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "c array<string>")
    dim = spark.createDataFrame([("a", 0), ("b", 1), ("z", 2), ("none", 3)], "category string, rank int")
    assert {r.category: r.n for r in O.facet_counts(df, "c", dim).collect()} == {"a": 2, "b": 1, "z": 0, "none": 2}
    assert {r.category: r.n for r in O.facet_counts(df, "c", zero=False).collect()} == {"a": 2, "b": 1}


def test_sorting_ties_and_locale(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "a")], "pos int, t string")
    at = lambda **kw: [r.pos for r in O.sort_by(df, [F.col("t")], "pos", **kw).collect()]
    assert at() == [1, 3, 0, 2]
    assert at(reverse=True) == [2, 0, 3, 1]
    assert at(reverse=True, stable=True) == [0, 2, 1, 3]
    words = spark.createDataFrame([("い",), ("ア",), ("あ",), ("b",), ("A",)], "w string")
    assert [r.w for r in words.orderBy(F.collate("w", "ja")).collect()][:2] == ["A", "b"]


def test_filters(spark):
    df = spark.createDataFrame([("Ａbc", ["x"]), ("ABC", []), ("zz", ["Straße"])], "t string, l array<string>")
    assert FI.search_filter(df, " abc", [F.col("t")]).count() == 2
    assert FI.search_filter(df, "STRASSE", [F.col("t")], F.col("l")).count() == 1
    assert FI.keyword_filter(df, "abc", [F.col("t")]).count() == 0
    assert FI.keyword_filter(df, None, [F.col("t")]).count() == 3
    names = spark.createDataFrame([("a.MP3",), ("a.mp3.part",), (".downloaded.json",), ("a.mp3.bak",), ("a.mp4",)], "n string")
    assert [r.k for r in names.select(FI.classify_file(F.col("n")).alias("k")).collect()] == ["media", "temp", "manifest", "backup", "other"]


def test_gate_and_bbox(spark):
    flags = spark.createDataFrame([(1,), (0,), (0,)], "f int")
    assert Q.failure_gate(flags, F.col("f") == 1).first().passed is False
    try:
        Q.failure_gate(flags, F.col("f") == 1, strict=True).collect()
    except Exception as e:  # noqa: BLE001
        assert "too many failures" in str(e)
    else:
        raise AssertionError("the gate let it pass")
    pages = spark.createDataFrame([(["    ", "  ab ", "   c"],), (["  ", ""],)], "l array<string>")
    got = [tuple(r.b) for r in pages.select(Q.content_bbox(F.col("l")).alias("b")).collect()]
    assert got == [(2, 1, 3, 2), (0, 0, 1, 1)]
