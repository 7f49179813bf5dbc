import random
import itertools

import pytest
from pyspark.sql import functions as F

from larkspan.functions.similarity import similarity, similarity_from
from larkspan.functions import dates as D
from larkspan.functions import headings as H
from larkspan.functions import measures as M
from larkspan.functions import progress as P
from larkspan.functions import scene as S
from larkspan.functions import similarity as Y
from larkspan.functions import text as X
from larkspan.functions import transcripts as R
from larkspan.functions import unicode as U
from larkspan.functions import urls as L


def values(spark, column, rows, schema="x string"):
    """The expression over each row, in row order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


x = None  # the column under test, made once the session is there


@pytest.fixture(autouse=True)
def column_x(spark):
    global x
    x = F.col("x")


def test_norm_and_fold(spark):
    rows = [None, "　a　b ", " x\n", "ＡＢＣ", "Straße ", "ﬁn", "ｶﾞ"]
    assert values(spark, X.norm_text(x), rows) == ["", "a b", "x", "ＡＢＣ", "Straße", "ﬁn", "ｶﾞ"]
    assert values(spark, X.fold_text(x), rows) == ["", "a b", "x", "abc", "strasse", "fin", "ガ"]
    assert values(spark, X.squash(x), rows) == ["", "ab", "x", "ABC", "Straße", "fin", "ガ"]


def test_truncate_bytes_keeps_characters(spark):
    texts = ["", "abc", "é" * 5, "a日本語b", "😀😀a", "日" * 90]
    for n in (1, 2, 3, 4, 5, 7, 255):
        want = [t.encode()[:n].decode(errors="ignore") for t in texts]
        assert values(spark, X.truncate_bytes(x, n), texts) == want


def test_safe_name(spark):
    rows = ["a/b:c*?", "CON", "nul.txt", "com1.a.b", "console", " . ", "x. .", "a\tb\x7f", "日" * 100, None]
    want = ["a_b_c__", "CON_", "nul_.txt", "com1_.a.b", "console", "unknown", "x", "a_b_", "日" * 85, "unknown"]
    assert values(spark, X.safe_name(x), rows) == want
    assert values(spark, X.safe_name(x, strict=False), ["CON", "a\tb", ""]) == ["CON", "a\tb", "unknown"]
    assert values(spark, X.part_title(x), ['a "b" c', "", "x" * 50]) == ["a_b_c", "untitled", "x" * 40]
    assert values(spark, X.capture_title(x), ["__a::b__", "\n"]) == ["a_b", "book"]


def test_titles_and_keys(spark):
    pairs = [("S", "C"), ("S", "S"), ("S", ""), ("", "C"), (None, None)]
    assert values(spark, X.display_title(F.col("a"), F.col("b")), pairs, "a string, b string") == ["[S] C", "S", "S", "C", "(無題)"]
    assert values(spark, X.title_budget(x), ["", "日" * 10, "a" * 300]) == [205, 175, 30]
    assert values(spark, X.display_width(x), ["abc", "日本", "Ａa", ""]) == [3, 4, 3, 0]
    split = X.split_key(x)
    assert values(spark, F.concat_ws("|", split["head"], split["tail"]), ["a_b_c", "_b", "ab"]) == ["a|b_c", "|b", ""]
    rows = [(" id ", "20240101", "t"), ("", "20240101", "t"), (None, None, None)]
    assert values(spark, X.event_key(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string") == ["id", "20240101:t", ":"]


def test_natural_key_orders_numbers(spark):
    names = ["p10", "p9", "P1", "p1a", "10", "9", "p01"]
    got = values(spark, X.natural_key(x), names)
    ordered = [n for _, n in sorted(zip(got, names))]
    assert ordered == ["9", "10", "P1", "p01", "p1a", "p9", "p10"]


def test_unescape_reads_from_the_left(spark):
    assert values(spark, X.unescape(x), [r"a\nb", r"a\\nb", r"\t\r\\", None]) == ["a\nb", r"a\nb", "\t\r\\", ""]


DAYS = [
    ("20240229", "2024-02-29"), ("20240230", None), ("2024年2月9日", "2024-02-09"), ("2024年2月9日(金)放送", "2024-02-09"),
    ("2024-2-9", "2024-02-09"), ("2024/02/09(金)", "2024-02-09"), ("第1回 2024年12月1日 夜", "2024-12-01"), ("soon", None), ("", None), (None, None),
]


def test_parse_day(spark):
    got = values(spark, D.parse_day(x).cast("string"), [d for d, _ in DAYS])
    assert got == [want for _, want in DAYS]


def test_format_days(spark):
    rows = [("x", "2024-01-31T20:00:00Z"), ("x", "2024-01-31T20:00:00+09:00"), ("20240101", None), ("soon放送", "bad"), ("", None)]
    got = values(spark, D.format_onair(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got == ["2024-02-01(木)", "2024-01-31(水)", "2024-01-01(月)", "soon", "----------(-)"]
    rows = ["20240101", "20240101T09", "2024010112", "2024-01-01"]
    assert values(spark, D.format_event_date(x), rows) == ["2024-01-01(月)", "2024-01-01(月)", "2024-01-01(月)", "2024-01-01(月)"]


def test_local_time_at_the_day_boundary(spark):
    rows = [0, 15 * 3600 - 1, 15 * 3600, None]
    assert values(spark, D.local_time(x), rows, "x long") == ["09:00", "23:59", "00:00", ""]
    assert values(spark, D.local_date(x), rows, "x long") == ["19700101", "19700101", "19700102", ""]


def test_durations_round_trip(spark):
    rows = ["0", "-5", "59", "60", "3599", "3600", "3725.9", "bad", None, "400000"]
    words = values(spark, D.format_duration(x), rows)
    assert words == ["", "", "59秒", "1分0秒", "59分59秒", "1時間0分0秒", "1時間2分5秒", "", "", "111時間6分40秒"]
    assert values(spark, D.format_duration_clock(x), rows[:7]) == ["", "", "--:--:59", "--:01:00", "--:59:59", "01:00:00", "01:02:05"]
    back = values(spark, D.sort_duration(x)["seconds"], ["59秒", "1時間2分5秒", "0秒", "x", ""])
    assert back == [59, 3725, 0, 0, 0]


def test_progress(spark):
    rows = ["[download]  12.5% of 3MiB ETA 00:07", "[download] 100% of 3MiB", "[ExtractAudio] x", "[download] Destination: a", " "]
    p = P.parse_progress(x)
    got = values(spark, F.struct(p["percent"], p["eta"]), rows)
    assert [tuple(g) for g in got] == [(12.5, "00:07"), (100.0, None), (100.0, None), (None, None), (None, None)]
    nums = [None, -3.0, 0.04, 49.97, 49.94, 12.3, 100.0, 250.0]
    want = ["--%"] + [
        (f"{round(c)}%" if abs(c - round(c)) < 0.05 else f"{c:.1f}%") for c in (min(max(v, 0.0), 100.0) for v in nums[1:])
    ]
    assert values(spark, P.format_percent(x), nums, "x double") == want
    assert values(spark, P.error_reason(x), ["ERROR: no", "ERROR:", "ok"]) == ["no", "ERROR:", None]


def test_headings(spark):
    rows = ["第１章Start", "第5章では、", "Chapter 3 Go", "Chapter 3Go", "PART  2", "Preface", "はじめに ", "Indexes", "x"]
    got = values(spark, H.heading_of(U.nfkc(x)), rows)
    assert got == ["第1章", None, "Chapter 3", None, "PART  2", "Preface", "はじめに", None, None]
    assert values(spark, H.heading_key(x), ["第1章", "CHAPTER 1", "Index"]) == ["1", "1", "index"]
    row = H.contents_row(x)
    lines = ["Chapter 1 A .... 12", "第1章 始め……３", "B   7 ", "C 7", "....   9", "Index  0"]
    got = values(spark, F.concat_ws("|", row["title"], row["printed_page"].cast("string"), row["is_chapter"].cast("string")), lines)
    assert got == ["Chapter 1 A|12|true", "第1章 始め|3|true", "B|7|false", "", "", ""]


def test_similarity(spark):
    import difflib

    pairs = [("abc", "abd"), ("", ""), ("abcdef", ""), ("chapter one", "one chapter")]
    got = values(spark, Y.similarity(F.col("a"), F.col("b"), "blocks"), pairs, "a string, b string")
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert values(spark, Y.similarity(F.col("a"), F.col("b")), pairs[:3], "a string, b string") == [pytest.approx(2 / 3), 1.0, 0.0]


def test_validate_text(spark):
    rows = ["", "  ", "hello there", "こんにちは", "あああああ", "ああああああ", "日本日本日本です", "abc日", "12345"]
    got = values(spark, R.validate_text(x), rows)
    assert got == ["empty", "empty", "language", "valid", "valid", "loop", "loop", "valid", "language"]


def loop_by_hand(s):
    for n in range(1, min(15, len(s) // 3) + 1):
        if len(s) >= 6 and s[: 3 * n] == s[:n] * 3:
            return s[:n]
    return None


def test_repeat_loop_matches_by_hand(spark):
    words = ["".join(p) for n in (5, 6, 7, 9) for p in itertools.islice(itertools.product("ab", repeat=n), 64)]
    assert values(spark, R.repeat_loop(x), words) == [loop_by_hand(w) for w in words]


def broken_by_hand(text, width=40):
    lines, line = [], ""
    for c in text:
        line += c
        if c in "。？！" or (len(line) >= width and c == " "):
            lines.append(line + "\n")
            line = ""
    return "".join(lines) + line


def test_break_lines_matches_by_hand(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  。\n") if rng.random() < 0.3 else "x" for _ in range(300)) for _ in range(30)]
    assert values(spark, R.break_lines(x), texts) == [broken_by_hand(t) for t in texts]


def test_refine_text(spark):
    rows = ["えーと今日です", "AじゃなくてB", "行きますそして帰ります", " "]
    assert values(spark, R.refine_text(x), rows) == ["今日です。", "B。", "行きます。そして帰ります。", ""]
    assert values(spark, R.refine_text(x, "light"), ["a ", "a。"]) == ["a。", "a。"]
    assert values(spark, R.strip_boilerplate(x), ["(音楽) hi Thank you for watching"]) == ["hi"]
    assert values(spark, R.mask_message(x), ["took 1.5 s for 3 in /tmp/a b"]) == ["took N.N s for N in PATH b"]


def test_measures(spark):
    samples = F.array(*[F.lit(float(v)) for v in range(8)])
    assert values(spark, M.mix_down(samples, 2), ["a"]) == [[0.5, 2.5, 4.5, 6.5]]
    assert values(spark, M.resample_nearest(M.mix_down(samples, 2), 32000), ["a"]) == [[0.5, 4.5]]
    assert values(spark, M.rms(F.array().cast("array<double>")), ["a"]) == [0.0]
    square = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (5, 0), (5, 5), (0, 5))])
    assert values(spark, M.quad_area_ratio(square, F.lit(10.0), F.lit(10.0)), ["a"]) == [0.25]


def test_urls(spark):
    rows = {
        "http://127.0.0.1/": False, "https://10.2.3.4:80/x": False, "http://172.15.0.1": True, "http://172.16.0.1": False,
        "http://[::1]/": False, "http://[::ffff:a00:1]/": False, "http://[::ffff:808:808]/": True, "ftp://example.org": False,
        "http://fd.example.org/": True, "http://x.local/": False, "nonsense": False, "http://8.8.8.8/": True,
    }
    assert values(spark, L.url_is_public(x), list(rows)) == list(rows.values())
    assert values(spark, L.normal_path(x), ["/a/./b/../c", "/../../a", "//a//b/"]) == ["/a/c", "/a", "/a/b"]
    assert values(spark, L.path_within(x, "/s"), ["/s/a", "/s", "/sx/a", "/s/../t"]) == [True, True, False, False]


def test_style_props(spark):
    rows = ["stroke=dashed;fill=hachure;round;w=3;font=mono;align=center", "w4,w=0 sharp", "solid=fill arrows=both opacity=x", None]
    got = values(spark, S.style_props(x), rows)
    assert got[0] == {"stroke_style": "dashed", "fill_style": "hachure", "roundness": "round", "stroke_width": "3", "font": "3", "align": "center"}
    assert got[1] == {"stroke_width": "4", "roundness": "sharp"}
    assert got[2] == {"fill_style": "solid", "arrows": "both"}
    assert got[3] == {}
    c = S.resolve_color(x)
    assert values(spark, F.concat_ws(",", c["fill"], c["stroke"]), ["Red", "#fff", "#123456", "??"]) == [
        "#ffc9c9,#ef4444", "#ffffff,#1e1e1e", "#123456,#123456", "#a5d8ff,#4a9eed",
    ]


def test_find_spans_in_folded_text(spark):
    got = values(spark, U.folded_spans(x, "ss"), ["Straße und SSss", "ｓｓ", None])
    assert [[tuple(s) for s in row] for row in got] == [[(4, 5), (11, 13), (13, 15)], [(0, 2)], []]


def test_banded_similarity_is_the_same_from_its_floor(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcé章") for _ in range(rng.randrange(0, 14)))
    pairs = [(word(), word()) for _ in range(150)] + [("chapter one", "chapter on"), ("", ""), (None, "a"), ("a" * 10, "a" * 5 + "b" * 5)]
    for floor in (0.5, 0.6, 0.8):
        cols = [similarity(F.col("a"), F.col("b")).alias("x"), similarity_from(F.col("a"), F.col("b"), floor).alias("y")]
        for r in spark.createDataFrame(pairs, "a string, b string").select(*cols).collect():
            assert r.y == (r.x if r.x is None or r.x >= floor else 0.0)


def test_style_props_query_reads_each_text_once(spark, data, capsys):
    from larkspan.registry import Tables, load_all

    load_all()["style_props"].run(Tables(spark, data)).explain()
    assert "HashAggregate(keys=[raw" in capsys.readouterr().out


def test_nfkc_of_lists_holds_few_python_strings(spark):
    import tracemalloc

    import pyarrow as pa

    rows = [["ﬁ", "a", None], None, [], ["Ａ"]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>").select("i", U.nfkc_each(F.col("t")).alias("t"))
    assert [r.t for r in sorted(got.collect())] == [["fi", "a", None], None, [], ["A"]]
    lists = pa.array([["é" * 1000] * 10] * 2000)
    assert U.nfkc_lists(lists.slice(1, 3)).to_pylist() == [["é" * 1000] * 10] * 3
    tracemalloc.start()
    U.nfkc_lists(lists)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
