import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import sequences as O
from larkspan.plans import ordered
from larkspan.plans.ordered import Running


def rows(seed, n=400):
    """One key holds most of the rows; the order has ties in its first column."""
    rng = random.Random(seed)
    out = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(60), i, rng.choice([None, 1, 2, 3, 5])) for i in range(n)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("backward", [False, True])
def test_running_matches_plain_fold(spark, levels, backward):
    data = rows(levels)
    df = spark.createDataFrame(data, "k string, t int, i int, v int")
    t = F.col("t")
    piece = {1: F.floor(t / 7), 2: [F.floor(t / 20), F.floor(t / 3)], 3: [F.floor(t / 30), F.floor(t / 10), t]}[levels]
    spec = {
        "s": Running(F.col("v")), "before": Running(F.col("v"), "sum", inclusive=False),
        "hi": Running(F.col("v"), "max"), "lo": Running(F.col("v"), "min", inclusive=False), "seen": Running(F.col("v"), "last", inclusive=False),
    }
    got = {r.i: r for r in ordered.running(df, ["k"], ["t", "i"], piece, spec, backward).collect()}
    assert len(got) == len(data)
    for key in {d[0] for d in data}:
        total, hi, lo, last = 0, None, None, None
        for _, _, i, v in sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]), reverse=backward):
            r = got[i]
            assert (r.before or 0) == total and r.lo == lo and r.seen == last
            if v is not None:
                total, hi, lo, last = total + v, v if hi is None else max(hi, v), v if lo is None else min(lo, v), v
            assert (r.s or 0) == total and r.hi == hi


def test_global_positions(spark):
    data = rows(9)
    df = spark.createDataFrame(data, "k string, t int, i int, v int")
    got = ordered.rank(df, ["t", "i"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, len(data) + 1))
    assert [(r.t, r.i) for r in got] == sorted((d[1], d[2]) for d in data)


def test_neighbours(spark):
    df = spark.createDataFrame([("a", i, None if i == 3 else i * 10) for i in range(6)], "k string, t int, v int")
    prev = ordered.previous(df, ["k"], ["t"], F.floor(F.col("t") / 2), {"p": "v"}).orderBy("t").collect()
    assert [r.p for r in prev] == [None, 0, 10, 20, None, 40]
    nxt = ordered.following(df, ["k"], ["t"], F.floor(F.col("t") / 2), {"n": "v"}).orderBy("t").collect()
    assert [r.n for r in nxt] == [10, 20, None, 40, 50, None]


def capture_by_hand(seq, history, stop, cap):
    kept, recent, same = [], [], 0
    for i, v in seq:
        if same >= stop or len(kept) >= cap:
            break
        if v in recent:
            same += 1
        else:
            same, recent = 0, (recent + [v])[-history:]
            kept.append((i, v))
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_captures_match_by_hand(spark, seed):
    rng = random.Random(seed)
    data = [(u, i, rng.choice("abcdefgh"[: 3 + 2 * seed])) for u in ("x", "y") for i in range(80 if u == "x" else 15)]
    df = spark.createDataFrame(data, "u string, i int, v string")
    piece = F.floor(F.col("i") / 8)
    got = O.drop_recent_repeats(df, "u", ["i"], piece, "v", max_pages=12, history=2).collect()
    plain = O.drop_repeats(df, ["u"], ["i"], piece, "v").collect()
    for u in ("x", "y"):
        seq = [(i, v) for w, i, v in data if w == u]
        assert sorted((r.i, r.v) for r in got if r.u == u) == capture_by_hand(seq, 2, 3, 12)
        assert sorted((r.i, r.v) for r in plain if r.u == u) == adjacent_by_hand(seq)


def adjacent_by_hand(seq, stop=3):
    kept, last, same = [], object(), 0
    for i, v in seq:
        if v == last:
            same += 1
            if same >= stop:
                break
        else:
            same = 0
            kept.append((i, v))
        last = v
    return kept


def test_recent_distinct_keeps_newest_spelling(spark):
    data = [("u", 1, "Music"), ("u", 2, "news"), ("u", 3, "ＭＵＳＩＣ"), ("u", 4, " "), ("u", 5, "x")]
    df = spark.createDataFrame(data, "u string, t int, w string")
    got = O.recent_distinct(df, "u", "w", ["t"], limit=2).orderBy("rank").collect()
    assert [(r.term, r["rank"]) for r in got] == [("x", 1), ("ＭＵＳＩＣ", 2)]


def test_input_is_read_once(spark, tmp_path):
    """The rows are sorted into pieces once; totals and neighbours come from what that wrote."""
    spark.range(50).selectExpr("id % 3 as k", "id as t", "cast(id / 4 as int) as v").write.parquet(f"{tmp_path}/input")
    rows = spark.read.parquet(f"{tmp_path}/input")
    piece = [F.floor(F.col("t") / 20), F.floor(F.col("t") / 5)]
    for out in (ordered.running(rows, ["k"], ["t"], piece, {"s": Running(F.col("v"))}), O.run_positions(rows, ["k"], ["t"], piece, "v")):
        assert str(tmp_path) not in out._jdf.queryExecution().toString() and out.count() == 50


def test_quantiles_equal_the_exact_percentile(spark):
    """One group holds most rows, one value most of the rest; null and single values, a null key, no rows."""
    rng = random.Random(5)
    data = [("hot", rng.uniform(-5, 5)) for _ in range(3000)] + [("flat", 2.5)] * 500 + [("flat", 1.0), ("one", 7.0), ("none", None), (None, 1.0), (None, 4.0), ("hot", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    shares = {"lo": 0.0, "p50": 0.5, "p95": 0.95, "odd": 0.123, "hi": 1.0}
    got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", shares).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).collect() if r.p50 is not None}
    assert set(got) == set(want) and "none" not in got
    for k, r in want.items():
        assert [got[k][n] for n in shares] == pytest.approx([r[n] for n in shares])
    assert ordered.quantiles(df.limit(0), ["k"], "v", shares).count() == 0
    (whole,) = ordered.quantiles(df, [], "v", {"p": 0.5}).collect()
    assert whole.p == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
