import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import matching as M

AUDIO = (".mp3", ".m4a", ".aac", ".wav")


def safe(s):
    for c in '\\/:*?"<>|':
        s = s.replace(c, "_")
    return s.strip().rstrip(" .") or "unknown"


def exact_by_hand(event, name):
    """The predicate of a stored file, as one test per pair."""
    stem, dot, suffix = name.rpartition(".")
    if not dot or "." + suffix.lower() not in AUDIO or ".part" in name:
        return False
    if event["dates"] and not any(d in name for d in event["dates"]):
        return False
    if not any(i in safe(name) for i in event["item_titles"]):
        return False
    raw = (event["title"] or "").strip()
    if not raw:
        return True
    return any(stem == v or stem.endswith("_" + v) or f"_{v}." in name for v in {raw, safe(raw)})


def contains_by_hand(event, name):
    suffix = "." + name.rpartition(".")[2].lower()
    if suffix not in AUDIO or ".part" in name:
        return False
    if event["dates"] and not any(d in name for d in event["dates"]):
        return False
    return safe(event["title"] or "") in safe(name) and any(i in safe(name) for i in event["item_titles"])


def case(seed):
    rng = random.Random(seed)
    titles = ["No 1", "No 1 extra", "a_b", "x: y?", "v1.2", "Z", "ab", "_", "1"]
    days = ["20240101", "20240102", "20240103"]
    events, names = [], []
    for i in range(25):
        title = rng.choice(titles + ["", None])
        dates = rng.sample(days, rng.randrange(0, 3))
        events.append({"dir": rng.choice("pq"), "event_key": i, "item_titles": rng.choice([["Show"], ["Show", "Other"]]), "title": title, "dates": dates})
    for i in range(60):
        title = safe(rng.choice(titles))
        parts = [p for p in (rng.choice(days + ["", "7" + days[0]]), rng.choice(["Show", "Other", "Nope"]), title) if p]
        names.append((rng.choice("pq"), f"f{i}", "_".join(parts) + rng.choice([".mp3", ".M4A", ".mp4", ".mp3.part", ".x.mp3", ""])))
    return events, names


@pytest.mark.parametrize("mode,by_hand", [("exact", exact_by_hand), ("contains", contains_by_hand)])
@pytest.mark.parametrize("seed", range(6))
def test_match_files(spark, mode, by_hand, seed):
    events, names = case(seed)
    e = spark.createDataFrame(
        [(v["dir"], v["event_key"], v["item_titles"], v["title"], v["dates"]) for v in events],
        "dir string, event_key int, item_titles array<string>, title string, dates array<string>",
    )
    f = spark.createDataFrame(names, "dir string, path string, name string")
    got = {(r.event_key, r.path) for r in M.match_files(e, f, mode).collect()}
    want = {(v["event_key"], p) for v in events for d, p, n in names if d == v["dir"] and by_hand(v, n)}
    assert got == want


@pytest.mark.parametrize("mode,by_hand", [("exact", exact_by_hand), ("contains", contains_by_hand)])
def test_match_files_meets_few_events_without_titles(spark, mode, by_hand, capsys):
    events, names = case(3)
    e = spark.createDataFrame(
        [(v["dir"], v["event_key"], v["item_titles"], v["title"], v["dates"]) for v in events],
        "dir string, event_key int, item_titles array<string>, title string, dates array<string>",
    )
    f = spark.createDataFrame(names, "dir string, path string, name string")
    want = {(v["event_key"], p) for v in events for d, p, n in names if d == v["dir"] and by_hand(v, n)}
    for few in (0, 4, 1000):
        found = M.match_files(e, f, mode, few=few)
        found.explain()
        assert ("_title_key" in capsys.readouterr().out) == (few < 1000)
        assert {(r.event_key, r.path) for r in found.collect()} == want


def test_two_dates(spark):
    df = spark.createDataFrame([("20240101", "2024-01-02(火)"), ("20240101", "2024-01-01(月)"), (" ", "soon"), (None, None)], "a string, b string")
    got = [r.d for r in df.select(M.two_dates(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [["20240101", "20240102"], ["20240101"], [], []]


@pytest.mark.parametrize("limit", [0, 1, 150, 400, 10**6])
def test_eviction_fits_and_is_minimal(spark, limit):
    rng = random.Random(limit)
    data = [("hot" if i % 3 else "b", i, rng.randrange(1, 40)) for i in range(60)]
    df = spark.createDataFrame(data, "s string, at int, size long")
    gone = {r["at"] for r in M.evict_plan(df, ["s"], ["at"], "size", F.floor(F.col("at") / 8), limit).collect()}
    if limit <= 0:
        assert gone == set()
        return
    for store in ("hot", "b"):
        files = [(a, n) for s, a, n in data if s == store]
        total, want = sum(n for _, n in files), set()
        for a, n in sorted(files):
            if total <= limit:
                break
            total -= n
            want.add(a)
        assert {a for a, _ in files if a in gone} == want


def test_best_match_order(spark):
    data = [(1, "a.mp4", True, True, "mp4", 9.0), (1, "b.mp3", True, True, "mp3", 1.0), (1, "c.mp3", False, True, "mp3", 5.0), (2, "d", False, False, "zip", 1.0), (2, "e", False, False, "ogg", 2.0)]
    df = spark.createDataFrame(data, "k int, p string, a boolean, b boolean, s string, t double")
    got = {r.k: r.p for r in M.best_match(df, "k", F.col("a"), F.col("b"), F.col("s"), F.col("t"), "p").collect()}
    assert got == {1: "b.mp3", 2: "e"}


def test_restore_plan(spark):
    files = [("d", "a.mp3.bak", 0.0), ("d", "b.mp3.bak", 0.0), ("d", "b.mp3", 0.0), ("d", "memo.txt.bak", 0.0), ("d", "new.mp3.bak", 99.0), ("busy", "a.mp3.bak", 0.0)]
    df = spark.createDataFrame(files, "dir string, name string, mtime double")
    busy = spark.createDataFrame([("busy",)], "dir string")
    got = {(r.name, r.action) for r in M.restore_plan(df, busy, F.lit(100.0), 10).collect()}
    assert got == {("a.mp3.bak", "restore"), ("b.mp3.bak", "delete")}
