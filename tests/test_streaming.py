import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.operators import sequences as O
from larkspan.operators.scene import apply_changes
from larkspan.streaming import jobs as J
from larkspan.streaming import ordered as Q
from larkspan.streaming import run as R
from larkspan.streaming.change_log import ChangeLog
from tests.test_scene import ELEMENTS, element

COLS = "u string, ts int, i int, kind string, size int"
ORDER = ["ts", "i"]


def files(spark, path, rows, n, schema=COLS):
    """The rows as `n` files that arrive in order."""
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.read.schema(schema).parquet(f"{path}/in").schema
    return spark.readStream.schema(source).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in")


def events(seed, n=90):
    rng = random.Random(seed)
    return [(rng.choice("aab"), t, t, rng.choice(["ask", "ask", "end", "tick", "tick"]), rng.randrange(1, 9)) for t in range(n)]


def table(spark, rows):
    """The rows with a time: second `ts` of a day, two rows share one."""
    rows = [(u, t // 2 * 2, i, kind, size) for u, t, i, kind, size in rows]
    return spark.createDataFrame(rows, COLS).withColumn("ts", F.timestamp_seconds(F.col("ts") + 1_700_000_000)).withColumn("i", F.col("i").cast("long"))


def ended(stream, tmp_path):
    """(the rows of the sink, rows that the state still holds) after everything that is there."""
    sink = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    q = sink.trigger(availableNow=True).start()
    q.awaitTermination()
    left = q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress else 0
    return stream.sparkSession.read.parquet(f"{tmp_path}/out"), left


@pytest.mark.parametrize("seed,pieces", [(1, 2), (2, 6)])
def test_active_requests_equal_batch_though_late(spark, tmp_path, seed, pieces):
    rows = events(seed)
    stream, late = R.late_arrivals(table(spark, rows), "ts", pieces=pieces)
    ask, end = F.col("kind") == "ask", F.col("kind") == "end"
    out = J.active_requests(stream, "u", ORDER, "i", ask, end, late)
    got = spark.read.parquet(R.drain(out, "active", out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp")))
    want = O.active_jobs(table(spark, rows), "u", ORDER, F.floor(F.unix_seconds("ts") / 10), "i", ask, end)
    assert sorted((r.u, r.event_id, r.job_id, r.is_new) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    # a restart finds nothing new and repeats nothing
    R.drain(out, "active", out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()


def test_state_of_requests_ends(spark, tmp_path):
    """Terminal events clear the state; a silent item is forgotten after its time to live, in event time."""
    rows = [("a", 0, 0, "ask", 1), ("a", 4, 1, "ask", 1), ("a", 40, 2, "ask", 1), ("b", 2, 3, "ask", 1), ("b", 3, 4, "end", 1), ("c", 6, 5, "ask", 1), ("c", 16, 6, "ask", 1)]
    stream, late = R.late_arrivals(table(spark, rows), "ts", ahead="1 minute", pieces=2)
    out = J.active_requests(stream, "u", ORDER, "i", F.col("kind") == "ask", F.col("kind") == "end", late, ttl="10 seconds")
    got, left = ended(out, tmp_path)
    assert {r.event_id: r.job_id for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 5: 5, 6: 5} and left == 0


def test_stable_and_sized_streams_though_late(spark, tmp_path):
    rows = events(7)
    ordered = sorted(rows, key=lambda r: (r[1] // 2 * 2, r[2]))
    stream, late = R.late_arrivals(table(spark, rows), "ts")
    got = spark.read.parquet(R.drain(J.stable_stream(stream, "u", ORDER, "i", "kind", late), "stable"))
    want = O.stable_points(table(spark, rows), ["u"], ORDER, F.floor(F.unix_seconds("ts") / 10), "kind")
    assert {(r.u, r.event_id) for r in got.collect()} == {(r.u, r.i) for r in want.collect()}
    stream, late = R.late_arrivals(table(spark, rows), "ts")
    sized = J.size_triggered(stream, "u", ORDER, "i", F.col("size"), late, limit=20)
    got = {r.event_id: (r.emitted, r.result) for r in spark.read.parquet(R.drain(sized, "sized")).collect()}
    held, last = {}, {}
    for u, _, i, _, size in ordered:
        held[u] = held.get(u, 0) + size
        full = held[u] >= 20
        if full:
            last[u], held[u] = held[u], 0
        assert got[i] == (full, last.get(u))


def test_folds_do_not_depend_on_where_rows_are_cut():
    rng = random.Random(8)
    values = np.array([rng.choice("xxy") if rng.random() < 0.9 else None for _ in range(200)], object)
    sizes, ids = np.array([rng.randrange(0, 30) for _ in range(200)], object), np.arange(200).astype(object)
    columns = {"event_id": ids, "value": values, "size": sizes, "asked": sizes % 3 == 0, "ends": sizes % 7 == 0}
    for fold in (Q.requests_fold(), Q.stable_fold(3), Q.sized_fold(64)):
        whole, _ = fold.step(None, columns)
        for cuts in ([0, 200], [0, 1, 2, 50, 51, 200], sorted({0, 200, *(rng.randrange(200) for _ in range(40))})):
            carried, parts = None, {c: [] for c in whole}
            for a, b in zip(cuts, cuts[1:], strict=False):
                found, carried = fold.step(carried, {c: v[a:b] for c, v in columns.items()})
                for c in parts:
                    parts[c] += list(found[c])
            assert parts == {c: list(v) for c, v in whole.items()}


def test_entries_expire_by_timers(spark, tmp_path):
    rows = [("a", 0, 0, "", 0), ("a", 8, 1, "", 0), ("a", 30, 2, "", 0), ("b", 4, 3, "", 0), ("c", 60, 4, "", 0), ("d", 10, 5, "", 0), ("d", 20, 6, "", 0)]
    stream, late = R.late_arrivals(table(spark, rows), "ts", pieces=4)
    got, left = ended(J.expiring(stream, "u", ORDER, "i", "10 seconds", late), tmp_path)
    assert {r.event_id for r in got.filter("not alive").collect()} == {1, 2, 3, 6} and left > 0
    assert {r.event_id for r in got.filter("alive").collect()} >= {1, 2, 3, 4, 6}


def test_late_arrivals_hold_every_row(spark):
    rows = events(3, 40)
    for data in (rows, rows[:1], []):
        stream, late = R.late_arrivals(table(spark, data), "ts")
        got = spark.read.parquet(R.drain(stream, "rows"))
        assert got.filter("i is not null").count() == len(data) and late.endswith("seconds") or not data


def test_current_state_keeps_the_newest(spark, tmp_path):
    rows = events(5)
    stream = files(spark, tmp_path, rows, 3)
    state = J.current_state(stream, "u", ORDER, F.col("kind"), F.col("size").cast("double"), F.lit("x"), F.col("kind") == "end")
    got = {r.u: (r.status, r.percent) for r in R.latest_updates(state, "state", "u").collect()}
    last = {}
    for u, _, _, kind, size in rows:
        last[u] = (kind, None if kind == "end" else float(size))
    assert got == last


@pytest.mark.parametrize("every", [2, 100])
def test_change_feed_applies_batches_in_order(spark, tmp_path, every):
    elements = spark.createDataFrame([element(x) for x in "abcdefgh"], ELEMENTS)
    feed = [(1, "move_dx", "a", None, 5.0), (2, "hide", "b", None, None), (3, "move_by", "a", None, 2.0), (4, "show", "b", None, 30.0), (5, "group", "a", "g", None), (6, "delete", "b", None, None)]
    feed += [(7, "hide", "h", None, None), (8, "link", "b", "gone", None), (9, "delete", "c", None, None), (10, "move", "d", None, 1.0)]
    cols = "seq long, op string, id string, text string, number double"
    stream = files(spark, tmp_path, feed, 5, cols)
    each = J.change_feed(str(tmp_path / "table"), elements, every)
    R.drain_batches(stream, "feed", each, checkpoint=str(tmp_path / "cp"))
    state = elements
    for k in range(5):
        state = apply_changes(state, spark.createDataFrame(feed[2 * k : 2 * k + 2], cols)).select(*elements.columns)
        got = each.log.read(str(k)).select(*elements.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, state.collect()))
    # a batch that is repeated after a failure is applied once
    each(spark.createDataFrame(feed[8:], cols), 4)
    assert sorted(map(str, each.log.read().collect())) == sorted(map(str, state.collect()))
    each(spark.createDataFrame([(11, "delete", "*", None, None)], cols), 5)
    assert each.log.read().count() == 0
    each(spark.createDataFrame([(12, "hide", "a", None, None)], cols), 6)
    assert each.log.read().count() == 0


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    """A batch of two changes writes about the same for a table of any size, and reads its buckets only."""
    written = {}
    for n in (500, 20_000):
        rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        log = ChangeLog(str(tmp_path / f"t{n}"), rows, "id", every=3)
        for k in range(3):
            batch = spark.createDataFrame([(str(k), "new"), (str(k + 100), "new")], "id string, v string")
            log.apply(batch, k, lambda b: b.select("id"), lambda old, new: new)
            run = sum(f.stat().st_size for f in (tmp_path / f"t{n}" / "delta" / f"batch_id={k}").rglob("*.parquet"))
            written[n, k] = run
        assert log.read().count() == n and log.read().filter("v = 'new'").count() == 6
        whole = sum(f.stat().st_size for f in (tmp_path / f"t{n}" / "base" / "run=start").rglob("*.parquet"))
        again = sum(f.stat().st_size for f in (tmp_path / f"t{n}" / "base" / "run=2").rglob("*.parquet"))
        assert again < whole / 5  # only the buckets of six keys are compacted
    assert all(written[500, k] == pytest.approx(written[20_000, k], rel=0.1) for k in range(3))


def kept(files, limit):
    """The newest files of a store that fit together."""
    total, out = 0, set()
    for at, size in sorted(files, reverse=True):
        total += size
        if total > limit:
            break
        out.add(at)
    return out


def test_keys_share_states(spark, tmp_path):
    """Many keys with few rows: the state has rows for buckets, not for keys."""
    rows = [(f"u{t % 1600}", t, t, "ask", t) for t in range(4800)]
    stream, late = R.late_arrivals(table(spark, rows), "ts", pieces=2)
    got, left = ended(J.stable_stream(stream, "u", ORDER, "i", "kind", late), tmp_path)
    assert sorted(r.event_id for r in got.collect()) == list(range(3200, 4800)) and 0 < left <= 3 * Q.BUCKETS < 1600


def test_retention_monitor_follows_its_deltas(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice(["s", "s", "t", None]), i, rng.choice([0, 7, 10, 25])) for i in range(60)]
    rows = rows[:30] + rows[40:] + rows[30:40]  # ten older files come last
    cols = "store string, at int, size long"
    stream = files(spark, tmp_path, rows, 4, cols)
    each = J.retention_monitor(str(tmp_path / "r"), spark.createDataFrame([], cols), ["store"], ["at"], "size", F.floor(F.col("at") / 4), 90)
    R.drain_batches(stream, "retention", each)
    here, gone = {}, []
    for k in range(4):
        for store, at, size in rows[15 * k : 15 * k + 15]:
            here.setdefault(store, {})[at] = size
        for store, found in here.items():
            stay = kept(found.items(), 90)
            gone += [(k, store, at) for at in found if at not in stay]
            here[store] = {at: s for at, s in found.items() if at in stay}
    got = spark.read.option("basePath", each.plan).parquet(f"{each.plan}/batch_id=*")
    assert sorted((r.batch_id, str(r.store), r["at"]) for r in got.collect()) == sorted((k, str(s), at) for k, s, at in gone)
    held = each.log.read().select(F.explode("_files").alias("f")).select("f.*")
    assert {(r.store, r["at"]) for r in held.collect()} == {(s, at) for s, found in here.items() for at in found}
    again = each.log.read().agg(F.sum("_bytes")).first()[0]
    each(spark.createDataFrame(rows[45:], cols), 3)  # repeated after a failure
    assert each.log.read().agg(F.sum("_bytes")).first()[0] == again


@pytest.mark.parametrize("seed", range(2))
def test_retention_with_a_horizon_does_not_depend_on_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["s", "s", "t", None]), i, rng.choice([0, 7, 10, 25, 60, None])) for i in range(60)]
    rng.shuffle(rows)
    # in the order of arrival a small file of "gap" fits where a newer large one has gone
    rows = [("gap", 108, 80), ("gap", 109, 20), *rows, ("gap", 101, 5)]
    cols = "store string, at int, size long"
    stream = files(spark, tmp_path, rows, 4, cols)
    each = J.retention_monitor(str(tmp_path / "r"), spark.createDataFrame([], cols), ["store"], ["at"], "size", F.floor(F.col("at") / 4), 90, horizon=True)
    R.drain_batches(stream, "retention", each)
    want = set()
    for store in {r[0] for r in rows}:
        found = [(at, size or 0) for s, at, size in rows if s == store]
        want |= {(store, at) for at, _ in found if at not in kept(found, 90)}
    got = spark.read.option("basePath", each.plan).parquet(f"{each.plan}/batch_id=*")
    assert {(r.store, r["at"]) for r in got.collect()} == want and got.count() == len(want) and ("gap", 101) in want


def test_publish_and_text_source(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("[download] 5.0% of 1MiB ETA 00:09\nnoise\n[ExtractAudio] x\n")
    lines = J.progress_stream(R.read_progress_stream(spark, str(tmp_path / "log")).select("line"))
    message = J.payload(lines.withColumn("j", F.lit("7")), "j", F.col("status"), F.lit("t"), F.lit(None).cast("string"), F.col("percent"), F.col("eta"))
    R.drain_batches(message, "publish", J.publish({str(tmp_path / "p"): "parquet", str(tmp_path / "j"): "json"}))
    got = spark.read.parquet(f"{tmp_path}/p/batch_id=0")
    assert sorted((r.progress.percent, r.progress.eta) for r in got.collect()) == [(5.0, "00:09"), (100.0, None)] and got.columns == ["job_id", "status", "title", "error", "progress"]
    assert spark.read.json(f"{tmp_path}/j/batch_id=0").count() == 2


def test_speech_sessions_stream_closes_old_sessions(spark, tmp_path):
    base = "2024-01-01 00:{:02d}:00"
    rows = [("u", base.format(m), v) for m, v in ((0, 1), (1, 1), (2, 0), (10, 1), (11, 1), (40, 1))]
    cols = "u string, at string, v int"
    stream = files(spark, tmp_path, rows, 3, cols).withColumn("at", F.to_timestamp("at"))
    out = spark.read.parquet(R.drain(J.speech_sessions(stream, "u", "at", F.col("v") > 0, "5 minutes", late="1 minute"), "speech"))
    got = sorted((r.start.minute, r.chunks) for r in out.collect())
    batch = J.speech_sessions(spark.createDataFrame(rows, cols).withColumn("at", F.to_timestamp("at")), "u", "at", F.col("v") > 0, "5 minutes")
    every = sorted((r.start.minute, r.chunks) for r in batch.collect())
    assert every == [(0, 2), (10, 2), (40, 1)] and got == every[:2]
