"""Keyed state in event-time order, for streams whose rows arrive late and out of order.

Rows of a key wait in list state until the watermark has passed them; an event-time timer then hands them, in order, to a
fold with the state that the rows before left. Keys share `BUCKETS` buckets by their hash, each with one state and one
timer, as calls to the state would cost more than the rows where keys are many and their rows few. What a fold sees depends neither on the arrival of the rows nor on the
batches they came in, as long as no row is later than the watermark allows. A key that is silent for `idle` ends: its
state is dropped, and may emit a last row.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = "timestamp_ntz'2000-01-01 00:00:00'"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 512


@dataclass(frozen=True)
class Fold:
    """`step(carried, columns)` gives the output columns and the new state; `carried` is a tuple or None.

    `ended(carried)` gives the output columns of a key that ends. `state` and `output` are schemas in DDL.
    """

    step: Callable[[tuple | None, dict[str, np.ndarray]], tuple[dict[str, list], tuple | None]]
    state: str
    output: str
    ended: Callable[[tuple], dict[str, list]] | None = None


class InOrder(StatefulProcessor):
    """`kinds` are the types of the key and of the columns, by name."""

    def __init__(self, key: str, columns: list[str], kinds: dict[str, str], fold: Fold, idle: int | None):
        self.key, self.columns, self.fold, self.idle = key, columns, fold, idle
        self.whole = [kinds[c] in ("bigint", "int") for c in (key, *columns)]
        self.names = [c.split(" ")[0] for c in fold.output.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # lists of (key, *columns), one for each batch of rows; what is carried of each key with its last time
        self.waiting = handle.getListState("waiting", "packed binary")
        self.carried = handle.getValueState("carried", "packed binary")
        self.timer = handle.getValueState("timer", "at_millis long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if self.order > 1:
                frame = frame[frame["tie0"].notna()]  # a row without a number only moves the watermark
            if frame.empty:
                continue
            columns = [_plain(frame[c], whole) for c, whole in zip((self.key, *self.columns), self.whole, strict=True)]
            self.waiting.appendValue((pickle.dumps(list(zip(*columns, strict=True))),))
            least = int(frame["at_micros"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(_timer(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        millis = timerValues.getCurrentWatermarkInMs()
        asked = self.timer.get()
        if asked is None or asked[0] > millis:
            return  # another timer of this batch has done the work
        self.timer.clear()
        now = millis * 1000
        rows = [r for packed in self.waiting.get() for r in pickle.loads(packed[0])]
        rows.sort(key=lambda r: r[1 : 1 + self.order])
        due, rest, first_left = {}, [], {}
        for r in rows:
            if r[1] <= now:
                due.setdefault(r[0], []).append(r[1:])
            else:
                rest.append(r)
                first_left.setdefault(r[0], r[1])
        state = self.carried.get()
        held = pickle.loads(state[0]) if state is not None else {}
        out = []
        for k in [*due, *(k for k in held if k not in due)] if self.idle else due:
            carried, last = held.pop(k, (None, None))
            found = []
            for part in self._parts(due.get(k, []), last):
                if self.idle and last is not None and part[0][0] - last > self.idle:
                    carried = self._end(carried, found)
                columns = {c: np.array(v) if c == "at_micros" else np.array(v, object) for c, v in zip(self.columns, zip(*part, strict=True), strict=True)}
                step, carried = self.fold.step(carried, columns)
                found.append(step)
                last = part[-1][0]
            # rows that still wait may lie before the end of the silence
            if self.idle and last is not None and now > last + self.idle and not (k in first_left and first_left[k] <= last + self.idle):
                carried = self._end(carried, found)
                carried = None
            if carried is not None:
                held[k] = (carried, last)
            out += [(k, step) for step in found]
        if due:
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        if held:
            self.carried.update((pickle.dumps(held),))
        elif state is not None:
            self.carried.clear()
        ends = [last + self.idle + 1 for _, last in held.values()] if self.idle else []
        # the end of a key that has rows waiting before it comes after these
        later = [t for t in [*([rest[0][1]] if rest else []), *ends] if _timer(t) > millis]
        if later:
            self._wake(_timer(min(later)))
        sizes = [max((len(v) for v in step.values()), default=0) for _, step in out]
        if any(sizes):
            keys = [k for (k, _), size in zip(out, sizes, strict=True) for _ in range(size)]
            columns = {c: [v for _, step in out for v in step[c]] for c in self.names}
            yield pd.DataFrame({self.key: keys, **columns}, dtype=object)

    def _wake(self, millis: int) -> None:
        """One timer at a time counts: the earliest."""
        asked = self.timer.get()
        if asked is None or millis < asked[0]:
            self.timer.update((millis,))
            self.handle.registerTimer(millis)

    @property
    def order(self) -> int:
        """The time and what breaks ties come first."""
        return 1 + sum(c.startswith("tie") for c in self.columns)

    def _parts(self, rows: list, last: int | None) -> Iterator[list]:
        """The rows cut where the key was silent for longer than `idle`."""
        start = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or (self.idle and rows[k][0] - rows[k - 1][0] > self.idle):
                yield rows[start:k]
                start = k

    def _end(self, carried: tuple | None, out: list) -> None:
        if carried is not None and self.fold.ended:
            out.append(self.fold.ended(carried))


def _plain(values: pd.Series, whole: bool) -> list:
    """Python values, None where there is none; whole numbers stay so beside nulls."""
    found = values.astype(object).where(values.notna(), None).tolist()
    return [v if v is None else int(v) for v in found] if whole else found


def _timer(micros: int) -> int:
    return -(-micros // 1000)


def in_order(events: DataFrame, key: str, order: list[str], late: str, columns: dict[str, Column], fold: Fold, idle: str | None = None) -> DataFrame:
    """The fold over the rows of each key by event time (`order[0]`, then the numbers that follow it).

    Rows later than `late` after the newest row are dropped by the stream. Null keys are a key of their own, rows
    without a time are left out. A row without its number (`order[1]`) is a heartbeat: it only moves the watermark on, so
    that what waits becomes due though its keys are silent. Output is append only.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that sets up the state knows no shipped package
    micros = spark.range(1).select(F.expr(f"timestampdiff(MICROSECOND, {DAY}, {DAY} + interval '{idle}')")).first()[0] if idle else None
    at = order[0]
    # without a zone the numbers of the text count; the session's zone plays no part
    zoned = dict(events.dtypes)[at] == "timestamp"
    number = F.unix_micros(at) if zoned else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))
    ties = {f"tie{k}": F.col(c) for k, c in enumerate(order[1:])}
    given = {"at_micros": number, **ties, **columns}
    timed = events.filter(F.col(at).isNotNull()).select(F.col(key), *[c.alias(n) for n, c in given.items()])
    rows = timed.withColumn("event_time", F.timestamp_micros("at_micros")).withWatermark("event_time", late)
    kinds = dict(rows.dtypes)
    processor = InOrder(key, list(given), kinds, fold, micros)
    dealt = rows.withColumn("in_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).groupBy("in_bucket")
    return dealt.transformWithStateInPandas(processor, f"{key} {kinds[key]}, {fold.output}", "append", "EventTime")


def requests_fold() -> Fold:
    """Requests of an item with the job that serves them: the open one, else a new one; a terminal event closes it."""

    def step(carried, c):
        asked, end, ids = c["asked"].astype(bool), c["ends"].astype(bool), c["event_id"]
        epoch = np.cumsum(end) - end
        rows = np.flatnonzero(asked)
        epochs, first = np.unique(epoch[rows], return_index=True)
        jobs = dict(zip(epochs.tolist(), ids[rows[first]].tolist(), strict=True))
        if carried is not None:
            jobs[0] = carried[0]
        served = [jobs[e] for e in epoch[rows].tolist()]
        open_job = jobs.get(int(end.sum()))
        return (
            {"event_id": ids[rows].tolist(), "job_id": served, "is_new": [a == b for a, b in zip(ids[rows].tolist(), served, strict=True)]},
            None if open_job is None else (open_job,),
        )

    return Fold(step, "job long", "event_id long, job_id long, is_new boolean")


def stable_fold(n: int) -> Fold:
    """The first row of a key whose last `n` comparisons with the row before were equal."""

    def step(carried, c):
        last, count, done = carried if carried is not None else (None, 0, False)
        values = c["value"]
        same = np.array([a is not None and a == b for a, b in zip(values, [last, *values[:-1]], strict=True)])
        place = np.arange(1, len(same) + 1)
        broken = np.maximum.accumulate(np.where(same, 0, place))
        counts = place - broken + np.where(broken == 0, count, 0)
        hit = np.flatnonzero(counts >= n)[:1] if not done else np.zeros(0, int)
        found = {"event_id": c["event_id"][hit].tolist(), "value": values[hit].tolist()}
        return found, (values[-1], int(counts[-1]), bool(done or len(hit)))

    return Fold(step, "last string, count int, done boolean", "event_id long, value string")


def sized_fold(limit: int) -> Fold:
    """Sizes add up; a row that reaches the limit emits the sum and clears it, other rows repeat the last result."""

    def step(carried, c):
        held, last = carried if carried is not None else (0, None)
        sums = np.cumsum(c["size"].astype(np.int64))
        n, at, base = len(sums), 0, -held
        emitted, results = [False] * n, [last] * n
        while (hit := at + int(np.argmax(sums[at:] >= base + limit)) if at < n and (sums[at:] >= base + limit).any() else -1) >= 0:
            last, base = int(sums[hit]) - base, int(sums[hit])
            emitted[hit], results[hit:] = True, [last] * (n - hit)
            at = hit + 1
        return {"event_id": c["event_id"].tolist(), "emitted": emitted, "result": results}, (int(sums[-1]) - base, last)

    return Fold(step, "held long, last long", "event_id long, emitted boolean, result long")


def expiry_fold() -> Fold:
    """The newest entry of a key, told when it becomes so and again, not alive, when nothing came after it in time."""

    def step(carried, c):
        newest = (int(c["event_id"][-1]), int(c["at_micros"][-1]))
        return {"event_id": [newest[0]], "at": [newest[1]], "alive": [True]}, newest

    def ended(carried):
        return {"event_id": [carried[0]], "at": [carried[1]], "alive": [False]}

    return Fold(step, "event_id long, at long", "event_id long, at long, alive boolean", ended)
