"""Repeated passages of bytes by an enhanced suffix array, its intervals of common prefixes and their left extensions.

1. Anchors. In every window of `LENGTH` bytes the 64-byte gram with the smallest hash (the leftmost of equal ones) is the
   window's anchor. Equal windows have the same anchor at the same place, so it is enough to sort the suffixes that
   start at anchors: one in about 70 positions, and no repeated window is missed.
2. Suffixes whose first 64 bytes occur once in the table go. The rest fall into buckets by these 64 bytes, which are
   whole intervals of the suffix array; suffixes with equal surroundings (136 bytes before the anchor, 200 from it on)
   are one entry of a bucket with a count, so copies cost nothing more.
3. In a bucket the entries are sorted by what follows. A stack scan of the common prefixes gives the tree of intervals.
   In every interval the entries are ordered by what precedes them: where these left extensions differ, groups end.
   A group whose left and right parts make `LENGTH` bytes or more, and that lies in no single child, is a maximal repeat
   with all its occurrences.
4. The offsets that an entry's groups cover go back to its occurrences, and per document the spans are joined.

Lengths are measured within the surroundings; a longer repeat is found at each of its anchors, whose spans join up.
Buckets of more than `most` entries are not gathered: there every window of an entry is one key, which is counted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import read, slices, whole
from larkspan.session import cut_lineage

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM  # bytes before an anchor that its windows can reach
WINDOW = REACH + 1
MOST = 20_000
PLACES = np.uint64((1 << 24) - 1)
SLICE = 400_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)


def _doubled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of 2 * size bytes from those of size bytes."""
    left = codes[: len(codes) - size]
    return (left ^ (left >> SHIFT)) * PRIME + codes[size:]


def _settled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """Per text the places of its anchors, the hashes of the grams there and of their surroundings, and how far before the
    anchor its first and its last window start."""
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    found = [none] * len(texts)
    long = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    if not long:
        return found
    data = b"".join(texts[k] for k in long)
    sizes = np.array([len(texts[k]) for k in long])
    ends = np.cumsum(sizes)
    grams = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:
        grams, size = _doubled(grams, size), size * 2
    grams = _settled(grams)
    windows = np.repeat(ends - sizes, sizes - LENGTH + 1)  # the start of the text of each window
    windows += np.arange(len(windows)) - np.repeat(np.cumsum(sizes - LENGTH + 1) - (sizes - LENGTH + 1), sizes - LENGTH + 1)
    least = _least(grams)[windows]
    first = np.flatnonzero(np.diff(least, prepend=-1))
    at, last = least[first], np.append(first[1:], len(least)) - 1
    own = np.searchsorted(ends, at, "right")
    low, high = (ends - sizes)[own], ends[own]
    inside = (at - low >= REACH) & (high - at >= LENGTH)
    around = np.zeros(len(at), np.uint64)
    for step in (-REACH, -REACH + GRAM, -REACH + 2 * GRAM, GRAM - 8, 2 * GRAM - 8, LENGTH - GRAM):  # grams that cover the 336 bytes
        around[inside] = _settled(around[inside] * PRIME + grams[at[inside] + step])
    around = around.view(np.int64)
    for n in np.flatnonzero(~inside).tolist():
        p = int(at[n])
        left = max(int(low[n]), p - REACH)
        around[n] = _digest(b"%d:" % (p - left), data[left : min(int(high[n]), p + LENGTH)])
    columns = ((at - low).astype(np.int32), grams[at].view(np.int64), around, (at - windows[first]).astype(np.int32), (at - windows[last]).astype(np.int32))
    cuts = np.searchsorted(own, np.arange(len(long) + 1))
    for n, k in enumerate(long):
        found[k] = tuple(c[cuts[n] : cuts[n + 1]] for c in columns)
    return found


def _least(keys: np.ndarray) -> np.ndarray:
    """For every window of keys the place of its least one, the leftmost of equal ones."""
    chosen = []
    step = int(PLACES) - WINDOW
    for low in range(0, len(keys) - WINDOW + 1, step):
        part = keys[low : low + step + WINDOW - 1]
        least = (part & ~PLACES) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= WINDOW:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        if WINDOW > size:
            least = np.minimum(least[: len(least) - (WINDOW - size)], least[WINDOW - size :])
        chosen.append((least & PLACES).astype(np.int64) + low)
    return np.concatenate(chosen)


def intervals(prefixes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of all intervals of neighbours that share more than their surroundings do.

    `prefixes[k]` is what entries k and k + 1 share; children come before their parents.
    """
    stack: list[tuple[int, int]] = []
    for k, shared in enumerate([*prefixes, -1]):
        first = k
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            yield depth, first, k
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


def repeat_groups(lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of all maximal repeats of one bucket: bytes before and from the anchor on, and who has them.

    `lefts` are the preceding bytes from the anchor outwards, `rights` the following ones; all differ in one of them.
    """
    if len(rights) == 2:
        left, right = shared_prefix(*lefts), shared_prefix(*rights)
        if left + right >= LENGTH:
            yield left, right, [0, 1]
        return
    order = sorted(range(len(rights)), key=rights.__getitem__)
    follow = [rights[k] for k in order]
    before = [lefts[k] for k in order]
    rank = [0] * len(order)
    for place, k in enumerate(sorted(range(len(before)), key=before.__getitem__)):
        rank[k] = place
    by_rank = sorted(range(len(before)), key=rank.__getitem__)
    close = [shared_prefix(before[a], before[b]) for a, b in zip(by_rank, by_rank[1:], strict=False)]
    done: list[tuple[int, int, list[int]]] = []  # closed intervals with their ranks, in order, not yet inside a parent
    for depth, first, last in intervals([shared_prefix(a, b) for a, b in zip(follow, follow[1:], strict=False)], LENGTH - REACH):
        children, inner = [], []
        while done and done[-1][0] >= first:
            children.append(done.pop())
        at = first
        child = {}
        for number, (a, b, ranks) in enumerate(reversed(children)):
            inner += [rank[k] for k in range(at, a)] + ranks
            child.update(dict.fromkeys(ranks, number))
            at = b + 1
        ranks = sorted(inner + [rank[k] for k in range(at, last + 1)])
        done.append((first, last, ranks))
        need = LENGTH - depth
        start = 0
        gaps = [close[a] if b == a + 1 else shared_prefix(before[by_rank[a]], before[by_rank[b]]) for a, b in zip(ranks, ranks[1:], strict=False)]
        for stop in range(1, len(ranks) + 1):
            if stop == len(ranks) or gaps[stop - 1] < need:
                if stop - start > 1:
                    for left, a, b in intervals(gaps[start : stop - 1], need):
                        members = ranks[start + a : start + b + 1]
                        of = child.get(members[0], -1)
                        if of < 0 or any(child.get(m, -1) != of for m in members):
                            yield left, depth, [order[by_rank[m]] for m in members]
                start = stop


def shared_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


def _facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: _id, _row, _check, _bytes and the lists of its anchors (at, gram, around, far, near)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in slices([*map(len, batch["_text"])], SLICE):
                texts = [t.encode() for t in batch["_text"].iloc[start:end]]
                found = anchors(texts)
                part = batch.iloc[start:end]
                yield pd.DataFrame(
                    {"_id": part["_id"].astype("Int64"), "_row": part["_row"], "_check": part["_check"], "_bytes": [len(t) for t in texts],
                     "at": [x[0] for x in found], "gram": [x[1] for x in found], "around": [x[2] for x in found], "far": [x[3] for x in found], "near": [x[4] for x in found]}
                )

    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(text).alias("_check"), text.alias("_text")
    )
    return cut_lineage(rows.mapInPandas(work, "_id long, _row long, _check long, _bytes long, at array<int>, gram array<long>, around array<long>, far array<int>, near array<int>"))


def _texts(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame, how: str = "inner") -> DataFrame:
    """The texts with the columns of `asked` (id, check and others) by their id and hash."""
    text = whole(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_check"), text.alias("_text"))
    rest = [c for c in asked.columns if c not in ("_id", "_check")]
    asked = asked.select(F.col("_id").alias("a_id"), F.col("_check").alias("a_check"), *rest)
    return texts.join(asked, (texts["_check"] == asked["a_check"]) & texts["_id"].eqNullSafe(asked["a_id"]), how).drop("a_id", "a_check")


ENTRY = ["gram", "around", "n", "far", "near", "crowded"]


def _surroundings(docs: DataFrame, facts: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """gram, around, n, far, near, crowded and the bytes before (outwards) and from the anchor on, one row per entry of `wanted`."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # repeated rows of a document are asked together; one answer of a task is enough
        for batch in batches:
            keep = [not (x in seen or seen.add(x)) for x in batch["name"]]
            batch = batch[keep]
            for start, end in slices([*map(len, batch["_text"])], SLICE):
                part = batch.iloc[start:end]
                before, follow = [], []
                for text, places in zip(part["_text"], part["at"], strict=True):
                    data = text.encode()
                    before += [data[max(0, p - REACH) : p][::-1] for p in places.tolist()]
                    follow += [data[p : p + LENGTH] for p in places.tolist()]
                yield pd.DataFrame({c: np.concatenate(part[c].tolist()) for c in ENTRY} | {"before": before, "follow": follow})

    listed = F.collect_list(F.struct("at", *ENTRY)).alias("asked")
    lists = wanted.groupBy("_row").agg(listed).select("_row", *[F.col(f"asked.{c}").alias(c) for c in ("at", *ENTRY)])
    asked = facts.select("_row", "_id", "_check").join(lists, "_row").withColumn("name", F.col("_row")).drop("_row")
    found = _texts(docs, id_col, text_col, asked).drop("_id", "_check")
    rows = found.mapInPandas(work, "gram long, around long, n long, far int, near int, crowded boolean, before binary, follow binary")
    return cut_lineage(rows)


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole buckets, several in a frame, from batches that are sorted by bucket."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        last = batch["gram"].iloc[-1]
        cut = int(np.flatnonzero((batch["gram"] != last).to_numpy())[-1]) + 1 if (batch["gram"] != last).any() else 0
        if cut or (rest and rest[-1]["gram"].iloc[-1] != last):
            yield pd.concat([*rest, batch.iloc[:cut]], ignore_index=True)
            rest = []
        rest.append(batch.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _groups(surroundings: DataFrame, folded: bool) -> DataFrame:
    """gram, around, left, right and number of all maximal repeats of the buckets that are not crowded, a row per member.

    With `folded` one row per entry: repeats of an anchor all contain it, so together they cover one span around it.
    """
    names = ["gram", "around", "left", "right", "number"]

    def of_bucket(before: list, follow: list, copied: list, far: list, near: list) -> Iterator[tuple[int, int, list[int]]]:
        alone = {k for k, c in enumerate(copied) if c}  # copies whose surroundings are no part of another entry's
        for left, right, members in repeat_groups(before, follow):
            one = members[0]
            if max(near[one], LENGTH - right) > min(far[one], left):
                continue  # no window of the group has this anchor: the group is found at another one
            yield left, right, members
            if alone:
                alone.difference_update([m for m in members if (len(before[m]), len(follow[m])) == (left, right)])
        for k in alone:
            yield len(before[k]), len(follow[k]), [k]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_bucket(b for b in batches if len(b)):
            frame = frame.drop_duplicates(["gram", "around"])
            grams, around = frame["gram"].to_numpy(), frame["around"].to_numpy()
            columns = [frame[c].tolist() for c in ("before", "follow")] + [(frame["n"] > 1).tolist(), frame["far"].tolist(), frame["near"].tolist()]
            cuts = [0, *(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)]
            lefts, rights = np.full(len(grams), -1, np.int32), np.full(len(grams), -1, np.int32)
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = []
                for number, (left, right, members) in enumerate(of_bucket(*[c[a:b] for c in columns])):
                    at = np.array(members) + a
                    if folded:
                        lefts[at], rights[at] = np.maximum(lefts[at], left), np.maximum(rights[at], right)
                    else:
                        rows.append(pd.DataFrame({"gram": grams[a], "around": around[at], "left": left, "right": right, "number": number}))
                    if len(rows) > 1000:
                        yield pd.concat(rows)
                        rows = []
                if rows:
                    yield pd.concat(rows)
            if folded:
                found = lefts >= 0
                yield pd.DataFrame({"gram": grams, "around": around, "left": lefts, "right": rights, "number": 0})[found]

    dealt = surroundings.filter("not crowded").select("gram", "around", "n", "far", "near", "before", "follow").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInPandas(work, "gram long, around long, left int, right int, number int").select(names)


def _counted(surroundings: DataFrame) -> DataFrame:
    """gram, around, left, right and window of the windows of crowded buckets that occur twice or more."""

    names = ["gram", "around", "n", "far", "near", "before", "follow"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for gram, around, n, far, near, before, follow in zip(*(batch[c] for c in names), strict=True):
                text, at = before[::-1] + follow, len(before)
                lefts = range(near, far + 1)
                yield pd.DataFrame(
                    {"gram": gram, "around": around, "n": n, "left": pd.Series(list(lefts), dtype="int32"),
                     "window": [hashlib.blake2b(text[at - x : at - x + LENGTH], digest_size=16).digest() for x in lefts]}
                )

    rows = surroundings.filter("crowded").select(*names)
    windows = cut_lineage(rows.mapInPandas(work, "gram long, around long, n long, left int, window binary").dropDuplicates(["gram", "around", "left"]))
    twice = windows.groupBy("gram", "left", "window").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    return windows.drop("n").join(twice, ["gram", "left", "window"]).withColumn("right", F.lit(LENGTH) - F.col("left"))


def _repeats(docs: DataFrame, id_col: str, text_col: str, most: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts of the documents; the suffixes in buckets (_row, at, gram, around, far, near); the entries with counts; their surroundings."""
    facts = _facts(docs, id_col, text_col)
    repeated = facts.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    repeated = cut_lineage(repeated)  # a table of its own, so that Spark can split the join at frequent grams
    suffixes = facts.select("_row", F.inline(F.arrays_zip("at", "gram", "around", "far", "near"))).join(repeated, "gram")
    suffixes = cut_lineage(suffixes.select("_row", "at", "gram", "around", "far", "near"))
    one = F.min(F.struct("_row", "at", "far", "near")).alias("one")
    entries = cut_lineage(suffixes.groupBy("gram", "around").agg(F.count("*").alias("n"), one))
    several = entries.groupBy("gram").agg(F.count("*").alias("n_entries")).filter("n_entries > 1")
    wanted = entries.join(several, "gram").select("gram", "around", "n", "one.*", (F.col("n_entries") > most).alias("crowded"))
    return facts, suffixes, entries, _surroundings(docs, facts, wanted, id_col, text_col)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The maximal repeats of `LENGTH` bytes or more with all their occurrences: repeat, length, doc_id, start.

    A repeat is found at each of its anchors, with the part of it that is near that anchor (see above); overlapping
    occurrences count. Null and empty texts and those shorter than `LENGTH` have none. Repeated rows are documents of
    their own, so they repeat each other; null ids stay null. An empty table gives no rows. Windows of crowded buckets
    are repeats of `LENGTH` bytes each.
    """
    facts, suffixes, entries, near = _repeats(docs, id_col, text_col, most)
    alone = entries.join(near.select("gram").distinct(), "gram", "left_anti")  # buckets of one entry
    copied = alone.select("gram", "around", F.lit(REACH).alias("left"), F.lit(LENGTH).alias("right"), F.xxhash64("gram", "around").alias("repeat"))
    groups = _groups(near, False).select("gram", "around", "left", "right", F.xxhash64("gram", "number", F.lit("group")).alias("repeat"))
    windows = _counted(near).select("gram", "around", "left", "right", F.xxhash64("gram", "left", "window").alias("repeat"))
    found = suffixes.join(copied.unionByName(groups).unionByName(windows), ["gram", "around"])
    placed = found.join(facts.select("_row", "_id", "_bytes"), "_row")
    start, end = F.greatest(F.col("at") - F.col("left"), F.lit(0)), F.least(F.col("at") + F.col("right"), F.col("_bytes"))
    return placed.select("repeat", (end - start).cast("long").alias("length"), F.col("_id").alias("doc_id"), start.cast("long").alias("start"))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (array of start and end) and kept, the bytes that are left.

    Every byte of a string of `LENGTH` bytes that starts anywhere else too is removed, the first occurrence included. Null
    texts count as empty; shorter texts stay whole. Repeated rows repeat each other. Null ids stay null. An empty table
    gives no rows; further columns are not read. Characters of several bytes may be cut, so `kept` is binary.
    """
    facts, suffixes, entries, near = _repeats(docs, id_col, text_col, most)
    groups = _groups(near, True).select("gram", "around", "left", "right").unionByName(_counted(near).select("gram", "around", "left", "right"))
    # all repeats of an anchor contain it, so together they cover one span around it
    covered = groups.groupBy("gram", "around").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    copied = F.col("n") > 1
    known = entries.join(covered, ["gram", "around"], "left").select(
        "gram", "around", F.when(copied, F.lit(REACH)).otherwise(F.col("left")).alias("left"), F.when(copied, F.lit(LENGTH)).otherwise(F.col("right")).alias("right")
    )
    known = cut_lineage(known.filter("left is not null"))  # a table of its own: Spark can split the join at frequent entries
    found = suffixes.join(known, ["gram", "around"])
    spans = found.groupBy("_row").agg(F.collect_list(F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))).alias("asked"))
    named = facts.select("_row", "_id", "_check").join(spans, "_row").groupBy("_id", "_check").agg(F.first("asked").alias("asked"))
    named = named.select("_id", "_check", F.col("asked.start").alias("starts"), F.col("asked.end").alias("ends"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last in slices([*map(len, batch["_text"])], SLICE):
                part = batch.iloc[first:last]
                texts = [t.encode() for t in part["_text"]]
                gone = [[] if x is None else joined([(max(0, a), min(len(t), b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)]) for t, x, y in zip(texts, part["starts"], part["ends"], strict=True)]
                kept = [b"".join(t[a:b] for a, b in zip([0, *(e for _, e in x)], [*(s for s, _ in x), len(t)], strict=True)) for t, x in zip(texts, gone, strict=True)]
                yield pd.DataFrame(
                    {"doc_id": part["_id"].astype("Int64"), "n_bytes": [len(t) for t in texts], "spans": [[{"start": a, "end": b} for a, b in x] for x in gone], "kept": kept}
                )

    rows = _texts(docs, id_col, text_col, named, "left").select("_id", "_text", "starts", "ends")
    return rows.mapInPandas(work, "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
