"""Hard negatives by exact threshold joins over an inverted index with suffix norms (L2AP).

Vectors are integers, a score is the inner product. Dimensions are ordered by their weight in the whole table.

1. Index. Rows lie in blocks of bounded size, large labels in blocks of their own. A block has a posting list for each
   few dimensions that follow each other, sorted by the norm that a row has from the first of them on.
2. Search. With threshold t an anchor reads of each list only the postings whose suffix norm times its own suffix norm
   reaches t: what lies behind is covered by that bound and left out. Partial scores are summed up; rows whose partial
   score and remaining norms cannot reach t are dropped, the others are scored exactly. Then t is lowered, and every list
   is read on from where it stopped, until the anchor's windows are full. Some anchors search together, each with its own
   t, so that partial scores and scores are products of matrices.
3. Positives are the best rows of the anchor's label, found in the blocks of that label. Every positive gives a window
   of scores; the second search meets all blocks and fills each window with the best rows of other labels.

Anchors are a stated query set and meet the index in pairs of blocks. A block gives back a few rows for each anchor, so
the merge is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import read, shuffle_width
from larkspan.session import cut_lineage

POSITIVES, NEGATIVES = 5, 3
BLOCK, ANCHORS = 8192, 1024  # rows of a block of the index, anchors of a block
LOWER = 0.85  # a threshold follows the one before by this factor
SLACK = 1e-9  # norms are rounded
WIDTH, TOGETHER = 16, 64  # dimensions of a posting list, anchors of a search
FAR = 2**62  # above all scores
SEARCHED = "anchor_id long, key long, positive_id long, positive_score long, found_id long, found_score long"
WINDOWS = "windows array<array<long>>"


class Block:
    """One block of the index: exact vectors, suffix norms, and posting lists by falling suffix norm.

    A list holds WIDTH dimensions that follow each other, by the norm from the first of them on.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(float)  # whole numbers below 2 ** 53, so sums of products are exact in any order
        self.norms = suffix_norms(vectors)
        self.lists = []
        for k in range(0, vectors.shape[1], WIDTH):
            rows = np.argsort(-self.norms[:, k], kind="stable")
            self.lists.append((slice(k, min(k + WIDTH, vectors.shape[1])), rows, -self.norms[rows, k], self.vectors[rows, k : k + WIDTH]))
        self.longest = float(self.norms[:, 0].max()) if len(vectors) else 0.0


class Search:
    """The search of an anchor, or of the rows of a matrix of anchors, in one block; `lower` goes on to smaller thresholds.

    Anchors of a matrix share the lists as far as one of them needs them, and the rows that one of them may reach: `scores`
    has a column for each, `known` a value for each row.
    """

    def __init__(self, block: Block, anchors: np.ndarray):
        self.block, self.anchors = block, anchors.astype(float).T
        self.norms = suffix_norms(anchors).T
        n = len(block.vectors)
        self.partial, self.read = np.zeros((n, *anchors.shape[:-1])), np.zeros(n, np.int64)
        self.ends = np.zeros(anchors.shape[-1], np.int64)
        self.known, self.scores = np.zeros(n, bool), np.full(self.partial.shape, -np.inf)

    def top(self) -> np.ndarray:
        """No score is above."""
        return self.norms[0] * self.block.longest

    def only(self, anchors: np.ndarray) -> None:
        """Go on with these columns alone."""
        self.anchors, self.norms, self.partial, self.scores = (x[:, anchors] for x in (self.anchors, self.norms, self.partial, self.scores))

    def lower(self, threshold: np.ndarray | float) -> None:
        """Score exactly all rows that can reach the threshold (one for each anchor)."""
        block = self.block
        if self.known.all():
            return
        for dims, rows, falling, values in block.lists:
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(np.greater(threshold, 0), threshold / self.norms[dims.start], np.inf).min()
            end = int(np.searchsorted(falling, -need * (1 - SLACK), "right"))
            if not end:
                break  # suffix norms only fall
            start = self.ends[dims.start]
            if end > start:
                fresh = ~self.known[rows[start:end]]
                found = rows[start:end][fresh]
                self.partial[found] += values[start:end][fresh] @ self.anchors[dims]
                self.read[found] = dims.stop
                self.ends[dims] = end
        left = np.flatnonzero(~self.known)
        rest = (self.norms[self.read[left]].T * block.norms[left, self.read[left]]).T
        near = np.less_equal(threshold, 0) | (self.partial[left] + rest >= threshold * (1 - SLACK) - 1)
        found = left[near.reshape(len(left), -1).any(axis=1)]
        self.scores[found] = block.vectors[found] @ self.anchors
        self.known[found] = True


def suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """The norm of each row from every dimension on, and 0 at the end."""
    squares = np.cumsum(np.square(vectors[..., ::-1].astype(float)), axis=-1)[..., ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((*vectors.shape[:-1], 1))], axis=-1))


def best(search: Search, valid: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> list[np.ndarray]:
    """For each anchor and each of its windows of scores (low to high) the n best valid rows of the block in it, or all.

    Rows of `low` and `high` and columns of `valid` are anchors. Gives anchors, windows, rows and scores; ties go to the smaller id.
    """
    last, floor, want = low.min(axis=1), search.top() * 0.05, np.minimum(n, valid.sum(axis=0))
    threshold = np.maximum(np.minimum(search.top(), high.max(axis=1)) * LOWER, last)
    anchors, found = np.arange(len(low)), []
    while len(anchors):
        threshold = np.where(threshold > floor, threshold, last)
        search.lower(threshold)
        rows, at = np.nonzero(valid & (search.scores >= threshold))
        scores = search.scores[rows, at]
        order = np.lexsort((ids[rows], -scores, at))
        at, rows, scores = at[order], rows[order], scores[order]
        inside = [(scores >= low[at, w]) & (scores <= high[at, w]) for w in range(low.shape[1])]
        counts = np.array([np.bincount(at[fit], minlength=len(anchors)) for fit in inside])
        full = ((counts >= want) | (threshold <= low.T)).all(axis=0)
        for w, fit in enumerate(inside):
            firsts = np.cumsum(counts[w]) - counts[w]
            rank = np.arange(fit.sum()) - firsts[at[fit]]
            take = np.flatnonzero(fit)[(rank < n) & full[at[fit]]]
            found.append((anchors[at[take]], np.full(len(take), w), rows[take], scores[take].astype(np.int64)))
        threshold = np.maximum(threshold * LOWER, last)
        if full.any():
            left = np.flatnonzero(~full)
            search.only(left)
            anchors, low, high, threshold, last, floor, want = (x[left] for x in (anchors, low, high, threshold, last, floor, want))
            valid = valid[:, left]
    return [np.concatenate(column) for column in zip(*found, strict=True)]


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """`rows` with the block `name`: labels of more than half a block have blocks of their own, the others share."""
    sizes = cut_lineage(rows.groupBy("label").agg(F.count("*").alias("n")))
    shared = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // size))
    parts = F.ceil(F.col("n") / size)
    own = F.xxhash64("label", F.pmod(F.xxhash64("key"), parts))
    home = F.when(F.col("n") > size // 2, own).otherwise(F.pmod(F.xxhash64("label"), F.lit(shared)))
    return rows.join(sizes, "label").withColumn(name, home).drop("n")


def _packed(rows: DataFrame, by: str, order: list[int], extra: str = "") -> DataFrame:
    """One row per block: ids, keys, labels and vectors as bytes, with the dimensions in `order`, and `extra` columns as lists."""
    names = [c.split(" ")[0] for c in extra.split(", ")] if extra else []

    def work(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(found), len(order)), np.int64)
        place = np.argsort(order)
        for k, v in enumerate(found["vector"]):
            vectors[k, place[: len(v)]] = v
        row = {by: key[0], **{c: found[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "key", "label")}, "vectors": vectors.tobytes()}
        return pd.DataFrame([row | {c: [list(x) for x in found[c]] for c in names}])

    schema = f"{by} long, vec_id binary, key binary, label binary, vectors binary" + (f", {extra}" if extra else "")
    return rows.groupBy(by).applyInPandas(work, schema)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _met(block: Block, ids: np.ndarray, labels: np.ndarray, anchors: pd.DataFrame, vectors: np.ndarray, same: bool, n: int) -> pd.DataFrame:
    """The rows of SEARCHED for some anchors (vec_id, key, label, windows) and one block of the index."""
    equal = labels[:, None] == anchors["label"].to_numpy()
    valid = equal & (ids[:, None] != anchors["vec_id"].to_numpy()) if same else ~equal
    able = valid.any(axis=0)
    anchors, valid = anchors[able], valid[:, able]
    if anchors.empty:
        return pd.DataFrame()
    windows = np.tile(np.array([0, 0, FAR, -FAR]), (len(anchors), anchors["windows"].map(len).max() // 4, 1))
    for mine, told in zip(windows, anchors["windows"], strict=True):
        mine[: len(told) // 4] = np.reshape(told, (-1, 4))
    at, window, rows, scores = best(Search(block, vectors[able]), valid, ids, windows[..., 2].astype(float), windows[..., 3].astype(float), n)
    facts = anchors["vec_id"].to_numpy()[at], anchors["key"].to_numpy()[at], windows[at, window, 0], windows[at, window, 1], ids[rows], scores
    return pd.DataFrame(dict(zip((c.split(" ")[0] for c in SEARCHED.split(", ")), facts, strict=True)))


def _searched(pairs: DataFrame, index: DataFrame, anchors: DataFrame, dims: int, same: bool, n: int) -> DataFrame:
    """The best n rows of a block of the index, of the same or of other labels, in each window, for all pairs (a, b) of blocks.

    Windows of an anchor are a list of four numbers each: an id and a score that are handed on, the lowest and the highest
    score in it.
    """

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=[c.split(" ")[0] for c in SEARCHED.split(", ")])]
        for at, mine in zip(left.itertuples(), right.itertuples(), strict=True):
            ids, labels = _numbers(at.vec_id), _numbers(at.label)
            block = Block(_numbers(at.vectors).reshape(-1, dims))
            asking = pd.DataFrame({"vec_id": _numbers(mine.vec_id), "key": _numbers(mine.key), "label": _numbers(mine.label)})
            asking["windows"] = list(mine.windows)
            vectors = _numbers(mine.vectors).reshape(-1, dims)
            for k in range(0, len(asking), TOGETHER):
                found.append(_met(block, ids, labels, asking[k : k + TOGETHER], vectors[k : k + TOGETHER], same, n))
        return pd.concat(found)

    pairs = cut_lineage(pairs)
    right = pairs.select(F.col("a").alias("at"), F.col("b").alias("bt")).join(anchors, F.col("a") == F.col("at")).drop("a")
    return pairs.join(index, "b").groupBy("a", "b").cogroup(right.groupBy("at", "bt")).applyInPandas(work, SEARCHED)


def hard_negatives(
    vectors: DataFrame, anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), block: int = BLOCK, anchor_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `vectors` has vec_id, label and vector (array of long); `anchor` tells the anchors. A negative has another label and a
    score s with low * p <= s <= high * p (as fractions) for the score p of its positive. Ties go to the smaller id. Rows
    with a null in one of the columns take no part; equal rows count once; rows with the same id but other contents are no
    partners of each other as positives. Shorter vectors go on with zeros. Products of norms must stay below 2 ** 53. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", anchor.alias("asks"))
    rows = rows.filter("vec_id is not null and label is not null and vector is not null").distinct()
    rows = cut_lineage(rows.withColumn("key", F.xxhash64("vec_id", "label", "vector")))
    energy = rows.select(F.posexplode("vector").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("e")).collect()  # a row per dimension
    order = [r.dim for r in sorted(energy, key=lambda r: (-r.e, r.dim))]
    dims = len(order)
    placed = cut_lineage(_blocks(rows, block, "b"))
    index = cut_lineage(_packed(placed, "b", order))
    asking = cut_lineage(_blocks(rows.filter("asks"), anchor_block, "a"))

    met = asking.select("label", "a").distinct().join(placed.select("label", "b").distinct(), "label").select("a", "b").distinct()
    every = asking.withColumn("windows", F.array(*[F.lit(x).cast("long") for x in (0, 0, -FAR, FAR)]))
    found = _searched(met, index, _packed(every, "a", order, WINDOWS), dims, True, n_positives)
    found = found.select("anchor_id", "key", F.col("found_id").alias("positive_id"), F.col("found_score").alias("positive_score"))
    first = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    chosen = cut_lineage(found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= n_positives))
    score = F.col("positive_score")
    ends = {"low": -_floored(-score * low[0], low[1]), "high": _floored(score * high[0], high[1])}
    inside = chosen.select("anchor_id", "key", "positive_id", "positive_score", *[c.alias(n) for n, c in ends.items()]).filter("low <= high")
    lists = inside.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(
        F.flatten(F.sort_array(F.collect_list(F.array(F.col("positive_id"), score, F.col("low"), F.col("high"))))).alias("windows")
    )
    armed = asking.join(lists, ["vec_id", "key"])

    # every block of anchors meets every block of the index: the pairs of their numbers are dealt by slots
    slots = shuffle_width(vectors.sparkSession)
    asks = armed.select("a").distinct().select("a", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = asks.join(placed.select("b").distinct().withColumn("slot", F.pmod(F.xxhash64("b"), F.lit(slots)).cast("int")), "slot").select("a", "b")
    met = _searched(pairs, index, _packed(armed, "a", order, WINDOWS), dims, False, n_negatives)
    met = met.withColumnsRenamed({"found_id": "negative_id", "found_score": "negative_score"})
    next_ = Window.partitionBy("anchor_id", "key", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return met.withColumn("rank", F.row_number().over(next_)).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _floored(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b).cast("long"))) / b).cast("long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    sound = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # a NaN is above all numbers
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    vectors = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select("vec_id", moved.alias("label"), vector.alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP11_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, other) as n from s where same) where n <= 5
), n as (
  select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as int) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
