"""Toxicity by maximum-scoring segments of token log-odds.

1. Log-odds with an informative Dirichlet prior compare the words of toxic and other training documents; the prior is
   a tenth of all training words, so rare words stay near 0. Words with a z-score of at least 3 get their log-odds as
   score, every other word a small negative one.
2. Each whole text is scanned once, in linear time, for all of its maximal scoring segments (Ruzzo and Tompa).
3. Extreme-value statistics (Karlin and Altschul) turn a segment's score into the number of segments as good that
   chance would give in a text of that length: `lambda` solves the moment equation of the scores in other documents,
   `K` follows from their best segments. Segments expected less than `E_VALUE` times are significant passages.
4. A logistic function of the normalised scores, fitted on the training rows, gives the score of the document. Each
   row weighs as many labels as it stands for, so a score is the chance at the true share of toxic labels.

Texts are read twice (words of the training rows, scan of all rows) and never shuffled. The training rows are at most
`TRAIN_ROWS` of each label, taken in the order of a hash of the id; with that bound they are small enough to be sent to
every task. Everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import read, whole
from larkspan.session import cut_lineage

TRAIN_ROWS = 12_000  # of each label
MOST_WORDS = 50_000  # of the scored words, by z
PRIOR = 0.1
LEAST_Z = 3.0
DRIFT = 0.1
E_VALUE = 0.05
MARKS = ".,;:!?\"()"
FEATURES = ["best", "total", "segments", "density"]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def words_of(text: Column) -> Column:
    plain = F.translate(F.lower(text), MARKS, " " * len(MARKS))
    return F.filter(F.split(plain, "[ \\n\\t\\r]+"), lambda w: w != "")


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of all ids that are not held out, each once. An id with several labels counts as toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def training_rows(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most `rows` ids of each label, without the held-out ones.

    `weight` is the number of ids of that label for which a row stands, so that the labels keep their true shares.
    """
    one = known_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    weights = [F.lit(max(1.0, counts.get(k, 0) / rows)).alias("weight") for k in (0, 1)]
    parts = [one.filter(F.col("toxic") == k).orderBy(*order).limit(rows).select("*", weights[k]) for k in (0, 1)]
    return cut_lineage(parts[0].unionByName(parts[1]))


def word_scores(docs: DataFrame, train: DataFrame, most: int = MOST_WORDS) -> pd.DataFrame:
    """word, score, and its rate in training documents that are not toxic; at most `most` rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).join(F.broadcast(train), "doc_id")
    words = texts.select("toxic", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counts = cut_lineage(words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter("t + c >= 3"))
    sums = counts.agg(F.sum("t"), F.sum("c")).first()
    if not sums[0] or not sums[1]:
        return pd.DataFrame({"word": [], "score": [], "rate": []})
    n_t, n_c = float(sums[0]), float(sums[1])
    prior, both = PRIOR * (n_t + n_c), n_t + n_c
    t, c = F.col("t"), F.col("c")
    a = (t + c) * (prior / both)
    odds = F.log((t + a) / (n_t + prior - t - a)) - F.log((c + a) / (n_c + prior - c - a))
    z = odds / F.sqrt(1 / (t + a) + 1 / (c + a))
    found = counts.select("word", odds.alias("score"), z.alias("z"), (c / n_c).alias("rate")).filter(F.col("z") >= LEAST_Z)
    return found.orderBy(F.col("z").desc(), "word").limit(most).select("word", "score", "rate").toPandas()


def solve_lambda(scores: np.ndarray, rates: np.ndarray) -> float:
    """The positive root of the sum of rate * exp(lambda * score), all other words scoring -DRIFT, minus 1."""
    rest = max(1e-9, 1 - rates.sum())

    def excess(x: float) -> float:
        return float((rates * np.exp(np.minimum(700, x * scores))).sum() + rest * math.exp(-x * DRIFT) - 1)

    low, high = 1e-6, 10.0
    if excess(low) >= 0:
        return low  # the scores rise by themselves: no segment is surprising
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def segments(places: list[int], scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word) of a text whose words at `places` have positive
    scores and all others -DRIFT. Linear in the number of places."""
    found: list[list] = []  # start, end, sum before, sum up to the end, and the next candidate on the left
    done, at = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        before = done - DRIFT * (place - at - 1)
        done, at = before + score, place
        start, low = place, before
        j = len(found) - 1
        while j >= 0:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= done:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append([start, place, low, done, j])
    return [(s[3] - s[2], s[0], s[1]) for s in found]


def scan(docs: DataFrame, scored: pd.DataFrame, lam: float) -> DataFrame:
    """doc_id, n_words and the segments of each whole text (score and first and last word)."""
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(scored["word"], scored["score"].astype(float), strict=True)))
    marks = str.maketrans({m: " " for m in MARKS + "\n\t\r"})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = table.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["_text"], strict=True):
                words = [w for w in text.lower().translate(marks).split(" ") if w]
                hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
                found = segments([i for i, _ in hits], [s for _, s in hits])
                rows.append((doc_id, len(words), [s for s, _, _ in found], [f for _, f, _ in found], [e for _, _, e in found]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "scores", "firsts", "lasts"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("_text"))
    found = texts.mapInPandas(work, "doc_id long, n_words long, scores array<double>, firsts array<int>, lasts array<int>")
    return cut_lineage(found.withColumn("scores", F.transform("scores", lambda s: s * lam)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights (the constant last) by Newton steps. A row counts `counts` times, or once."""
    n = np.ones(len(x)) if counts is None else counts
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages (first and last word of each, and its E-value).

    Null and empty texts have no words and get the score of a text without hits. Without training rows of both labels
    every document scores 0. An empty table gives no rows.
    """
    train = training_rows(labels, train_rows)
    scored = word_scores(docs, train)
    lam = solve_lambda(scored["score"].to_numpy(float), scored["rate"].to_numpy(float)) if len(scored) else 1.0
    found = scan(docs, scored, lam)
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    # the mean of the best segment's distribution is log(K * n) + 0.5772: K from other documents, over all their lengths
    clean = known_labels(labels).filter("toxic = 0").select("doc_id")
    told = found.select("doc_id", (best - F.log(n)).alias("rest")).join(clean, "doc_id")
    log_k = (told.agg(F.avg("rest")).first()[0] or 0.0) - 0.5772
    normal = F.transform("scores", lambda s: s - F.log(n) - F.lit(log_k))
    rows = found.withColumn("normal", normal).withColumn("hits", F.filter("normal", lambda s: s > -math.log(E_VALUE)))
    features = {
        "best": F.log1p(F.greatest(F.coalesce(F.array_max("normal"), F.lit(0.0)), F.lit(0.0))),
        "total": F.log1p(F.aggregate("hits", F.lit(0.0), lambda a, s: a + s)),
        "segments": F.log1p(F.size("hits").cast("double")),
        "density": F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / n,
    }
    rows = rows.withColumns(features)
    # one row per training id, whatever rows repeat it: at most 2 * train_rows
    one = rows.join(F.broadcast(train), "doc_id").groupBy("doc_id").agg(F.max(F.struct(*FEATURES, "toxic", "weight")).alias("row"))
    sample = one.select("row.*").toPandas()
    if sample["toxic"].nunique() == 2:
        w = fit_logistic(sample[FEATURES].to_numpy(float), sample["toxic"].to_numpy(float), counts=sample["weight"].to_numpy(float))
        linear = F.lit(float(w[-1]))
        for k, f in enumerate(FEATURES):
            linear = linear + F.col(f) * float(w[k])
        score = 1 / (1 + F.exp(-linear))
    else:
        score = F.lit(0.0)
    passage = F.filter(
        F.arrays_zip("firsts", "lasts", "normal"), lambda s: s["normal"] > -math.log(E_VALUE)
    )
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("hits").alias("n_passages"),
        F.transform(passage, lambda s: F.struct(s["firsts"].alias("first"), s["lasts"].alias("last"), F.exp(-s["normal"]).alias("e_value"))).alias("passages"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
