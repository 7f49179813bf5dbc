"""Personal data: generators propose overlapping spans, boosted trees select among them.

Base formats (email, ip, card, phone) are found as given and always stay. Beyond them generous generators propose
spans: anything with an @, spelled-out addresses, digit groups, bank and identity numbers, IPv6 and hardware addresses.
Base spans cannot cover spelled-out addresses, bank and identity numbers and the colon formats; those are settled by
their own checks (`valid`), whatever the rest of the corpus holds. Of the others, features of a candidate's
format and of its context go to gradient-boosted trees. There are no labels of personal data, so the trees learn from
the fixed formats: a candidate that a base span covers is positive, any other unlabelled. What defines a base format
(the plus sign, the check digit) is no feature, or the trees could only repeat the rules. Probabilities are calibrated on a
fold that the trees have not seen; the threshold is the least one that reaches `PRECISION` there, so that text of a
clean document stays.

Texts are read once. The trees are fitted on all candidates outside that fold and calibrated on all within it: candidates
of the same bins are counted together, and each level of a tree is one job that adds up gradients by node, feature and
bin. The sums are of whole numbers (`UNIT`), so the model does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm.common import Intervals, join_spans, read, whole
from larkspan.session import cut_lineage

KINDS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "private": 4}

# Fixed patterns of the query contract.
# An email is its domain after a run of local characters, so that a long run without an @ is read once only; a number
# that starts within a run of digits cannot match where the whole run does not.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

GENERATORS = [
    re.compile(r"(?<![^\s@<>(),;:\"])[^\s@<>(),;:\"]+@[^\s@<>(),;:\"]+"),
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)+", re.IGNORECASE),
    re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}"),
    re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    re.compile(r"\b(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}\b"),
]
SPELLED, IBAN, SSN, COLONS = 1, 3, 4, 5  # generators whose formats no base rule covers
CUES = re.compile(r"(?:mail|phone|tel|call|mobile|contact|card|visa|iban|ssn|addr|ip)\W{0,3}(?:\w{1,6}\W{0,3})?$", re.IGNORECASE)
FEATURES = [
    "length", "digits", "letters", "ats", "dots", "dashes", "blanks", "brackets", "colons", "groups", "longest_group", "shortest_group",
    "first_group", "last_group", "letter_before", "letter_after", "blank_before", "cue", "digits_near",
]

LEAST_ROWS = 20
PRECISION = 0.95
TREES, DEPTH, RATE, CUTS = 40, 3, 0.2, 16
CELLS = 50_000  # of a task, about, in a pass over them
UNIT = 2**30  # gradients are whole numbers of 1 / UNIT
STEPS, MOST_ODDS = 2**10, 32  # log-odds are whole numbers of 1 / STEPS, up to MOST_ODDS either way


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and LOCAL.match(text, start - 1):
            start -= 1
        domain = start < at and DOMAIN.match(text, at + 1)
        if domain:
            least = domain.end()
            yield start, least
        else:
            least = max(least, at)
        at = text.find("@", max(at + 1, least))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test."""
    found = []
    if "@" in text:
        found += [("email", *span) for span in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def valid(text: str, start: int, end: int, generator: int) -> int:
    """The end of the span if a format that base rules cannot cover passes its own check, else 0."""
    span = text[start:end]
    if generator == SPELLED:
        last = re.split(r"[\])]", span)[-1].strip()
        return end if len(last) >= 2 and last.isalpha() else 0
    if generator == IBAN:  # a capital word after the number may have been taken for its last group
        for cut in [len(span), *(k for k in range(len(span) - 1, 0, -1) if span[k] == " ")]:
            code = span[:cut].replace(" ", "")
            if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return start + cut
        return 0
    if generator == SSN:
        area, group, serial = span.split("-")
        return end if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000" else 0
    parts = span.split(":")
    return end if len(parts) == 8 or (len(parts) == 6 and all(len(p) == 2 for p in parts)) else 0


def settled(text: str, found: list[tuple[int, int, int]], base: Intervals) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans that passed their own checks outside the base spans, and the candidates that are left to the trees."""
    own = [(s, e) for s, last, g in found if g in (SPELLED, IBAN, SSN, COLONS) if (e := valid(text, s, last, g)) and not base.meets(s, e)]
    sure = Intervals(own)
    return select([(1.0, s, e) for s, e in own]), [(s, e) for s, e, g in found if g not in (SPELLED, IBAN, SSN, COLONS) and not sure.meets(s, e)]


def features_of(text: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end].lstrip("+"), text[max(0, start - 24) : start], text[end : end + 24]
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    return [
        len(span), sum(groups), sum(c.isalpha() for c in span), span.count("@"), span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count("["),
        span.count(":"), len(groups), max(groups), min(groups), groups[0], groups[-1], float(before[-1:].isalpha()), float(after[:1].isalpha()),
        float(not before or before[-1].isspace()), float(bool(CUES.search(before))), len(DIGIT.findall(before)) + len(DIGIT.findall(after)),
    ]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of all proposals; they may overlap."""
    if "@" not in text and ":" not in text and not DIGIT.search(text) and "at" not in text.lower():
        return []
    found = []
    for g, pattern in enumerate(GENERATORS):
        if (g == 0 and "@" not in text) or (g == 1 and "at]" not in text.lower() and "at)" not in text.lower()):
            continue
        found += [(m.start(), m.end(), g) for m in pattern.finditer(text)]
    return found


@dataclass
class Boosted:
    """Gradient-boosted trees of fixed depth for a yes-no target, on binned features."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def total(self, binned: np.ndarray) -> np.ndarray:
        total = np.full(len(binned), self.start)
        for features, cuts, leaves in self.trees:
            total += leaves[_walk(binned, features, cuts, DEPTH)]
        return total

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds in whole numbers of 1 / STEPS: few enough values to be counted."""
        return np.rint(np.clip(self.total(self.bins(x)), -MOST_ODDS, MOST_ODDS) * STEPS).astype(np.int64)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(self.odds(x))

    def _scaled(self, odds: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * odds / STEPS + b, -30, 30)))

    def sums(self, binned: np.ndarray, counts: np.ndarray, hits: np.ndarray, features: np.ndarray, cuts: np.ndarray, level: int) -> np.ndarray:
        """Gradients and second derivatives of rows that stand for `counts` each, `hits` of them positive, in whole
        numbers of 1 / UNIT: by which of the two, node of the level, feature and bin, flat."""
        p = 1 / (1 + np.exp(-np.clip(self.total(binned), -30, 30)))
        grad = hits * UNIT - counts * np.rint(p * UNIT).astype(np.int64)
        hess = counts * np.rint(p * (1 - p) * UNIT).astype(np.int64)
        wide = binned.shape[1]
        slots = ((_walk(binned, features, cuts, level)[:, None] * wide + np.arange(wide)) * (CUTS + 1) + binned).ravel()
        found = np.zeros((2, 2**level * wide * (CUTS + 1)), np.int64)
        np.add.at(found[0], slots, np.repeat(grad, wide))
        np.add.at(found[1], slots, np.repeat(hess, wide))
        return found.ravel()

    def grow(self, rate: float, gather: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Boosted:
        """Fit the trees; `gather` gives the `sums` of all rows for the tree begun (its features and cuts) at a level."""
        rate = min(max(rate, 1e-4), 1 - 1e-4)
        self.start = float(np.log(rate / (1 - rate)))
        inner = 2**DEPTH - 1
        for _ in range(TREES):
            features, cuts, leaves = np.zeros(inner, np.int64), np.full(inner, CUTS, np.int64), np.zeros(2**DEPTH)
            for level in range(DEPTH):
                grads, hesses = gather(features, cuts, level).reshape(2, 2**level, len(self.edges), CUTS + 1).cumsum(axis=3)
                for k, (g, h) in enumerate(zip(grads, hesses, strict=True)):
                    node = 2**level - 1 + k
                    features[node], cuts[node] = _best_cut(g / UNIT, h / UNIT)
                    if level == DEPTH - 1:
                        side_g, side_h = g[features[node], cuts[node]], h[features[node], cuts[node]]
                        leaves[2 * k] = RATE * side_g / (side_h + UNIT)
                        leaves[2 * k + 1] = RATE * (g[0, -1] - side_g) / (h[0, -1] - side_h + UNIT)
            self.trees.append((features, cuts, leaves))
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [_middles(*np.unique(c, return_counts=True)) for c in x.T]
        binned, ones, hits = self.bins(x), np.ones(len(y), np.int64), y.astype(np.int64)
        return self.grow(float(y.mean()), lambda features, cuts, level: self.sums(binned, ones, hits, features, cuts, level))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> Boosted:
        odds, at = np.unique(self.odds(x), return_inverse=True)
        return self.settle(odds, np.bincount(at), np.bincount(at, y), precision)

    def settle(self, odds: np.ndarray, counts: np.ndarray, hits: np.ndarray, precision: float) -> Boosted:
        """Platt scaling, and the least probability from which on the share of positives is `precision`, from the
        number of rows and of positive ones at each of the distinct log-odds."""
        from larkspan.llm.toxicity import fit_logistic

        twice, y = np.tile(odds / STEPS, 2)[:, None], np.repeat([1.0, 0.0], len(odds))
        self.scale = tuple(fit_logistic(twice, y, 1e-3, np.concatenate([hits, counts - hits]).astype(float)).tolist())
        p = self._scaled(odds)
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(hits[order]) / np.cumsum(counts[order])
        last = np.append(np.diff(p[order]) != 0, True)  # equal probabilities are taken together
        ok = np.flatnonzero((share >= precision) & last)
        self.threshold = max(0.5, float(p[order][ok[-1]])) if len(ok) else 2.0
        return self


def _walk(binned: np.ndarray, features: np.ndarray, cuts: np.ndarray, level: int) -> np.ndarray:
    """The node of each row among those of the level."""
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(level):
        node = 2 * node + 1 + (binned[rows, features[node]] > cuts[node])
    return node - (2**level - 1)


def _middles(seen: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """At most CUTS - 1 cuts, each midway between two neighbouring values, so that unseen values fall to the nearer side.

    Of more values, a cut is kept where the rows below it pass another share of 1 / CUTS, and the last one for shares
    beyond it.
    """
    middles = (seen[:-1] + seen[1:]) / 2
    if len(middles) > CUTS - 1:
        share = np.cumsum(counts) * CUTS // counts.sum()
        passed = np.diff(share[:-1], prepend=0) > 0
        passed[-1] |= share[-2] < CUTS - 1
        middles = middles[passed]
    return middles


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """The feature and the last bin on the left, from running sums over the bins of each feature."""
    all_g, all_h = g[0, -1], h[0, -1]
    g, h = g[:, :-1], h[:, :-1]
    gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
    k, at = divmod(int(gain.argmax()), CUTS)
    return (k, at) if gain[k, at] > 1e-9 else (0, CUTS)


FACTS = "doc_id long, kinds array<string>, starts array<int>, ends array<int>, sure_from array<int>, sure_upto array<int>, froms array<int>, upto array<int>, covered array<boolean>, features array<array<float>>"


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["_text"], strict=True):
                base = base_spans(text)
                taken = Intervals((s, e) for _, s, e in base)
                sure, found = settled(text, candidates(text), taken)
                covered = [taken.meets(s, e) for s, e in found]
                rows.append(
                    (doc_id, [k for k, _, _ in base], [s for _, s, _ in base], [e for _, _, e in base], [s for s, _ in sure], [e for _, e in sure],
                     [s for s, _ in found], [e for _, e in found], covered, [features_of(text, *c) for c in found])
                )
            yield pd.DataFrame(rows, columns=["doc_id", "kinds", "starts", "ends", "sure_from", "sure_upto", "froms", "upto", "covered", "features"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    return texts.mapInPandas(work, FACTS)


def counted(facts: DataFrame) -> DataFrame:
    """features, held, n, hits: the candidates with these features in the held-out fold or outside it, and how many a
    base span covers."""
    each = facts.filter(F.size("froms") > 0).select("doc_id", F.explode(F.arrays_zip("froms", "covered", "features")).alias("c")).select("doc_id", "c.*")
    held = F.pmod(F.xxhash64("doc_id", "froms", "features"), F.lit(4)) == 0
    return each.groupBy("features", held.alias("held")).agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("long")).alias("hits"))


def edges_of(rows: DataFrame) -> list[np.ndarray]:
    """`_middles` of each feature over all rows (features, n). Only cuts leave the tasks; a window holds the distinct
    values of one feature."""
    values = rows.select("n", F.posexplode("features").alias("k", "value")).groupBy("k", "value").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("k")
    up = each.orderBy("value")
    steps = values.select(
        "k", "value", F.lead("value").over(up).alias("next"), F.row_number().over(up).alias("at"), F.count("*").over(each).alias("kinds"),
        F.sum("n").over(up).alias("below"), F.sum("n").over(each).alias("total"), "n",
    )
    passed = F.expr(f"below * {CUTS} div total > (below - n) * {CUTS} div total OR (at = kinds - 1 AND below * {CUTS} div total < {CUTS - 1})")
    kept = steps.filter(F.col("next").isNotNull() & ((F.col("kinds") <= CUTS) | passed))
    found = kept.select("k", ((F.col("value").cast("double") + F.col("next")) / 2).alias("cut")).toPandas()
    return [np.sort(found["cut"][found["k"] == k].to_numpy(float)) for k in range(len(FEATURES))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _cells(rows: DataFrame, model: Boosted) -> DataFrame:
    """bins (a byte for each feature), n, hits."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            binned = model.bins(_matrix(batch["features"])).astype(np.uint8)
            yield pd.DataFrame({"bins": [row.tobytes() for row in binned], "n": batch["n"], "hits": batch["hits"]})

    binned = rows.select("features", "n", "hits").mapInPandas(work, "bins binary, n long, hits long")
    return binned.groupBy("bins").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def _blocks(cells: DataFrame, wide: int) -> RDD:
    """The cells as (bins, n, hits) arrays of a few thousand rows, kept for the passes over them. Few cells are few
    tasks, as a pass is short."""

    def work(rows: Iterator[Row]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        while block := list(islice(rows, 8192)):
            bins, n, hits = zip(*block, strict=True)
            yield np.frombuffer(b"".join(bins), np.uint8).reshape(-1, wide), np.array(n, np.int64), np.array(hits, np.int64)

    tasks = 1 + cells.count() // CELLS
    return cells.select("bins", "n", "hits").repartition(tasks).rdd.mapPartitions(work).persist(StorageLevel.MEMORY_AND_DISK)


def _odds(rows: DataFrame, model: Boosted) -> pd.DataFrame:
    """odds, n, hits: rows at each of the at most 2 * MOST_ODDS * STEPS + 1 log-odds."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"odds": model.odds(_matrix(batch["features"])), "n": batch["n"], "hits": batch["hits"]})

    each = rows.select("features", "n", "hits").mapInPandas(work, "odds long, n long, hits long")
    return each.groupBy("odds").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas().sort_values("odds")


def train(facts: DataFrame) -> Boosted | None:
    """Trees fitted and calibrated on all candidates; None where candidates of one kind only are there."""
    rows = cut_lineage(counted(facts))
    there = {r["held"]: (r["n"], r["hits"]) for r in rows.groupBy("held").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()}
    if len(there) < 2 or sum(n for n, _ in there.values()) < LEAST_ROWS or any(hits in (0, n) for n, hits in there.values()):
        return None
    model = Boosted(edges=edges_of(rows.filter("NOT held")))
    blocks = _blocks(cut_lineage(_cells(rows.filter("NOT held"), model)), len(model.edges))
    model.grow(there[False][1] / there[False][0], lambda *tree: blocks.map(lambda block: model.sums(*block, *tree)).treeReduce(np.add))
    blocks.unpersist()
    held = _odds(rows.filter("held"), model)
    return model.settle(held["odds"].to_numpy(), held["n"].to_numpy(), held["hits"].to_numpy(), PRECISION)


def select(spans: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of overlapping accepted spans the likeliest, then the longest, then the first."""
    taken, found = Intervals(), []
    for _, start, end in sorted(spans, key=lambda s: (-s[0], s[1] - s[2], s[1])):
        if not taken.meets(start, end):
            taken.add(start, end)
            found.append((start, end))
    return found


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans. Repeated rows are judged each; null ids stay; an empty table gives no rows.
    """
    facts = cut_lineage(_scan(docs, id_col, text_col))
    model = train(facts)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_private long"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                base = list(zip(r.kinds, r.starts, r.ends, strict=True))
                extra = list(zip(r.sure_from, r.sure_upto, strict=True))
                if model and len(r.froms):
                    chances = model.probability(np.array([f.tolist() for f in r.features], float))
                    free = zip(chances, r.froms, r.upto, r.covered, strict=True)
                    extra += select([(float(p), s, e) for p, s, e, c in free if p >= model.threshold and not c])
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest()
                spans = join_spans(base + [("private", s, e) for s, e in extra], KINDS)
                rows.append((r.doc_id, *(kinds.count(k) for k in ("email", "ip", "card", "phone")), digest, spans, len(extra)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_private"])

    return facts.mapInPandas(work, schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
