"""Secrets: fixed formats, and strings that pass a battery of randomness tests.

Base formats are found as given. Beyond them every run of 16 or more key characters is a candidate:

* its encoding is inferred from its characters (hex, base 32, letters and digits, base 64, ...);
* three tests ask whether it could be uniformly random in that alphabet: chi-squared uniformity, runs above and below
  the middle, and serial correlation; Fisher's method joins them, and a string that fails is no key;
* the likelihood ratio of "uniform in the alphabet" to "text of this corpus" (characters counted over all documents;
  pairs of characters would let the corpus's own keys explain each other) bounds the p-value of the null hypothesis "ordinary text": under text a ratio of r has a chance of 1 / r
  at most. Longer strings can reach smaller p-values, so candidates are judged within classes of length: in each the
  Benjamini-Hochberg rule, over all candidates of the corpus, keeps the share of false discoveries below `FDR`.

Texts are read once. The pass leaves spans, candidates and character counts; what follows works on those few rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import Intervals, join_spans, read, slices, whole
from larkspan.session import cut_lineage

KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed patterns of the query contract; letters of the names stand in either case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
CANDIDATE = re.compile("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

LEAST = 16
CLASSES = (16, 24, 32, 48, 80)  # lower ends of the classes of length
FDR = 0.001
RANDOM_ENOUGH = 0.001
BINS = 4000  # of a tenth of a decade each
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower": DIGITS + LOWER,
    "upper": DIGITS + UPPER,
    "alnum": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
SYMBOLS = ALPHABETS["any"]
CODE = np.zeros(256, np.int16)
CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(1, len(SYMBOLS) + 1, dtype=np.int16)
WIDTH = len(SYMBOLS) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, without those that fail its length."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that lie in no base span."""
    if max(map(len, text.split()), default=0) < LEAST:
        return []
    taken = Intervals((s, e) for _, s, e in base)
    return [m.span() for m in CANDIDATE.finditer(text) if not taken.meets(*m.span())]


def char_counts(texts: list[str]) -> np.ndarray:
    """How often each key character occurs; 0 stands for all other characters."""
    counts = np.zeros(WIDTH, np.int64)
    for start, end in slices([*map(len, texts)]):
        counts += np.bincount(CODE[np.frombuffer("\n".join(texts[start:end]).encode("utf-8", "replace"), np.uint8)], minlength=WIDTH)
    return counts


def encoding_of(token: str) -> str:
    """The smallest alphabet that has all characters of the token."""
    chars = set(token.rstrip("="))
    return next(name for name, letters in ALPHABETS.items() if chars <= set(letters))


def upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def upper_chi2(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    return upper_normal(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def randomness(token: str) -> float:
    """Joint p-value of the battery under "uniformly random in its alphabet"."""
    token = token.rstrip("=")
    letters = ALPHABETS[encoding_of(token)]
    x, size = np.array([letters.index(c) for c in token]), len(letters)
    n = len(x)
    cells = max(2, min(size, n // 5))
    seen = np.bincount(x * cells // size, minlength=cells)
    due = np.bincount(np.arange(size) * cells // size, minlength=cells) * (n / size)
    p = [upper_chi2(float(((seen - due) ** 2 / due).sum()), cells - 1)]
    above = x >= size // 2
    n1, n2 = int(above.sum()), int(n - above.sum())
    if n1 and n2:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * n1 * n2 / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p.append(2 * upper_normal(abs(runs - mean) / spread))
    else:
        p.append(2.0 ** (1 - n))
    d = x - x.mean()
    total = float((d * d).sum())
    p.append(2 * upper_normal(abs(float((d[1:] * d[:-1]).sum()) / total) * math.sqrt(n)) if total else 0.0)
    return upper_chi2(-2 * sum(math.log(max(v, 1e-300)) for v in p), 6)


def log_text(token: str, model: np.ndarray) -> float:
    """Log-likelihood of the token as text."""
    return float(model[CODE[np.frombuffer(token.rstrip("=").encode(), np.uint8)]].sum())


def evidence(token: str, model: np.ndarray) -> tuple[int, float, float]:
    """(class of length, -10 * log10 of the p-value under text, p-value under randomness)."""
    bare = token.rstrip("=")
    ratio = -len(bare) * math.log(len(ALPHABETS[encoding_of(token)])) - log_text(token, model) - math.log(len(ALPHABETS))
    size = max(k for k, low in enumerate(CLASSES) if len(bare) >= low or k == 0)
    return size, max(0.0, 10 * ratio / math.log(10)), randomness(token)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and candidates of each document, and rows with the character counts of each batch."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["_text"], strict=True):
                base = base_spans(text)
                found = candidates(text, base)
                rows.append(
                    (doc_id, [k for k, _, _ in base], [s for _, s, _ in base], [e for _, _, e in base], [s for s, _ in found], [text[s:e] for s, e in found], None)
                )
            counts = char_counts(batch["_text"].tolist())
            used = np.flatnonzero(counts)
            rows.append((None, None, None, None, None, None, dict(zip(used.tolist(), counts[used].tolist(), strict=True))))
            yield pd.DataFrame(rows, columns=["doc_id", "kinds", "starts", "ends", "at", "tokens", "chars"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    return texts.mapInPandas(work, "doc_id long, kinds array<string>, starts array<int>, ends array<int>, at array<int>, tokens array<string>, chars map<int,long>")


def text_model(facts: DataFrame) -> np.ndarray:
    """Log-probability of each key character in all texts (a table of fixed size)."""
    rows = facts.filter("chars is not null").select(F.explode("chars").alias("char", "n")).groupBy("char").agg(F.sum("n").alias("n")).collect()
    counts = np.full(WIDTH, 0.5)
    for r in rows:
        counts[r["char"]] += r["n"]
    return np.log(counts / counts.sum())


def judge(facts: DataFrame, model: np.ndarray) -> DataFrame:
    """The documents of `facts` with class, evidence and randomness of each candidate."""
    held = facts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[evidence(t, held.value) for t in tokens] for tokens in batch["tokens"]]
            yield batch.assign(
                size=[[f[0] for f in x] for x in found], bin=[[min(BINS, int(f[1])) for f in x] for x in found], fits=[[f[2] >= RANDOM_ENOUGH for f in x] for x in found],
                lengths=[[len(t) for t in x] for x in batch["tokens"]],
            ).drop(columns=["tokens", "chars"])

    rows = facts.filter("chars is null")
    return rows.mapInPandas(work, "doc_id long, kinds array<string>, starts array<int>, ends array<int>, at array<int>, size array<int>, bin array<int>, fits array<boolean>, lengths array<int>")


def discovery_bins(judged: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per class of length the least evidence that the Benjamini-Hochberg rule accepts, over all candidates.

    Counts by class and bin have at most `len(CLASSES) * (BINS + 1)` rows whatever the corpus; a bin's p-value is its
    least evidence, which errs to the safe side.
    """
    each = judged.select(F.explode(F.arrays_zip("size", "bin")).alias("c")).select("c.*")
    counts = each.groupBy("size", "bin").agg(F.count("*").alias("n")).toPandas()
    cuts = {}
    for size, rows in counts.groupby("size"):
        rows = rows.sort_values("bin", ascending=False)
        ok = 10.0 ** (-rows["bin"] / 10) <= fdr * rows["n"].cumsum() / rows["n"].sum()
        if ok.any():
            cuts[int(size)] = int(rows.loc[ok, "bin"].min())
    return cuts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """(judged documents, text model, accepted evidence) of a corpus."""
    facts = cut_lineage(_scan(docs, id_col, text_col))
    model = text_model(facts)
    judged = cut_lineage(judge(facts, model))
    return judged, model, discovery_bins(judged)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. Repeated rows are judged each; null ids stay; an empty table gives no rows.
    """
    judged, _, cuts = fit(docs, id_col, text_col)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                base = list(zip(r.kinds, r.starts, r.ends, strict=True))
                found = zip(r.at, r.lengths, r.size, r.bin, r.fits, strict=True)
                extra = [("random", s, s + n) for s, n, size, b, fits in found if fits and b >= cuts.get(size, BINS + 1)]
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(join_spans(base, KINDS).encode()).hexdigest()
                rows.append((r.doc_id, *(kinds.count(k) for k in ("assign", "access", "hex")), digest, join_spans(base + extra, KINDS), len(extra)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return judged.mapInPandas(work, schema)


def cover(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with `mark` in place of each span; overlapping spans are one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(text: Column, model: np.ndarray, cuts: dict[int, int], mark: str = "[SECRET]") -> Column:
    """The text without its secrets, judged by a fitted model; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            spans = [(s, e) for _, s, e in base]
            for s, e in candidates(text, base):
                size, found, p = evidence(text[s:e], model)
                if p >= RANDOM_ENOUGH and int(found) >= cuts.get(size, BINS + 1):
                    spans.append((s, e))
            return cover(text, spans, mark) if spans else text

        return texts.map(one)

    return clean(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets covered; `n_chars`, where it is there, follows the new text."""
    _, model, cuts = fit(docs)
    clean = docs.withColumn("text", redacted(F.col("text"), model, cuts))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))
