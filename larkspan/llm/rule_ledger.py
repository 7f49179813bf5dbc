"""Quality rules as a bitmask ledger.

`measure` reads every text once. `ledger` evaluates every rule once on the measurements and packs the failures into
one integer per document. From then on texts are not needed: a policy is a mask, applying it is one bitwise AND, and
ablations (what would a policy keep without one of its rules?) come from one aggregate over the distinct masks, of
which there are at most 2 ** rules.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import read, whole

# Fixed values of the query contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

SPACES = " \t\n\x0b\x0c\r"
ASCII = bytes(range(128))
NO_LETTERS = bytes(b for b in range(256) if b > 127 or not chr(b).isalpha())

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "longest_word"]


def _rules() -> dict[str, Column]:
    """Rules by name, in the order of their bits. True: the document fails."""
    words = F.col("n_words")
    return {
        "few_words": words < 10,
        "repeated_passages": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        # a line said twice in a short text is no list
        "duplicate_lines": (F.col("n_dup_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "short_words": F.col("word_chars") < 2 * words,
        "long_words": F.col("word_chars") > 20 * words,
        "few_letters": 2 * F.col("n_letters") < F.col("word_chars"),
        "endless_word": F.col("longest_word") > 1000,
    }


RULES = ["few_words", "repeated_passages", "symbols", "duplicate_lines", "short_words", "long_words", "few_letters", "endless_word"]
BASE = ("few_words", "repeated_passages")
#: Versioned policies. A policy never changes once it has been used; a new version gets a new name.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "few_letters"),
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "few_letters", "endless_word"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def repeat_words(words: list[str] | list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, found, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            found += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return found


def _measured(text: str) -> tuple[int, ...]:
    data = text.encode()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    words = data.split()  # bytes are split at the ASCII spaces alone, strings at others too
    letters = len(data.translate(None, NO_LETTERS))
    if not text.isascii():
        words = [w.decode() for w in words]
        letters += sum(map(str.isalpha, data.translate(None, ASCII).decode()))
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        letters,
        max(map(len, words), default=0),
    )


def measures_of(text_col: str = "text") -> Column:
    """A struct of MEASURES for each whole text, in one Arrow pass; null counts as no text."""

    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_measured(t) for t in texts], columns=MEASURES, dtype="int64")

    return measures(whole(text_col))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each whole text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), measures_of(text_col).alias("m")).select("doc_id", "m.*")


def fail_bits() -> Column:
    """The failures of all rules on measured rows: bit k is set where rule k of RULES fails."""
    total = F.lit(0)
    for k, failed in enumerate(_rules().values()):
        total = total.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)))
    return total.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `fail_bits` of each row; every rule is evaluated once.

    Each row has its own entry: repeated rows and null ids stay, null and empty texts fail for too few words, other
    columns are left out whatever they are called. An empty table gives an empty ledger.
    """
    return measure(docs, id_col, text_col).withColumn("fail_bits", fail_bits())


def verdict(policy: str = CURRENT) -> Column:
    """True where no rule of the policy fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, *policies: str) -> DataFrame:
    """Per policy and rule of it: documents failing it, failing only it, and kept if it were left out.

    One aggregate over the masks of the ledger serves all policies; the rest works on at most 2 ** len(RULES) rows. An
    empty ledger gives no rows.
    """
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask"))
        for p in policies or (CURRENT,)
        for r in POLICIES[p]
    ]
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = counts.select("fail_bits", "n", F.explode(F.array(*cases)).alias("r")).select("fail_bits", "n", "r.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    passed = F.col("fail_bits").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not("bit")) == 0
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & passed, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(passed, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents whose failure bits pass the policy's mask, with all their columns.

    Nothing is joined, so repeated rows and null ids stay as they are. Empty texts have no words and go.
    """
    measured = docs.select(F.struct("*").alias("doc"), measures_of().alias("m")).select("doc", "m.*")
    return measured.withColumn("fail_bits", fail_bits()).filter(verdict(policy)).select("doc.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base measurements, the base verdict and the current policy's."""
    entries = ledger(read(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~verdict("base")).alias("base_failed"),
        (verdict("base") & verdict(CURRENT)).alias("kept"),
        "fail_bits",
    )


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does in each version of the policy, from one ledger of all documents."""
    return ablations(ledger(read(spark, sf_dir, "documents")), *POLICIES)


OP3_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), s as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] as g
  from (select doc_id, words, unnest(generate_series(1, len(words) - 4)) as i from w where len(words) >= 5)
), r as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from s) where c > 1),
       (select unnest(generate_series(0, 4)) as k)
  group by doc_id
), m as (
  select w.doc_id, cast(len(words) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]', '', 'g')) as n_letters,
         coalesce(list_max(list_transform(words, lambda x: length(x))), 0) as longest_word
  from w left join r using (doc_id)
), b as (
  select *, (case when n_words < 10 then 1 else 0 end)
         + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
         + (case when 10 * n_symbols > n_words then 4 else 0 end)
         + (case when n_dup_lines >= 4 and 10 * n_dup_lines > 3 * n_lines then 8 else 0 end)
         + (case when word_chars < 2 * n_words then 16 else 0 end)
         + (case when word_chars > 20 * n_words then 32 else 0 end)
         + (case when 2 * n_letters < word_chars then 64 else 0 end)
         + (case when longest_word > 1000 then 128 else 0 end) as bits
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & 3) <> 0 as base_failed, bits = 0 as kept, cast(bits as bigint) as fail_bits
from b
"""

_CASES = ", ".join(f"('{p}', '{r}', {1 << RULES.index(r)}, {mask(p)})" for p in POLICIES for r in POLICIES[p])

ABLATIONS_SQL = f"""
with o as ({OP3_SQL}), p(policy, rule, bit, mask) as (values {_CASES})
select policy, rule,
       cast(count(*) filter ((fail_bits & bit) <> 0) as bigint) as n_failed,
       cast(count(*) filter ((fail_bits & mask) = bit) as bigint) as n_failed_alone,
       cast(count(*) filter ((fail_bits & mask) in (0, bit)) as bigint) as n_kept_without
from o, p group by 1, 2
"""
