"""How document filters interact: what each removes in every order, over a sparse document-term matrix.

1. Shards. The words of a block of documents are numbered within the block and counted per document.
2. Dictionary. The distinct words of the shards meet in buckets of their checksums and get dense global numbers; the
   numbers go back to the shards. A word moves once for each shard and not for each document, packed with others.
3. Matrix. Every shard becomes compressed sparse rows: row bounds, global word numbers, counts. The sums of the rows are
   the words of the documents, the lengths of the rows their distinct words; these decide filters A and B.
4. The other flags join them (C and D from the characters, E from equal texts), and all documents become one mask of
   failed filters each. Masks are counted per part and labels, and all orders of the filters are read off these counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.bpe import pack_words, unpack_words
from larkspan.llm.common import read, shuffle_width, slices, whole
from larkspan.session import cut_lineage

FILTERS = "ABCDE"
SHARD = 8_000_000  # characters of the texts of a shard; a longer text is a shard alone
BUCKET_WORDS = 2_000_000  # words of all shards in a bucket of the dictionary, on average
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
CSR = "shard long, ids array<long>, parts array<string>, digests array<binary>, bits array<int>, bounds binary, columns binary, counts binary"
FLAGS = "id long, part string, digest binary, n_words long, n_distinct long, bits int"


class Numbers(dict):
    """Words by their number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def character_bits(text: str, data: bytes) -> int:
    """The bits of filters C (many capitals) and D (signs)."""
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return 4 * (100 * capitals > 2 * len(text)) + 8 * (len(data) != len(data.translate(None, SIGNS)))


def shrink(numbers: np.ndarray) -> bytes:
    """An array as compressed bytes."""
    data = numbers.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def grow(packed: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), kind)


def _shards(docs: DataFrame, id_col: str, text_col: str, part_col: str, size: int) -> DataFrame:
    """Blocks of documents with their counts of words; the words of a block are numbered in the order of their checksum."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch["id"].astype("Int64").astype(object).where(batch["id"].notna(), None).tolist()
            texts, parts = batch["text"].tolist(), batch["part"].tolist()
            for start, end in slices([*map(len, texts)], size):
                known, columns, counts, bounds, digests, bits = Numbers(), [], [], [0], [], []
                for text in texts[start:end]:
                    data = text.encode()
                    words = data.split()  # bytes are split at the six ASCII spaces only
                    found, times = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
                    columns.append(found)
                    counts.append(times.astype(np.int32))
                    bounds.append(bounds[-1] + len(found))
                    digests.append(hashlib.sha256(data).digest())
                    bits.append(character_bits(text, data))
                listed = list(known)
                order = np.argsort(_checksums(listed), kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                yield pd.DataFrame([{
                    "shard": number, "ids": ids[start:end], "parts": parts[start:end], "digests": digests, "bits": bits, "bounds": shrink(np.array(bounds, np.int32)),
                    "columns": shrink(place[np.concatenate(columns)]), "counts": shrink(np.concatenate(counts)),
                    "words": pack_words([listed[k] for k in order.tolist()]), "n_words": len(listed),
                }])
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole(text_col).alias("text"))
    return cut_lineage(rows.mapInPandas(work, f"{CSR}, words binary, n_words long"))


def _checksums(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _numbered(shards: DataFrame) -> DataFrame:
    """Per bucket of checksums the distinct words (shard null), and per shard and bucket the numbers of its words there."""
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    n = max(shuffle_width(shards.sparkSession), -(-total // BUCKET_WORDS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, packed in zip(batch["shard"], batch["words"], strict=True):
                words = unpack_words(packed)
                cuts = np.searchsorted((_checksums(words) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1)).tolist()
                rows = [(shard, k, pack_words(words[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield pd.DataFrame(rows, columns=["shard", "bucket", "words"])

    def encode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = Numbers()
        out = [(shard, key[0], shrink(np.array([known[w] for w in unpack_words(packed)], np.int32)), None, None) for shard, packed in zip(rows["shard"], rows["words"], strict=True)]
        out.append((None, key[0], None, pack_words(list(known)), len(known)))
        found = pd.DataFrame(out, columns=["shard", "bucket", "numbers", "words", "n"])
        return found.astype({"shard": "Int64", "n": "Int64"})

    dealt = shards.select("shard", "words").mapInPandas(deal, "shard long, bucket int, words binary")
    return cut_lineage(dealt.groupBy("bucket").applyInPandas(encode, "shard long, bucket int, numbers binary, words binary, n long"))


def _starts(numbered: DataFrame) -> DataFrame:
    """bucket, before: how many words lie in the buckets before. One row per bucket passes the driver."""
    counts = sorted((r.bucket, r.n) for r in numbered.filter("shard is null").select("bucket", "n").collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    return numbered.sparkSession.createDataFrame([(b, s) for (b, _), s in zip(counts, before, strict=False)], "bucket int, before long")


def dictionary(numbered: DataFrame) -> DataFrame:
    """word, word_id: the distinct words with their dense numbers from 0."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for before, packed in zip(batch["before"], batch["words"], strict=True):
                words = unpack_words(packed)
                yield pd.DataFrame({"word": [w.decode() for w in words], "word_id": np.arange(before, before + len(words))})

    words = numbered.filter("shard is null").select("bucket", "words").join(_starts(numbered), "bucket")
    return words.select("before", "words").mapInPandas(work, "word string, word_id long")


def _numbered_shards(docs: DataFrame, id_col: str, text_col: str, part_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(the shards with the numbers of their words by bucket, the buckets of `_numbered`)."""
    local = _shards(docs, id_col, text_col, part_col, size)
    numbered = _numbered(local)
    mine = numbered.filter("shard is not null").select("shard", "bucket", "numbers").join(_starts(numbered), "bucket")
    lists = mine.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("bucket", "before", "numbers"))).alias("n"))
    found = local.drop("words", "n_words").join(lists, "shard", "left").select("*", F.col("n.before").alias("before"), F.col("n.numbers").alias("numbers")).drop("n")
    return found, numbered


def _sparse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards with global numbers as columns, one at a time."""
    for batch in batches:
        for k, row in enumerate(batch.itertuples()):
            numbers = [grow(x) + np.int64(b) for b, x in zip(row.before, row.numbers, strict=True)] if row.numbers is not None else []
            columns = np.concatenate([*numbers, np.zeros(0, np.int64)])[grow(row.columns)]
            yield batch.iloc[k : k + 1].drop(columns=["before", "numbers"]).assign(columns=[shrink(columns)])


def _flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            bounds = grow(row.bounds)
            sums = np.concatenate([[0], np.cumsum(grow(row.counts), dtype=np.int64)])[bounds]
            n_words, n_distinct = np.diff(sums), np.diff(bounds)
            bits = (n_words < 200) + 2 * (100 * n_distinct < 50 * n_words) + np.asarray(row.bits)
            ids = pd.array([None if x is None or x != x else int(x) for x in row.ids], "Int64")
            yield pd.DataFrame({"id": ids, "part": row.parts, "digest": row.digests, "n_words": n_words, "n_distinct": n_distinct, "bits": bits})


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(shards of compressed sparse rows, the dictionary word, word_id).

    A shard holds ids, parts, digests of the texts and bits of filters C and D of its documents, and the packed arrays
    `bounds`, `columns` (long) and `counts` (see `grow`): row k has the words `columns[bounds[k] : bounds[k + 1]]`, each
    `counts` times. Null texts have no words. Repeated rows are rows of their own, null ids and parts stay (a null part is
    the empty string). An empty table gives no shards.
    """
    found, numbered = _numbered_shards(docs, id_col, text_col, part_col, size)
    return found.mapInPandas(_sparse_rows, CSR), dictionary(numbered)


def row_flags(matrix: DataFrame) -> DataFrame:
    """id, part, digest, n_words, n_distinct and bits (A to D) of every document of the matrix."""
    return matrix.mapInPandas(_flags, FLAGS)


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", size: int = SHARD) -> DataFrame:
    """`row_flags` of the `term_matrix`, both in one Python step, so that a task has one worker and not two."""
    found, _ = _numbered_shards(docs, id_col, text_col, part_col, size)
    return found.mapInPandas(lambda batches: _flags(_sparse_rows(batches)), FLAGS)


def masks(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E), good, toxic and n: documents counted by what they fail.

    E fails where a smaller id has the same text. Rows with the same id and text are the same document for E, a null id
    is neither smaller nor larger. Labels are those of the id (any of several rows); a null id has none.
    """
    # copies meet in groups of equal id first, so that neither a text nor a missing id is one large key
    salt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    rows = flags.groupBy("id", "part", "digest", "bits").agg(F.count("*").alias("n")).withColumn("salt", salt)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = rows.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    no = F.lit(False)
    texts = cut_lineage(
        known.groupBy("digest", "bits", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
            F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
        )
    )
    least = texts.groupBy("digest").agg(F.min("low").alias("least"))
    first = F.col("n_null") + F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("bits").alias("mask"), first.alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - first).alias("n"))))
    cells = texts.join(least, "digest").select("part", "good", "toxic", split.alias("cell")).filter("cell.n > 0")
    return cells.groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic").agg(F.sum("cell.n").alias("n"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts of masks (bit k is the k-th filter).

    What a filter does depends on the set of those before it, not on their order: the counts are made once for each
    filter and set, and the orders pick theirs.
    """
    k = len(filters)
    cases = [(f, s) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    case = F.explode(F.array(*[F.struct(F.lit(1 << f).alias("own"), F.lit(s).alias("before")) for f, s in cases])).alias("case")
    rows = cells.select("part", "mask", "good", "toxic", "n", case).select("*", "case.own", "case.before").drop("case")
    own, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = own & ~before

    def total(test) -> F.Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    counts = rows.groupBy("part", "own", "before").agg(
        total(~own & ~before).alias("kept"), total(removed).alias("removed"), total(own & before).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )
    orders = [
        ("".join(filters[f] for f in order), step + 1, 1 << order[step], sum(1 << f for f in order[:step]))
        for order in permutations(range(k))
        for step in range(k)
    ]
    spark = cells.sparkSession
    weights = spark.createDataFrame([(s, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range((1 << k) - 1)], "before int, weight long")
    shares = counts.join(F.broadcast(weights), "before").groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    places = spark.createDataFrame(orders, "filter_order string, step int, own int, before int")
    return counts.join(shares, ["part", "own"]).join(F.broadcast(places), ["own", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the five filters over whole texts, per value of `part_col` (null: empty string).

    Null texts are empty: they fail A, and E from the second on. Repeated rows count each; see `masks` for ties of ids. An
    empty table gives no rows; other columns are not read.
    """
    return audit(cut_lineage(masks(document_flags(docs, id_col, text_col, part_col), labels)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]'), lambda x: x <> '') as words
  from documents
), f as (
  select doc_id, part,
         (case when len(words) < 200 then 1 else 0 end)
         + (case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end)
         + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end)
         + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as mask
  from w
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id
), c as (
  select part, mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n
  from f left join l using (doc_id) group by all
), x as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as b),
o as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from x a, x b, x c, x d, x e where a.b + b.b + c.b + d.b + e.b = 31 and len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), s as (
  select filter_order, cast(step as int) as step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as before
  from o, (select unnest(generate_series(1, 5)) as step)
), r as (
  select part, filter_order, step, own,
         cast(sum(case when mask & (own | before) = 0 then n else 0 end) as bigint) as kept,
         cast(sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as bigint) as removed,
         cast(sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as bigint) as redundant,
         cast(sum(case when mask = own then n else 0 end) as bigint) as unique_fails,
         cast(sum(case when mask & own <> 0 and mask & before = 0 then n * good else 0 end) as bigint) as good_lost,
         cast(sum(case when mask & own <> 0 and mask & before = 0 then n * toxic else 0 end) as bigint) as toxic_lost
  from c, s group by part, filter_order, step, own
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from r
"""
