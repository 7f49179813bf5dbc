"""Token pieces packed into sequences of fixed capacity by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by hash into blocks of some thousand, and every
block is packed by several islands. An island's individuals are packings; crossover injects whole well-filled bins of
one parent into the other, bins that now hold a piece twice are opened, and the pieces that lost their place enter the
bin with the least room that holds them, largest first. After each round of generations an island's elite moves to the
next island of its block. The best island of a block wins; its bins that are not well filled are opened, and their
pieces are packed once more, from all blocks together, so that a block leaves no half-empty bin of its own.

Tables carry only numbers: texts are read once, by the tokenizing pass, and never shuffled.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.bpe import byte_letters, fixed_tokenizer
from larkspan.llm.common import read, whole
from larkspan.session import cut_lineage

CAPACITY = 4096
END_ID = 1
BLOCK = 4096  # pieces of a block
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2, 2, 6, 4
WELL_FILLED = 0.995


class WordIds(dict):
    """Token ids of whitespace-separated words, as little-endian bytes; a bounded cache kept by the Python worker.

    The tokenizer's own splits lie at every white space, so a text's ids are those of its words. Where the tokenizer
    lowers case, words are looked up in lower case.
    """

    MOST = 1_200_000
    # lower-case letters in their composed form: one piece of the tokenizer's split that its normaliser leaves alone
    PLAIN = re.compile("[a-zß-öø-ÿ]+")
    # letters for which lowering before or after the tokenizer's normalisation might differ
    ODD = re.compile("[^\x00-ɏ]|İ")
    WORD_END = re.compile("[a-zA-ZÀ-ÖØ-öø-įı-ɏ][.,]$")

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = fixed_tokenizer(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.MOST:
            self.clear()
        if self.PLAIN.fullmatch(word):
            # straight to the merges
            letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = self._packed([t.id for t in self.model.tokenize(letters)])
        elif self.WORD_END.search(word):
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = found
        return found

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        if self.lower and (text.isascii() or not self.ODD.search(text)):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_WORDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A document is its token ids and one end id, so a null or empty text is one piece of length 1. Only longer ones are
    cut. Repeated rows give pieces of their own.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path not in _WORDS:
            _WORDS[tokenizer_path] = WordIds(tokenizer_path)
        words = _WORDS[tokenizer_path]
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["_text"], strict=True):
                ids = words.of(text) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_text"))
    return texts.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(order: Iterator[int], sizes: np.ndarray, bins: np.ndarray, room: list[tuple[int, int]], opened: int, capacity: int) -> int:
    """Put pieces into the bins with the least room that holds them; `bins` is filled in. The number of bins."""
    for i in order:
        size = int(sizes[i])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, opened = capacity, opened, opened + 1
        bins[i] = b
        if left > size:
            insort(room, (left - size, b))
    return opened


def fresh(sizes: np.ndarray, capacity: int, rng: random.Random, noise: float) -> np.ndarray:
    """Best fit, largest first; `noise` shuffles the order a little."""
    keys = sizes * (1 + noise * np.array([rng.random() for _ in range(len(sizes))])) if noise else sizes
    bins = np.zeros(len(sizes), np.int64)
    best_fit(iter(np.argsort(-keys, kind="stable").tolist()), sizes, bins, [], 0, capacity)
    return bins


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean square fill of the bins: fewer bins first, then fuller ones."""
    loads = np.bincount(bins, sizes)
    return float(np.square(loads / capacity).sum() / max(1, len(loads)))


def crossover(own: np.ndarray, other: np.ndarray, sizes: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    loads = np.bincount(other, sizes)
    filled = np.flatnonzero(loads >= WELL_FILLED * capacity).tolist() or [int(loads.argmax())]
    chosen = rng.sample(filled, min(len(filled), max(1, len(loads) // 20)))
    injected = np.isin(other, chosen)
    opened = np.unique(own[injected])
    displaced = np.isin(own, opened) & ~injected
    kept = ~(injected | displaced)
    bins = np.full(len(own), -1, np.int64)
    names = {}
    _, bins[kept] = np.unique(own[kept], return_inverse=True)
    count = int(bins.max(initial=-1)) + 1
    for b in chosen:
        names[b] = count + len(names)
    bins[injected] = [names[b] for b in other[injected].tolist()]
    count += len(names)
    placed = bins >= 0
    free = capacity - np.bincount(bins[placed], sizes[placed], minlength=count).astype(np.int64)
    room = sorted((int(f), b) for b, f in enumerate(free.tolist()) if f > 0)
    loose = np.flatnonzero(displaced)
    best_fit(iter(loose[np.argsort(-sizes[loose], kind="stable")].tolist()), sizes, bins, room, count, capacity)
    return bins


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> np.ndarray:
    """The best packing after some generations that start from the elites and fresh packings."""
    rng = random.Random(seed)
    population = [*elites]
    while len(population) < POPULATION:
        population.append(fresh(sizes, capacity, rng, 0.0 if not population else 0.3))
    scored = [(fitness(p, sizes, capacity), p) for p in population]
    for _ in range(generations):
        own, other = rng.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        child = crossover(scored[own][1], scored[other][1], sizes, capacity, rng)
        worst = min(range(len(scored)), key=lambda k: scored[k][0])
        if (value := fitness(child, sizes, capacity)) > scored[worst][0]:
            scored[worst] = (value, child)
    return max(scored, key=lambda s: s[0])[1]


STATE = "block long, island int, rows array<long>, sizes array<int>, bins array<int>, value double"


def _evolved(states: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One round of generations on every island; each is a row of its own."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in batch.itertuples():
                sizes = np.asarray(s.sizes, np.int64)
                elites = [np.asarray(b, np.int64) for b in (s.bins, s.visitor) if b is not None]
                best = evolve(sizes, elites, capacity, seed * 1_000_003 + s.block * 101 + s.island)
                out.append((s.block, s.island, s.rows, s.sizes, best.astype(np.int32), fitness(best, sizes, capacity)))
            yield pd.DataFrame(out, columns=["block", "island", "rows", "sizes", "bins", "value"])

    return cut_lineage(states.mapInPandas(work, STATE))


def _pack_blocks(items: DataFrame, capacity: int, block: int, seed: int, spread: int) -> DataFrame:
    """Best state of each block of `items` (row, length)."""
    blocks = max(1, -(-items.count() // block))
    dealt = items.groupBy(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("length", "row")), asc=False).alias("items")
    )
    none = F.lit(None).cast("array<int>")
    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    states = dealt.select(
        "block", islands.alias("island"), F.col("items.row").alias("rows"), F.col("items.length").cast("array<int>").alias("sizes"), none.alias("bins"), none.alias("visitor")
    ).repartition(spread, "block", "island")
    states = _evolved(states, capacity, seed)
    for r in range(1, ROUNDS):
        elites = states.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bins").alias("visitor"))
        states = _evolved(states.join(elites, ["block", "island"]).repartition(spread, "block", "island"), capacity, seed + r)
    return states.groupBy("block").agg(F.max_by(F.struct("rows", "sizes", "bins"), F.struct("value", -F.col("island"))).alias("s")).select("block", "s.*")


def _places(best: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """row, sequence_id, offset of the pieces; where bins stay open for the next level, both are null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples():
                bins, sizes, rows = (np.asarray(x, np.int64) for x in (s.bins, s.sizes, s.rows))
                order = np.argsort(bins, kind="stable")
                bins, sizes, rows = bins[order], sizes[order], rows[order]
                loads = np.bincount(bins, sizes).astype(np.int64)
                offsets = np.cumsum(sizes) - sizes - (np.cumsum(loads) - loads)[bins]
                kept = last | (loads[bins] >= WELL_FILLED * capacity)
                ids = (level << 56) + (s.block << 24) + bins
                yield pd.DataFrame(
                    {"row": rows, "length": sizes, "sequence_id": pd.array(np.where(kept, ids, 0), "Int64"), "offset": offsets, "kept": kept}
                )

    return cut_lineage(best.mapInPandas(work, "row long, length long, sequence_id long, offset long, kept boolean"))


def pack(found: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, levels: int = 3) -> DataFrame:
    """`found` (pieces with their length) with sequence_id and offset. Every piece is placed exactly once."""
    spark = found.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    items = rows.filter(F.col("length") < capacity).select("row", "length")
    placed = rows.filter(F.col("length") >= capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for level in range(1, levels + 1):
        places = _places(_pack_blocks(items, capacity, block, level, spread), capacity, level, level == levels)
        placed = placed.unionByName(places.filter("kept").select("row", "sequence_id", "offset"))
        items = places.filter("not kept").select("row", "length")
    return rows.join(placed, "row").drop("row")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
