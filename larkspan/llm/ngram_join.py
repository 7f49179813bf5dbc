"""Jaccard join on word n-grams by a MinHash LSH forest, with exact verification.

1. Each whole text becomes the set of its 5-word shingles. Texts with equal sets are one class (found by the tree
   merge of the exact deduplication); from here on only one representative of a class counts.
2. The forest: every tree orders the representatives by a string of minhash values. Two that share a prefix of depth d
   in any tree are candidates. Prefixes are shortened from the full depth on until the chance of meeting at the
   threshold reaches the target recall.
3. Candidates that hang together are brought together in cells of bounded size, with their shingle sets read from the
   texts once more. A cell is packed into one row and compares its own members at once: each is absorbed by the first member
   it is linked to, directly or over others.
4. Cells of a large group that share a prefix meet in pairs of packed rows. Every two representatives meet in one pair of
   cells only, so links are counted there; a pair gives back packed counts, and links between members that still stand for
   themselves. A group of n near copies moves one row per cell and pair of cells and no row per member and pair.
5. Connected components of the absorbed members and these links are the classes of near duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import read, slices, whole
from larkspan.llm.exact_dedup import group_rows, keep_rows
from larkspan.session import cut_lineage

NGRAM = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity 0.8
TREES, DEEPEST, RECALL = 20, 6, 0.999
CELL, CELL_GRAMS = 1024, 400_000  # members and shingles of a cell; a longer text is a cell alone
SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
PRIME = np.uint64(0x9E3779B97F4A7C15)


def prefix_depth(trees: int = TREES, deepest: int = DEEPEST, similarity: float = NUMERATOR / DENOMINATOR, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity still meets in some tree with the target probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: WordHashes, n: int = NGRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the set of n-word shingles; a shorter text is one shingle, one without words none."""
    words = [w for w in text.translate(SPACES).split(" ") if w]
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(codes):
        return codes
    size = min(n, len(codes))
    total = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        total = total * PRIME + codes[k : k + len(total)]
    return np.unique(mixed(total + np.uint64(size)))


def minhash_prefixes(sets: list[np.ndarray], trees: int, depth: int) -> np.ndarray:
    """Keys of the first `depth` minhash values of each set in each tree. The sets must not be empty."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, trees * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), trees), np.uint64)
    for t in range(trees):
        key = np.full(len(sets), t + 1, np.uint64)
        for k in range(depth):
            values = np.minimum.reduceat(mixed(flat * a[t * DEEPEST + k]), starts)
            key = mixed(key * PRIME + values)
        keys[:, t] = key
    return keys


def _facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, row number, the key of its shingle set, and its prefix keys."""
    depth = prefix_depth()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            for start, end in slices([*map(len, texts)]):
                known = WordHashes()
                sets = [shingles(t, known) for t in texts[start:end]]
                full = [k for k, s in enumerate(sets) if len(s)]
                prefixes: list = [[]] * len(sets)
                if full:
                    for k, row in zip(full, minhash_prefixes([sets[k] for k in full], TREES, depth).view(np.int64), strict=True):
                        prefixes[k] = row
                part = batch.iloc[start:end]
                yield pd.DataFrame(
                    {"_id": part["_id"].astype("Int64"), "_row": part["_row"], "_check": part["_check"], "_text_check": part["_check"], "_bytes": [len(s) for s in sets],
                     "_sha": [hashlib.blake2b(s.tobytes(), digest_size=20).digest() for s in sets], "prefixes": prefixes}
                ).assign(_check=0)

    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(text).alias("_check"), text.alias("_text")
    )
    return cut_lineage(rows.mapInPandas(work, "_id long, _row long, _check long, _text_check long, _bytes int, _sha binary, prefixes array<long>"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of `edges` (a, b).

    Every round each node takes the smallest root of its neighbours, then the root of its root; rounds go on until
    none changes. Each round is written once and read by the next.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    roots = cut_lineage(roots.withColumn("changed", F.lit(True)))
    while roots.filter("changed").limit(1).count():
        before = roots.select("node", F.col("root").alias("before"))
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        best = before.join(seen, "node").select("node", "before", F.least("before", "seen").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = cut_lineage(
            best.join(jump, "root").select("node", F.least("root", "above").alias("root"), (F.least("root", "above") != F.col("before")).alias("changed"))
        )
    return roots.select("node", "root")


def _cells(prefixes: DataFrame, sizes: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """(node, part, cell) of all candidates, and the pairs of cells (a < b) whose members share a prefix.

    Candidates of different `part` have no prefix in common, not even over others.
    """
    shared = prefixes.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a")
    met = cut_lineage(prefixes.join(shared, "key"))
    roots = cut_lineage(components(met.filter("a <> node").select("a", F.col("node").alias("b"))).join(sizes, "node"))
    weight = F.greatest(F.lit(1 / cell), F.col("grams") / CELL_GRAMS)
    load = cut_lineage(roots.groupBy("root").agg(F.sum(weight).alias("cells")))
    # large groups are cut into cells by hash; small ones share cells, by the hash of their root
    small = max(1, int(load.filter("cells <= 0.5").agg(F.sum("cells")).first()[0] or 0) + 1)
    parts = F.ceil("cells")
    home = F.when(F.col("cells") > 0.5, F.xxhash64("root", F.pmod(F.xxhash64("node"), parts))).otherwise(F.pmod(F.xxhash64("root"), F.lit(small)))
    members = cut_lineage(roots.join(load, "root").select("node", F.col("root").alias("part"), home.alias("cell")))
    told = met.join(members, "node").select("key", "cell").distinct().groupBy("key").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    crossing = told.filter(F.size("cells") > 1).select(F.explode("cells").alias("a"), "cells").select("a", F.explode("cells").alias("b")).filter("a < b")
    return members, cut_lineage(crossing.distinct())


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, part, cell and shingle set of the wanted representatives, from a second reading of the texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # repeated rows of a representative come together; one of them is enough
        for batch in batches:
            batch = batch[[not (x in seen or seen.add(x)) for x in batch["node"]]]
            for start, end in slices([*map(len, batch["_text"])]):
                known, part = WordHashes(), batch.iloc[start:end]
                yield part[["node", "part", "cell"]].assign(grams=[shingles(t, known).view(np.int64) for t in part["_text"]])

    text = whole(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("check"), text.alias("_text"))
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["_id"]) & (texts["check"] == wanted["_text_check"]))
    return found.select("node", "part", "cell", "_text").mapInPandas(work, "node long, part long, cell long, grams array<long>")


def links_between(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """All (i, j) with a Jaccard similarity of at least 0.8; with `same` only those with i < j."""
    _, ids = np.unique(np.concatenate(left if same else [*left, *right]), return_inverse=True)
    sizes = np.array([len(s) for s in left])
    lefts = np.split(ids[: sizes.sum()], np.cumsum(sizes)[:-1])
    others = sizes if same else np.array([len(s) for s in right])
    flat = ids if same else ids[sizes.sum() :]
    starts, width, found = np.cumsum(others) - others, int(ids.max()) + 1, []
    for i, own in enumerate(lefts):
        mark = np.zeros(width, np.int32)
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        near = np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (len(own) + others - both))
        found += [(i, int(j)) for j in near if not same or j > i]
    return found


class Roots:
    """Members by the first of those they are linked to; values are places in a list."""

    def __init__(self, roots: list[int]):
        self.roots = roots

    def top(self, k: int) -> int:
        while self.roots[k] != k:
            self.roots[k] = self.roots[self.roots[k]]
            k = self.roots[k]
        return k

    def join(self, i: int, j: int) -> bool:
        low, high = sorted((self.top(i), self.top(j)))
        self.roots[high] = low
        return low != high


PACKED = ["nodes", "parts", "sizes", "grams", "roots", "counts"]


def _ints(values) -> bytes:
    return np.asarray(values, np.int64).tobytes()


class Cell:
    """A packed cell: its members by part and node, with their shingle sets."""

    def __init__(self, row):
        self.nodes, self.parts, self.sizes, grams, self.roots = (np.frombuffer(row[c], np.int64) for c in PACKED[:-1])
        self.sets = np.split(grams, np.cumsum(self.sizes)[:-1])

    def spans(self) -> dict[int, tuple[int, int]]:
        """The places of the members of each part."""
        cuts = [0, *(np.flatnonzero(np.diff(self.parts)) + 1).tolist(), len(self.parts)]
        return {int(self.parts[a]): (a, b) for a, b in zip(cuts, cuts[1:], strict=False)}


def gathered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The packed cell, with the links between its own members: their counts, and who absorbed whom (by place)."""
    rows = rows.drop_duplicates("node").sort_values(["part", "node"])
    sets, parts = rows["grams"].tolist(), rows["part"].to_numpy()
    counts, roots = np.zeros(len(sets), np.int64), Roots(list(range(len(sets))))
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i, j in links_between(sets[a:b], sets[a:b], True) if b - a > 1 else []:
            counts[[a + i, a + j]] += 1
            roots.join(a + i, a + j)
    grams = np.concatenate(sets).tobytes()
    packed = (rows["node"], parts, [*map(len, sets)], None, [roots.top(k) for k in range(len(sets))], counts)
    return pd.DataFrame([{"cell": key[0]} | {c: grams if c == "grams" else _ints(v) for c, v in zip(PACKED, packed, strict=True)}])


def crossed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The links between two cells: for each cell the counts of its members, and links between absorbing members."""
    sides = {row.cell: Cell(row._asdict()) for row in rows.itertuples()}
    left, right = (sides[k] for k in key)
    shift = len(left.nodes)
    counts = np.zeros(shift + len(right.nodes), np.int64)
    roots = Roots([*left.roots.tolist(), *(right.roots + shift).tolist()])
    nodes, edges = np.concatenate([left.nodes, right.nodes]), []
    others = right.spans()
    for part, (a, b) in left.spans().items():
        c, d = others.get(part, (0, 0))
        for i, j in links_between(left.sets[a:b], right.sets[c:d], False) if d > c else []:
            i, j = a + i, shift + c + j
            counts[[i, j]] += 1
            x, y = roots.top(i), roots.top(j)
            if roots.join(x, y):
                edges.append((int(nodes[x]), int(nodes[y])))
    from_, to = [x for x, _ in edges], [y for _, y in edges]
    out = [(key[0], counts[:shift].tobytes(), from_, to), (key[1], counts[shift:].tobytes(), [], [])]
    return pd.DataFrame(out, columns=["cell", "counts", "from", "to"])


def counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The number of links and the absorbing member of each linked member of a cell, from all its packed counts."""
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    own = rows[rows["nodes"].notna()].iloc[0]
    nodes, roots = np.frombuffer(own["nodes"], np.int64), np.frombuffer(own["roots"], np.int64)
    return pd.DataFrame({"node": nodes, "n_links": total, "root": nodes[roots]})[total > 0]


def _linked(sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n_links and root of each representative with links, links between roots of different cells)."""
    cells = cut_lineage(sets.groupBy("cell").applyInPandas(gathered, "cell long, " + ", ".join(f"{c} binary" for c in PACKED)))
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cell")).join(cells.drop("counts"), "cell")
    between = cut_lineage(sides.groupBy("a", "b").applyInPandas(crossed, "cell long, counts binary, from array<long>, to array<long>"))
    own = cells.select("cell", "nodes", "roots", "counts")
    none = F.lit(None).cast("binary")
    counts = own.unionByName(between.select("cell", none.alias("nodes"), none.alias("roots"), "counts"))
    linked = cut_lineage(counts.groupBy("cell").applyInPandas(counted, "node long, n_links long, root long"))
    return linked, between.select(F.inline(F.arrays_zip("from", "to"))).toDF("a", "b")


def _classified(docs: DataFrame, id_col: str, text_col: str, cell: int) -> DataFrame:
    """Each row with its copies (_keep, _keep_row, _size) and, where it is linked, node, first (id and node) and n_links."""
    facts = _facts(docs, id_col, text_col)
    rows = cut_lineage(group_rows(facts.drop("prefixes"), "smallest"))
    heads = facts.join(rows.filter("_row = _keep_row").select("_row"), "_row", "left_semi")
    prefixes = cut_lineage(heads.select(F.col("_row").alias("node"), F.explode("prefixes").alias("key")))
    members, pairs = _cells(prefixes, heads.select(F.col("_row").alias("node"), F.col("_bytes").alias("grams")), cell)
    wanted = members.join(heads.select(F.col("_row").alias("node"), "_id", "_text_check"), "node")
    linked, between = _linked(_sets(docs, wanted, id_col, text_col), pairs)
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(between))
    counts = linked.select("node", "n_links")
    ids = rows.filter("_row = _keep_row").select(F.col("_row").alias("node"), F.col("_id").alias("head"))
    known = roots.join(ids, "node").join(counts, "node")
    firsts = known.groupBy("root").agg(F.min(F.struct("head", "node")).alias("first"))
    classes = known.join(firsts, "root").select("node", "first", "n_links")
    return rows.join(classes, rows["_keep_row"] == classes["node"], "left")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_copies, n_links.

    `copy_of` is the smallest id of the documents with the same shingle set and `n_copies` their number; `n_links` is
    the number of other such representatives with a similarity of at least 0.8. `class_id` is the smallest id of all
    documents that are connected by links. Null and empty texts have no words and are copies of each other, without
    links. A text of fewer than five words is one shingle. Repeated rows are copies; a null id sorts first. An empty
    table gives no rows.
    """
    return _classified(docs, id_col, text_col, cell).select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("node").isNull(), F.col("_keep")).otherwise(F.col("first.head")).alias("class_id"),
        F.col("_keep").alias("copy_of"),
        F.col("_size").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_class(docs: DataFrame) -> DataFrame:
    """One document of each class of near duplicates (the smallest id), with all its columns; of repeated rows one."""
    found = _classified(docs, "doc_id", "text", CELL)
    kept = found.filter((F.col("_row") == F.col("_keep_row")) & (F.col("node").isNull() | (F.col("node") == F.col("first.node"))))
    return keep_rows(docs, kept.select(F.col("_id").alias("doc_id"), F.col("_text_check").alias("check")), F.xxhash64(whole("text")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))
