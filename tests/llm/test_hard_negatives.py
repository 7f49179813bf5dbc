import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm.hard_negatives import FAR, Block, Search, best, hard_negatives, op11_hard_negatives, suffix_norms

SCHEMA = "vec_id long, label long, vector array<long>, key string, a string, b string, windows string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, v, "k", "a", "b", "w") for i, x, v in rows], SCHEMA)


def brute(rows, asks, n_positives=5, n_negatives=3, low=(50, 100), high=(95, 100)):
    rows = [r for r in {(i, x, tuple(v)) for i, x, v in rows if i is not None and x is not None and v is not None}]
    out = []

    def score(v, w):
        return sum(a * b for a, b in zip(v, w, strict=False))

    for i, label, v in rows:
        if not asks(i):
            continue
        same = sorted((-score(v, w), j) for j, x, w in rows if x == label and j != i)[:n_positives]
        other = sorted((-score(v, w), j) for j, x, w in rows if x != label)
        for p, j in same:
            fit = [(s, k) for s, k in other if low[0] * -p <= low[1] * -s and high[1] * -s <= high[0] * -p][:n_negatives]
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dims=12, labels=(0, 0, 0, 1, 2, 7)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims)) * 3
    return [(k, int(x := rng.choice(labels)), (rng.normal(size=dims) * 30 + centres[x] * 12).astype(int).tolist()) for k in range(n)]


@pytest.mark.parametrize("block,anchor_block", [(8192, 1024), (16, 4)])
def test_equals_brute_force(spark, block, anchor_block):
    rows = vectors(1, 180)
    rows += [(200, 0, rows[0][2]), (201, 1, rows[0][2]), (202, 1, rows[0][2]), (203, 2, [0] * 12), (204, 9, [5] * 12), (210, 8, [9, 1]), (211, 8, [9, 2, 3]), (205, 0, [])]
    rows += [rows[3]] * 4 + [(None, 0, rows[0][2]), (206, None, rows[0][2]), (207, 0, None), (10, 1, rows[7][2])]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, block=block, anchor_block=anchor_block)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)


def test_other_windows_and_scarce_rows(spark):
    rows = vectors(2, 60, labels=(3, 4))
    got = hard_negatives(table(spark, rows), F.col("vec_id") < 20, 2, 50, (1, 3), (1, 1))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i < 20, 2, 50, (1, 3), (1, 1))
    alone = [(0, 1, [3, 4]), (1, 2, [3, 4])]
    assert hard_negatives(table(spark, alone), F.lit(True)).count() == 0
    assert hard_negatives(table(spark, []), F.lit(True)).count() == 0


def test_search_leaves_out_what_bounds_cover():
    rng = random.Random(3)
    data = np.array([[rng.randrange(-60, 60) // (k + 1) for k in range(10)] for _ in range(400)])
    block = Block(data)
    for anchor in data[:30]:
        search, exact = Search(block, anchor), data @ anchor
        for share in (0.9, 0.6, 0.3, 0.1):
            threshold = share * search.top()
            search.lower(threshold)
            assert set(np.flatnonzero(exact >= threshold)) <= set(np.flatnonzero(search.known))
            assert (search.scores[search.known] == exact[search.known]).all()
            if share == 0.6:
                assert search.ends.sum() < data.size / 2 and search.known.sum() < 200
        search.lower(-1)
        assert search.known.all()
    assert suffix_norms(np.array([[3, 4]])).tolist() == [[5.0, 4.0, 0.0]]


def test_rows_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.3, 0.2], 1), (2, [0.5, 0.3], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, [None, 1.0], 2), (6, None, 2), (8, [0.6, 0.3], None), (7, [0.6, 0.2], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect())
    ints = [(0, 2 if 0 % 7 == 0 else 1, [256, 128]), (1, 1, [76, 51]), (2, 2, [128, 76]), (7, 2, [153, 51])]
    assert got == brute(ints, lambda i: i % 50 == 0) and got


def test_anchors_that_search_together():
    """A matrix of anchors reads each list once, as far as one of them needs it, and finds what each finds alone."""
    data = np.array([v for _, _, v in vectors(4, 300, dims=40)]) // (1 + np.arange(40))
    block, anchors = Block(data), data[:25]
    together, alone, exact = Search(block, anchors), [Search(block, a) for a in anchors], data @ anchors.T
    assert len(block.lists) == 3 and sum(values.size for *_, values in block.lists) == data.size
    for share in (0.9, 0.5, 0.2):
        threshold = share * together.top()
        together.lower(threshold)
        for search, t in zip(alone, threshold, strict=True):
            search.lower(t)
        assert not set(np.flatnonzero((exact >= threshold).any(axis=1))) - set(np.flatnonzero(together.known))
        assert (together.scores[together.known] == exact[together.known]).all()
        assert (together.known == np.any([search.known for search in alone], axis=0)).all()
        if share == 0.9:
            assert (together.ends == np.max([search.ends for search in alone], axis=0)).all() and together.ends.sum() < data.size / 2
    together.only(np.array([3, 7]))
    together.lower(np.array([-1.0, 5.0]))
    assert together.known.all() and (together.scores == exact[:, [3, 7]]).all()


def test_windows_of_anchors_that_search_together():
    rng = np.random.default_rng(5)
    data, ids, n = rng.integers(-9, 9, (200, 6)), rng.permutation(200), 4
    anchors, exact = data[:30], data @ data[:30].T
    low = np.stack([rng.integers(-150, 150, 30), np.full(30, -FAR), rng.integers(-200, -100, 30), np.full(30, FAR)], axis=1)
    high = np.stack([low[:, 0] + 40, np.full(30, FAR), low[:, 2] + 60, np.full(30, -FAR)], axis=1)
    valid = rng.random((200, 30)) < 0.7
    valid[:, 0], valid[2:, 1] = False, False
    got = best(Search(Block(data), anchors), valid, ids, low.astype(float), high.astype(float), n)
    want = []
    for a in range(30):
        for w in range(4):
            rows = [r for r in range(200) if valid[r, a] and low[a, w] <= exact[r, a] <= high[a, w]]
            want += [(a, w, r, exact[r, a]) for r in sorted(rows, key=lambda r: (-exact[r, a], ids[r]))[:n]]
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)
