import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from larkspan.llm.filter_audit import audit, document_flags, filter_audit, grow, masks, row_flags, term_matrix

SCHEMA = "doc_id long, text string, source string, id long, digest string, bits string, n string, word string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "d", "b", "n", "w") for i, t, s in rows], SCHEMA)


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def brute(rows, labels):
    """All orders walked one by one."""
    def fails(k):
        i, text, _ = rows[k]
        t, w = text or "", words(text)
        return {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    facts = [(s or "", fails(k), rows[k][0]) for k, (_, _, s) in enumerate(rows)]
    out, shares = {}, Counter()
    for part in {p for p, _, _ in facts}:
        for order in permutations("ABCDE"):
            left = [f for f in facts if f[0] == part]
            for step, letter in enumerate(order):
                gone = [f for f in left if f[1][letter]]
                left = [f for f in left if not f[1][letter]]
                every = [f for f in facts if f[0] == part and f[1][letter]]
                out[part, "".join(order), step + 1] = (
                    len(left), len(gone), len(every) - len(gone), sum(sum(f[1].values()) == 1 for f in every),
                    sum(f[2] in good for f in gone), sum(f[2] in toxic for f in gone),
                )
                shares[part, letter] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "Bb", "c", "D#", "é", "x y"]) + (str(rng.randrange(900)) if k % 3 else "") for _ in range(rng.choice([20, 199, 200, 400]))) for k in range(60)]
    rows = [(k, t, rng.choice(["hot", "hot", "s", None, ""])) for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k % 7], "copies") for k in range(20)] + [(200, "", "s"), (201, None, None), (202, "", "hot"), (3, texts[3], "again"), (3, texts[3], "hot")]
    rows += [(None, texts[5], "s"), (None, "alone", "s"), (203, "\u0085 \x1c a\tb " * 300, "odd"), (204, "Z" * 30_000, "odd")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(40)] + [(3, 0, 1), (3, None, None), (999, 1, 1), (None, 1, 1), (8, None, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(table(spark, rows), marks)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute(rows, labels)


@pytest.mark.parametrize("size", [50, 2_000_000])
def test_matrix_holds_the_words(spark, size):
    rows = corpus()
    matrix, dictionary = term_matrix(table(spark, rows), size=size)
    names = {r.word_id: r.word for r in dictionary.collect()}
    assert sorted(names) == list(range(len({w for _, t, _ in rows for w in words(t)})))
    got, want = Counter(), Counter((i, s or "", frozenset(Counter(words(t)).items())) for i, t, s in rows)
    shards = matrix.collect()
    for m in shards:
        for k, (i, part) in enumerate(zip(m.ids, m.parts, strict=True)):
            a, b = grow(m.bounds)[k : k + 2]
            got[i, part, frozenset((names[c], n) for c, n in zip(grow(m.columns, np.int64)[a:b].tolist(), grow(m.counts)[a:b].tolist(), strict=True))] += 1
    assert got == want and (len(shards) > 10) == (size == 50)
    flags = row_flags(matrix).collect()
    assert Counter((f.id, f.n_words, f.n_distinct) for f in flags) == Counter((i, len(words(t)), len(set(words(t)))) for i, t, _ in rows)


def test_counts_of_masks_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(table(spark, []), labels).count() == 0
    flags = spark.createDataFrame([(i, "p", b"x", 1) for i in (None, None, 4, 4, 5, 6)], "id long, part string, digest binary, bits int")
    assert {(r["mask"], r.n) for r in masks(flags, labels).collect()} == {(1, 4), (17, 2)}
    cells = spark.createDataFrame([("p", 3, True, False, 10), ("p", 1, False, True, 5), ("p", 0, True, True, 2)], "part string, mask int, good boolean, toxic boolean, n long")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in audit(cells, "XY").collect()}
    assert got == {("XY", 1): (2, 15, 0, 5, 10, 5, 20), ("XY", 2): (2, 0, 10, 0, 0, 0, 10), ("YX", 1): (7, 10, 0, 0, 10, 0, 10), ("YX", 2): (2, 5, 10, 5, 0, 5, 20)}
    assert np.isclose(sum(v[-1] for k, v in got.items() if k[0] == "XY"), 30)


def test_flags_need_one_worker_a_task(spark, capsys):
    docs = table(spark, corpus())
    flags = document_flags(docs, size=4000)
    flags.explain()
    assert capsys.readouterr().out.count("MapInPandas ") == 1
    matrix, _ = term_matrix(docs, size=4000)
    key = lambda r: tuple(map(str, r))
    assert sorted(flags.collect(), key=key) == sorted(row_flags(matrix).collect(), key=key)
