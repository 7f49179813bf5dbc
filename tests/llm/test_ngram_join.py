import random
from collections import Counter

import numpy as np
import larkspan.llm.ngram_join as ngram
from larkspan.llm.ngram_join import components, keep_one_of_class, links_between, ngram_join, prefix_depth


def grams(text):
    words = (text or "").split()
    return frozenset(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(data):
    heads = {}
    for i, t in data:
        heads.setdefault(grams(t), []).append(i)
    ids = {s: min(v) for s, v in heads.items()}
    root, links = {i: i for i in ids.values()}, Counter()

    def top(i):
        return i if root[i] == i else top(root[i])

    keys = list(ids)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[ids[a]] += 1
                links[ids[b]] += 1
                low, high = sorted((top(ids[a]), top(ids[b])))
                root[high] = low
    return {(i, top(ids[grams(t)]), ids[grams(t)], len(heads[grams(t)]), links[ids[grams(t)]]) for i, t in data}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    for k in range(60):  # a crowded group of near copies, and exact ones
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append("\n".join([" ".join(words[:75]), " ".join(words[75:])]))
    return texts + ["", None, "one two", "one  two", "x " * 3000]


def test_equals_brute_force_with_small_cells(documents):
    data = list(enumerate(corpus()))
    for cell in (16, 512):
        got = {(r.doc_id, r.class_id, r.copy_of, r.n_copies, r.n_links) for r in ngram_join(documents(data), cell=cell).collect()}
        assert got == brute(data)


def test_kept_documents(documents):
    data = list(enumerate(corpus()))
    want = {c for _, c, _, _, _ in brute(data)}
    kept = keep_one_of_class(documents(data + [(0, data[0][1]), (None, "alone here")]))
    assert kept.columns == documents(data).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*want, None])
    assert ngram_join(documents([])).count() == 0 and keep_one_of_class(documents([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 95: 90, 100: 90}


def test_depth_and_links():
    assert prefix_depth() == 5 and prefix_depth(recall=0.9) == 6 and prefix_depth(trees=1, recall=1.0) == 1
    a, b = np.arange(10), np.arange(1, 11)
    assert links_between([a, b], [a, b], True) == [(0, 1)] and links_between([a], [b, a + 50], False) == [(0, 0)]


def test_rows_grow_with_a_group_of_near_copies(documents, monkeypatch):
    """Twice the near copies are about twice the rows of links, and no more rows of pairs."""
    seen, packed = [], []
    real, crossing = ngram.components, ngram._linked

    def links(edges):
        seen.append(edges.count())
        return real(edges)

    def pairs(sets, pairs):
        packed.append(pairs.count())
        return crossing(sets, pairs)

    monkeypatch.setattr(ngram, "components", links)
    monkeypatch.setattr(ngram, "_linked", pairs)
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    for n in (150, 300):
        rows = []
        for k in range(n):
            words = list(base)
            for _ in range(1 + k % 3):
                words[rng.randrange(200)] = f"n{k}"
            rows.append((k, " ".join(words)))
        got = ngram_join(documents(rows)).collect()
        assert {r.class_id for r in got} == {0} and len(got) == n
    half = len(seen) // 2
    assert all(b <= 2.2 * a for a, b in zip(seen[:half], seen[half:], strict=True)), seen
    assert packed[0] == packed[1] == 0


def test_repeated_rows_come_once_to_their_cell(documents):
    data = list(enumerate(corpus()))[40:70]
    more = data + [data[3]] * 50 + [(None, data[4][1])] * 30
    want = {i: (c, n) for i, c, _, _, n in brute(data)}
    got = ngram_join(documents(more)).collect()
    assert len(got) == len(more) and all((r.class_id, r.n_links) in (want[r.doc_id], (None, want[r.doc_id][1])) for r in got if r.doc_id is not None)
