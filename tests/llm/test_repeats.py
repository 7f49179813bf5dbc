import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspan.llm.repeats import LENGTH, REACH, anchors, remove_repeats, repeat_groups, repeats, shared_prefix


def brute(texts):
    """Per text its removed places."""
    seen = Counter(t[k : k + LENGTH] for t in texts for k in range(len(t) - LENGTH + 1))
    out = []
    for t in texts:
        gone = set()
        for k in range(len(t) - LENGTH + 1):
            if seen[t[k : k + LENGTH]] > 1:
                gone.update(range(k, k + LENGTH))
        out.append(gone)
    return out


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, other = prose(1, 90), prose(2, 60)
    texts = [prose(10 + k, 40) + passage + prose(50 + k, 30) for k in range(12)]  # one passage, other surroundings
    texts += [passage[k : k + 200] + prose(90 + k, 20) for k in range(0, 60, 7)]  # shifted cuts of it, just long enough
    base = prose(4, 250).split()
    for k in range(15):  # near copies
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(250)] = "changed"
        texts.append(" ".join(words))
    texts += ["x" * 900, "ab" * 400, "y" * 199, "z" * 200, other, other, other[:-1] + "é", "é" * 150, prose(5, 400) * 2, passage[:199], passage[:201]]
    texts += [None, "", "short", passage + other + passage, prose(7, 3000)]
    return texts


def check(got, texts):
    data = [(t or "").encode() for t in texts]
    for r, t, gone in zip(sorted(got, key=lambda r: r.doc_id), data, brute(data), strict=True):
        assert {k for s in r.spans for k in range(s.start, s.end)} == gone, r.doc_id
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert bytes(r.kept) == bytes(c for k, c in enumerate(t) if k not in gone) and r.n_bytes == len(t)


@pytest.mark.parametrize("most", [20_000, 1])
def test_equals_brute_force(documents, most):
    texts = corpus()
    check(remove_repeats(documents(list(enumerate(texts))), most=most).collect(), texts)


def test_repeats_hold_all_occurrences(documents):
    texts = corpus()
    data = [(t or "").encode() for t in texts]
    groups = defaultdict(set)
    for r in repeats(documents(list(enumerate(texts)))).collect():
        groups[r.repeat].add((r.doc_id, r.start, r.length))
    covered = defaultdict(set)
    places = defaultdict(set)
    for k, t in enumerate(data):
        for p in range(len(t) - LENGTH + 1):
            places[t[p : p + LENGTH]].add((k, p))
    for group in groups.values():
        strings = {data[k][p : p + n] for k, p, n in group}
        assert len(strings) == 1 and len(group) > 1
        [string] = strings
        assert len(string) >= LENGTH
        wanted = {(k, p) for k, p in places[string[:LENGTH]] if data[k][p : p + len(string)] == string}
        assert wanted == {(k, p) for k, p, _ in group}
        for k, p, n in group:
            covered[k].update(range(p, p + n))
    assert [covered[k] for k in range(len(data))] == brute(data)


def test_rows_of_any_kind(documents):
    text = prose(1, 60)
    rows = [(1, text), (1, text), (None, prose(2, 60)), (None, None), (2, "")]
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in remove_repeats(documents(rows)).collect())
    assert got == sorted([(1, len(text), 0), (1, len(text), 0), (0, len(prose(2, 60)), len(prose(2, 60))), (0, 0, 0), (2, 0, 0)])
    assert remove_repeats(documents([])).count() == 0 and repeats(documents([])).count() == 0


def test_every_window_has_its_anchor():
    text = (prose(1, 500) + "a" * 700 + prose(2, 100)).encode()
    [(at, grams, around, far, near)] = anchors([text])
    assert all(any(k <= p <= k + REACH for p in at) for k in range(len(text) - LENGTH + 1))
    [_, (again, keys, *_)] = anchors([b"q" * 300, text[100:]])
    assert set(again[20:].tolist()) <= {p - 100 for p in at} and len(keys) == len(again)
    assert sum(far - near + 1) == len(text) - LENGTH + 1 and all(0 <= near) and all(far <= REACH)
    assert anchors([b"x" * 199])[0][0].size == 0 and len(around) == len(at)
    assert [x[1].tolist() for x in anchors([text, text])] == [grams.tolist()] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=0, max_size=REACH), st.text("ab", max_size=130)), min_size=2, max_size=9))
def test_groups_are_all_maximal_repeats(rows):
    data = list({(a.encode(), b"g" * 64 + b.encode()) for a, b in rows})
    got = {(x, y, frozenset(m)) for x, y, m in repeat_groups([a for a, _ in data], [b for _, b in data])}
    want = set()
    for i, (a, b) in enumerate(data):
        for j in range(i):
            x, y = shared_prefix(a, data[j][0]), shared_prefix(b, data[j][1])
            for c, d in data:
                x2, y2 = min(x, shared_prefix(a, c)), min(y, shared_prefix(b, d))
                if x2 + y2 >= LENGTH:
                    members = frozenset(k for k, (e, f) in enumerate(data) if e[:x2] == a[:x2] and f[:y2] == b[:y2])
                    left = min(shared_prefix(a, data[k][0]) for k in members)
                    right = min(shared_prefix(b, data[k][1]) for k in members)
                    if (left, right) == (x2, y2):
                        want.add((x2, y2, members))
    assert got == want


def test_digest_of_kept(spark, tmp_path):
    from larkspan.llm.repeats import op13_suffix_array_dedup

    text = prose(1, 60)
    spark.createDataFrame([(1, text + "!"), (2, "?" + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op13_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (len(text) + 1, len(text), 1, hashlib.sha256(b"!").hexdigest()), 2: (len(text) + 1, len(text), 1, hashlib.sha256(b"?").hexdigest())}
