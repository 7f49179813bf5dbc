import hashlib
import random
import re

import numpy as np
import pytest

from larkspan.llm import pii, secrets
from larkspan.llm.common import Intervals


def joined(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def plain_secrets(t):
    name = "(?:" + "|".join(["password", "passwd", "secret", "token", "api_?key"]) + ")"
    found = [("assign", *m.span()) for m in re.finditer(f"(?ai:({name}))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def plain_pii(t):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]


CASES = [
    (secrets, plain_secrets, ["assign", "access", "hex"], ["passWord", "token=", ":", " = ", "'", "abc123", "AKIA" + "Q" * 16, "0123456789abcdef" * 2, "é", " ", "api_key", "\n"]),
    (pii, plain_pii, ["email", "ip", "card", "phone"], ["a@b.c", "@", ".", "12", "255", "1.2.3.4", "+49 (30) 555-", "4111 1111 1111 1111", "-", " ", "é", "x"]),
]


@pytest.mark.parametrize("module,plain,kinds,parts", CASES)
def test_base_spans(module, plain, kinds, parts):
    rng = random.Random(10)
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert joined(module.base_spans(text), kinds) == joined(plain(text), kinds), repr(text)


@pytest.mark.parametrize("operator,plain,kinds,parts", [(secrets.scan_secrets, *CASES[0][1:]), (pii.find_pii, *CASES[1][1:])])
def test_documents(documents, operator, plain, kinds, parts):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(parts) for _ in range(12)) for _ in range(80)] + [None, "", "plain words only", "a" * 200_000, "1" * 20_000 + ".", "@" * 20_000]
    data = [*enumerate(texts), (None, "no id"), (1, texts[1])]
    rows = operator(documents(data)).collect()
    by_id = dict(data)
    assert len(rows) == len(data)
    for r in rows:
        base = plain(by_id[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(joined(base, kinds).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[0] == k for b in base) for k in kinds]
        assert set(joined(base, kinds).split(",")) <= set(r.spans.split(","))
    assert operator(documents([])).count() == 0


def test_random_strings_are_found_and_words_are_not(documents):
    rng = random.Random(12)
    words = ["".join(rng.choice(["tion", "er", "ing", "the", "an", "lich"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    key = "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(44))
    data = [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(60)]
    data.append((100, data[0][1] + f" {key} " + data[1][1]))
    rows = {r.doc_id: r for r in secrets.scan_secrets(documents(data)).collect()}
    start = data[-1][1].index(key)
    assert rows[100].spans == f"random:{start}:{start + 44}" and sum(r.n_random for r in rows.values()) == 1
    kept = {r.doc_id: r for r in secrets.redact(documents([*data, (101, None), (102, "token=abcdefgh x")])).collect()}
    assert key not in kept[100].text and kept[100].text.count("[SECRET]") == 1
    assert kept[101].text is None and kept[102].text == "[SECRET] x" and kept[0].text == data[0][1]


def test_battery():
    rng = random.Random(13)
    even = [secrets.randomness("".join(rng.choice("0123456789abcdef") for _ in range(40))) for _ in range(400)]
    assert np.mean([p < 0.05 for p in even]) < 0.12 and np.mean(even) > 0.35
    assert secrets.randomness("ab" * 20) < 1e-4 and secrets.randomness("a" * 30) < 1e-4 and secrets.randomness("aaaaaaaaaabbbbbbbbbb0123456789") < 0.01
    assert [secrets.encoding_of(t) for t in ("00ff", "00FF", "AZ27", "az09", "AZ09", "aZ", "a+Z", "a-Z")] == ["hex", "HEX", "base32", "lower", "upper", "alnum", "base64", "base64url"]


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = pii.Boosted().fit(x[:3000], y[:3000]).calibrate(x[3000:], y[3000:], 0.95)
    chosen = model.probability(x[3000:]) >= model.threshold
    assert chosen.sum() > 300 and y[3000:][chosen].mean() >= 0.95


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(pii, "CELLS", 8000)
    rng = np.random.default_rng(17)
    n = 30_000
    x = rng.integers(0, 3, (n, len(pii.FEATURES)))
    x[:, 0] = rng.geometric(0.05, n)  # more values than bins
    x[:, 1] = np.where(rng.random(n) < 0.99, 7, rng.integers(0, 1000, n))
    y = (x[:, 0] > 20) & (x[:, 2] > 0) | (rng.random(n) < 0.01)
    rows = [(k // 3, [k], [bool(y[k])], [x[k].astype(float).tolist()]) for k in range(n)]
    facts = spark.createDataFrame([*rows, (None, [], [], [])], "doc_id long, froms array<int>, covered array<boolean>, features array<array<float>>")
    held = facts.filter("size(froms) > 0").selectExpr("doc_id", "froms[0] k", "froms[0] froms", "features[0] features").selectExpr("k", "pmod(xxhash64(doc_id, froms, features), 4) = 0 held")
    fold = np.zeros(n, bool)
    fold[[r.k for r in held.filter("held").collect()]] = True
    plain = pii.Boosted().fit(x[~fold].astype(float), y[~fold].astype(float)).calibrate(x[fold].astype(float), y[fold].astype(float), pii.PRECISION)
    for facts_dealt in (facts, facts.repartition(5, "doc_id")):
        model = pii.train(facts_dealt)
        assert [e.tolist() for e in model.edges] == [e.tolist() for e in plain.edges]
        assert all(np.array_equal(a, b) for t, u in zip(model.trees, plain.trees, strict=True) for a, b in zip(t, u, strict=True))
        assert (model.start, model.scale, model.threshold) == (plain.start, plain.scale, plain.threshold)
    assert 0.5 <= model.threshold < 1 and len(model.edges[0]) == len(pii._middles(*np.unique(x[~fold][:, 0], return_counts=True))) > 8
    odds = pii._odds(pii.counted(facts).filter("held"), model)
    assert odds["n"].sum() == fold.sum() and odds["hits"].sum() == y[fold].sum()


def test_personal_data_beside_the_formats(documents):
    rng = random.Random(15)

    def phone(plus):
        return f"{plus}1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    data = [(k, f"some words here call {phone('+')} or more words") for k in range(300)] + [(1000 + k, f"the year was {rng.randint(1800, 2020)} and 1234567 {k}") for k in range(300)]
    data.append((5000, f"some words here call {phone('')} or more words"))
    rows = {r.doc_id: r for r in pii.find_pii(documents(data)).collect()}
    assert rows[5000].n_private == 1 and sum(r.n_private for i, r in rows.items() if i != 5000) == 0


def test_formats_that_base_rules_cannot_cover(documents):
    planted = [
        "jane.doe [at] example (dot) org", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "536-22-1897",
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "0a:1b:2c:3d:4e:5f", "aa:bb:cc:dd:ee:ff", "JANE(AT)EXAMPLE(DOT)ORG",
    ]
    bad = ["DE88 3704 0044 0532 0130 00", "666-22-1897", "536-00-1897", "12:34:56:78:90", "see (at) noon (dot) 5"]
    data = [(k, f"call +1 (555) 555-{1000 + k} or more words") for k in range(40)] + [(100 + k, f"in the year 1234567 {k}") for k in range(40)]
    for k in range(400):  # the more there is of a format, the surer it was rejected
        data.append((1000 + k, f"some words {planted[k % len(planted)]} IN more words"))
    data += [(5000 + k, f"some words {text} and more words") for k, text in enumerate(bad)]
    rows = {r.doc_id: r for r in pii.find_pii(documents(data)).collect()}
    for k in range(400):
        assert rows[1000 + k].spans == f"private:11:{11 + len(planted[k % len(planted)])}"
    assert all(rows[5000 + k].n_private == 0 for k in range(len(bad)))
    few = pii.find_pii(documents([(1, planted[1])])).collect()
    assert few[0].n_private == 1


def test_intervals():
    rng = random.Random(16)
    for _ in range(300):
        spans = [(s, s + rng.randint(1, 5)) for s in (rng.randint(0, 40) for _ in range(6))]
        taken = Intervals(spans)
        for s in range(45):
            for e in (s + 1, s + 4):
                assert taken.meets(s, e) == any(a < e and s < b for a, b in spans)
