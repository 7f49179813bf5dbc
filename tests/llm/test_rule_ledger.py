import random
import unicodedata

from larkspan.llm import rule_ledger as r

WORDS = ["alpha", "beta", "gamma", "delta", "é"]


def brute(text):
    import re

    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit)


def test_measures_equal_brute_force(documents):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))).replace("é alpha", "\n") for _ in range(60)]
    texts += [None, "", " \n\t", "a\rb\x0bc\x0cd", "##|<>", "x\x00y", "word " * 3000, "z" * 100_000]
    rows = {m.doc_id: m for m in r.measure(documents(enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        m = rows[i]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(t), t


def test_policies_and_ablations(documents):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = documents([(1, good), (2, "few words"), (3, "same five words come again " * 9), (4, good + "".join(f" #y{k}" for k in range(20))), (5, None), (None, good), (1, good)])
    entries = r.ledger(docs)
    bits = sorted(((e.doc_id, e.fail_bits) for e in entries.collect()), key=str)
    assert bits == sorted([(1, 0), (1, 0), (None, 0), (2, 1), (3, 2), (4, 4), (5, 1)], key=str)
    table = {a.rule: a for a in r.ablations(entries).collect()}
    assert (table["symbols"].n_failed, table["symbols"].n_failed_alone, table["symbols"].n_kept_without) == (1, 1, 4)
    both = {(a.policy, a.rule): a for a in r.ablations(entries, "base", r.CURRENT).collect()}
    assert {k[1]: tuple(a[2:]) for k, a in both.items() if k[0] == r.CURRENT} == {k: tuple(a[2:]) for k, a in table.items()}
    assert tuple(both["base", "few_words"][2:]) == (2, 2, 6) and len(both) == len(r.POLICIES["base"]) + len(r.POLICIES[r.CURRENT])
    assert r.ablations(entries.limit(0)).count() == 0
    for rule in r.POLICIES[r.CURRENT]:
        others = [x for x in r.POLICIES[r.CURRENT] if x != rule]
        mask = sum(1 << r.RULES.index(x) for x in others)
        assert table[rule].n_kept_without == sum(not b & mask for _, b in bits)


def test_rules_have_their_bits():
    assert list(r._rules()) == r.RULES


def test_kept_documents(documents, spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = documents([(1, good), (2, "few"), (None, good), (1, good), (3, None)])
    kept = r.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert r.keep_good(documents([]).limit(0)).count() == 0 and r.measure(documents([])).count() == 0


def test_the_policy_of_a_stage_is_its_mask(documents):
    """Each rule alone, kept or not by each policy: what `keep_good` keeps is what the ledger says."""
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [good, "few", "same five words come again " * 9, good + " #x" * 20, good + "\nsame" * 90, "a b c d e f g h i j k l", "1234 " * 3 + good, good + " " + "z" * 1001, "1 2 3 4 5 6 7 8 9 10 11"]
    docs = documents(enumerate(texts))
    for policy in r.POLICIES:
        told = {e.doc_id for e in r.ledger(docs).filter(r.verdict(policy)).collect()}
        assert {d.doc_id for d in r.keep_good(docs, policy).collect()} == told


def test_spaces_and_letters_are_those_of_the_sql():
    """Six ASCII spaces part words, other ones don't; letters are the categories L, not numbers like ½ or Ⅷ."""
    rng = random.Random(2)
    signs = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000abZ19_#é日ßªʰǅ½²Ⅷ①٣\u0301\U0001d400\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["ab cd " * 9, "½ ² Ⅷ ①", "é" * 1001, "日本 " * 400, "\x85 \xa0\n\x1c\n\t\n \n"]
    for text in texts:
        m = dict(zip(r.MEASURES, r._measured(text), strict=True))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute(text), text
        assert m["n_letters"] == sum(unicodedata.category(c)[0] == "L" for c in text), text
        words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ")
        assert m["longest_word"] == max(map(len, words)), text


def test_windows_are_counted_where_one_repeats(monkeypatch):
    def count(windows):
        raise AssertionError("no window repeats")

    words = [f"w{k}" for k in range(100)]
    assert r.repeat_words(words + words[:6]) == 12 and r.repeat_words([w.encode() for w in words + words[:6]]) == 12
    monkeypatch.setattr(r, "Counter", count)
    assert r.repeat_words(words + words[:4]) == r.repeat_words(words[:3]) == r.repeat_words([]) == 0
