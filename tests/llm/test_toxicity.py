import random

import numpy as np

from larkspan.llm import toxicity as t


def brute_segments(places, scores, n):
    """Maximal scoring segments by their recursive definition: the best segment, then both sides of it."""
    values = [-t.DRIFT] * n
    for p, s in zip(places, scores, strict=True):
        values[p] = s
    found = []

    def part(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and b - a < best[2] - best[1])):
                    best = (total, a, b)
        if best:
            found.append(best)
            part(lo, best[1])
            part(best[2] + 1, hi)

    part(0, n)
    return sorted((a, b, round(s, 6)) for s, a, b in found)


def test_segments_equal_their_definition():
    rng = random.Random(17)
    for _ in range(200):
        n = rng.randint(1, 30)
        places = sorted(rng.sample(range(n), rng.randint(0, min(n, 8))))
        scores = [rng.choice([0.37, 0.91, 1.53, 0.18]) + rng.random() / 7 for _ in places]
        got = sorted((a, b, round(s, 6)) for s, a, b in t.segments(places, scores))
        assert got == brute_segments(places, scores, n)


def test_lambda_solves_its_equation():
    scores, rates = np.array([4.0, 2.0]), np.array([0.001, 0.003])
    x = t.solve_lambda(scores, rates)
    assert abs((rates * np.exp(x * scores)).sum() + (1 - rates.sum()) * np.exp(-x * t.DRIFT) - 1) < 1e-6
    assert t.solve_lambda(np.array([5.0]), np.array([0.9])) < 1e-3


def make(spark, documents):
    rng = random.Random(18)
    words = [f"w{k}" for k in range(300)]
    data, labels = [], []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(k % 5 == 0)
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["nasty", "vile", "rotten"]) for _ in range(4)]
        data.append((k, " ".join(text)))
        if k % 3:
            labels.append((k, 1, toxic))
    data += [(9001, None), (9002, ""), (9003, "Vile, nasty! " * 4000), (None, "nasty"), (3, data[3][1])]
    return documents(data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(data)


def test_held_out_accuracy(spark, documents):
    docs, labels, texts = make(spark, documents)
    rows = t.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    bad = [r for r in rows if r.doc_id is not None and r.doc_id < 9000 and r.predicted != (r.doc_id % 5 == 0)]
    assert len(bad) < 0.02 * len(rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[9001].score == by_id[9002].score < 0.5 and by_id[9003].predicted == 1
    hit = next(r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.predicted and r.n_passages)
    words = texts[hit.doc_id].split()
    assert any({"nasty", "vile", "rotten"} & set(words[p["first"] : p["last"] + 1]) for p in hit.passages)


def test_no_labels_and_no_rows(spark, documents):
    docs, labels, _ = make(spark, documents)
    assert {r.score for r in t.score_toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    assert t.score_toxicity(docs.limit(0), labels).count() == 0


def test_capped_labels_keep_their_share(spark, documents):
    rng = random.Random(19)
    words = [f"w{k}" for k in range(200)]
    data, labels = [], []
    for k in range(3000):
        text, toxic = [rng.choice(words) for _ in range(30)], int(rng.random() < 0.1)
        if rng.random() < (0.6 if toxic else 0.05):
            text[5:5] = ["nasty", "vile"]
        data.append((k, " ".join(text)))
        labels.append((k, toxic))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = {r.toxic: r.w for r in t.training_rows(table, 150).groupBy("toxic").agg({"weight": "sum"}).toDF("toxic", "w").collect()}
    known = table.filter(~t.held_out())
    assert all(abs(weights[k] - known.filter(f"toxic = {k}").count()) < 1e-6 for k in (0, 1))
    scores = [r.score for r in t.score_toxicity(documents(data), table, 150).collect()]
    assert abs(np.mean(scores) - np.mean([y for _, y in labels])) < 0.03
