import random
import re
from collections import Counter

import corpus_pipeline as p
from larkspan.llm.secrets import base_spans
from tests.llm.test_ngram_join import grams


def table(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", len(x) if x is not None else None) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_run_equals_brute_force(spark, tmp_path):
    near = prose(1).split()
    near[40] = "other"
    rows = [(1, prose(1)), (2, prose(1)), (3, " ".join(near)), (4, prose(2) + " token=abcdef123"), (5, prose(3)), (6, "too few"), (7, "again and again and again " * 20), (8, None), (9, prose(4, 3000))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    texts = {i: x for i, x in rows if x and len(x.split()) >= 10 and i != 7}
    texts = {max(i for i, y in texts.items() if y == x): x for x in texts.values()}
    kept = [i for i in sorted(texts) if not any(j < i and 5 * len(grams(texts[i]) & grams(texts[j])) >= 4 * len(grams(texts[i]) | grams(texts[j])) for j in texts)]
    assert sorted({r.doc_id for r in got}) == kept == [2, 4, 5, 9]
    found = table(spark, [(4, re.sub("token=abcdef123", "[SECRET]", texts[4]))])
    want = {(r.length, r.ids_crc32) for r in p.STAGES[-1][1](spark, found, str(tmp_path)).collect()}
    assert {(r.length, r.ids_crc32) for r in got if r.doc_id == 4} == want
    assert Counter(r.sequence_id for r in got if r.length == 4096).most_common(1)[0][1] == 1


def test_stages_take_any_rows(spark):
    odd = [(1, None), (None, prose(1)), (1, prose(1)), (1, prose(1)), (2, ""), (3, prose(5, 20_000))]
    for name, stage in p.STAGES:
        for rows in (odd, []):
            docs = table(spark, rows)
            out = stage(spark, docs, "")
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns
    assert not base_spans("")
