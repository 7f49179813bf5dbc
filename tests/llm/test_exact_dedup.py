import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from larkspan.llm.exact_dedup import exact_dedup, keep_one

SCHEMA = "doc_id long, text string, _sha string, _row string"


def rows(spark, data):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in data], SCHEMA)


def brute(data, pick):
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, pick(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_equals_brute_force(spark, keep, pick):
    data = [(i, ["a", "b ", "", None, "é" * 50_000][i % 5] if i % 3 else "hot") for i in range(200)]
    got = exact_dedup(rows(spark, data), keep=keep, fan_in=2).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(data, pick)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "A", "a ", "", None]), min_size=1, max_size=30))
def test_any_texts(spark, texts):
    data = list(enumerate(texts))
    got = exact_dedup(rows(spark, data), keep="largest").collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(data, max)


def test_repeated_rows_null_ids_and_empty(spark):
    data = [(7, "t"), (7, "t"), (None, "t"), (None, "u")]
    got = exact_dedup(rows(spark, data), keep="largest").collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 4
    assert {r.keep_id for r in got} == {7, None}
    kept = keep_one(rows(spark, data))
    assert kept.columns == ["doc_id", "text", "_sha", "_row"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "u"), (7, "t")]
    assert exact_dedup(rows(spark, [])).count() == 0 and keep_one(rows(spark, [])).count() == 0
