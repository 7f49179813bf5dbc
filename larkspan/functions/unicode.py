"""The few Arrow-batched helpers for which Spark has no built-in expression."""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_ONLY = r"^[\x00-\x7F]*$"
SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64",
    )


@lru_cache(maxsize=65536)
def _fold_char(char: str) -> str:
    return unicodedata.normalize("NFKC", char).casefold()


@F.pandas_udf(SPANS)
def _folded_spans(text: pd.Series, needle: pd.Series) -> pd.Series:
    def spans(line, q):
        if line is None or not q:
            return []
        pieces = [_fold_char(c) for c in line]
        hay = "".join(pieces)
        # a character may fold to several, so columns of the fold map back to their origin
        origin = None if all(len(p) == 1 for p in pieces) else [i for i, p in enumerate(pieces) for _ in p]
        out, at = [], 0
        while (at := hay.find(q, at)) >= 0:
            end = at + len(q)
            out.append({"start": at, "end": end} if origin is None else {"start": origin[at], "end": origin[end - 1] + 1})
            at = end
        return out

    return pd.Series([spans(x, q) for x, q in zip(text, needle)])


def nfkc(c: Column) -> Column:
    """NFKC form. ASCII rows are passed to Python as null and kept as they are."""
    ascii_only = c.rlike(ASCII_ONLY)
    return F.when(ascii_only, c).otherwise(_nfkc(F.when(~ascii_only, c)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pa.Array) -> pa.Array:
    return nfkc_lists(lists)


def nfkc_lists(lists: pa.Array, step: int = 256) -> pa.Array:
    """The NFKC form of each text of each list; no more than `step` texts at a time are Python strings."""

    def one(x):
        return x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)

    texts = lists.flatten()
    parts = [pa.array([one(x) for x in texts.slice(k, step).to_pylist()], pa.large_string()) for k in range(0, len(texts), step)]
    lengths = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]))
    values = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    return pa.LargeListArray.from_arrays(offsets, values, mask=lists.is_null()).cast(pa.list_(pa.string()))


_nfkc_barrier = _nfkc_each.asNondeterministic()


def nfkc_each(texts: Column) -> Column:
    """NFKC form of each text of an array, computed exactly once per row.

    The mark keeps the optimizer from copying the Python call into later filters and projections.
    """
    return _nfkc_barrier(texts)


def nfkc_casefold(c: Column) -> Column:
    """NFKC form and case folding; ASCII rows use the built-in `lower`."""
    ascii_only = c.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(c)).otherwise(_nfkc_casefold(F.when(~ascii_only, c)))


def matcher_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks similarity in [0, 1]. Use it only behind a blocking join."""
    return _matcher_ratio(a, b)


def folded_spans(text: Column, needle: str) -> Column:
    """Non-overlapping spans of `needle` in the folded text, as columns of the original text."""
    return _folded_spans(text, F.lit(fold_literal(needle)))


def fold_literal(text: str) -> str:
    """The folding of `text.fold_text`, for a search word given as a parameter."""
    return unicodedata.normalize("NFKC", text or "").casefold().strip()
