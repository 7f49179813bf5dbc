"""Dictionary replacement over a text column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.ordered import rank

CHUNK = 50_000


class Replacer:
    """Readings in order, each with its target. One pass over a text finds which readings occur at all.

    A target can make a later reading occur, so the text is searched again after each replacement; readings that do not
    occur cost nothing. The automaton is built where it is used, once per task.
    """

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms, self._found = terms, None

    def __getstate__(self) -> list[tuple[str, str]]:
        return self.terms

    def __setstate__(self, terms: list[tuple[str, str]]) -> None:
        self.terms, self._found = terms, None

    def _automaton(self):
        if self._found is None:
            import ahocorasick

            places: dict[str, list[int]] = {}
            for place, (reading, _) in enumerate(self.terms):
                places.setdefault(reading, []).append(place)
            self._found = ahocorasick.Automaton()
            for reading, found in places.items():
                self._found.add_word(reading, found)
            self._found.make_automaton()
        return self._found

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.terms:
            return text
        automaton, done = self._automaton(), -1
        while (due := min((place for _, places in automaton.iter(text) for place in places if place > done), default=None)) is not None:
            text, done = text.replace(*self.terms[due]), due
        return text


def apply_terms(df: DataFrame, text: str, terms: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Replace every enabled reading by its target, longest reading first, then in alphabetical order.

    The dictionary is ranked once. It reaches the tasks in parts of at most `chunk` terms, so what passes the driver has a
    fixed bound; a larger dictionary takes several passes over the text, in the same order. Null texts stay null, a term
    without a target replaces nothing.
    """
    enabled = terms.filter("is_enabled and reading <> ''").select("reading", "target").distinct()
    ranked = rank(enabled.withColumn("_short", -F.length("reading")), ["_short", "reading", "target"], "rank")
    last = ranked.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0]
    for start in range(0, last, chunk):
        part = ranked.filter(F.col("rank").between(start + 1, start + chunk)).select("rank", "reading", "target").collect()
        df = df.withColumn(text, _replaced(Replacer([(r.reading, r.target) for r in sorted(part) if r.target is not None]))(F.col(text)))
    return df


def _replaced(replace: Replacer):
    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(replace, na_action="ignore")

    return replaced
