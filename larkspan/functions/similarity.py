"""Two named similarity measures; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.unicode import matcher_ratio


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def similarity_from(a: Column, b: Column, floor: float) -> Column:
    """The edit-distance similarity where it is `floor` or more, else 0.

    Only the band of the distance table that such a pair can need is filled, and it stops where the band is left.
    """
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * (1 - floor) + 1e-9).cast("int")
    distance = F.call_function("levenshtein", a, b, most)
    return F.when(longest == 0, F.lit(1.0)).when(distance < 0, F.lit(0.0)).otherwise(1 - distance / longest)


def similarity(a: Column, b: Column, method: str = "levenshtein") -> Column:
    """`levenshtein`: 1 - distance / longer length, on the JVM. `blocks`: matching-blocks ratio in Arrow batches."""
    if method == "blocks":
        return matcher_ratio(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
