"""Progress lines of jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import blank_to_null, strip

# Markers in the lines and the status texts.
CONVERT_MARKS = r"\[ExtractAudio\]|Post-process"
PERCENT = r"\[download\]\s+(\d+(?:\.\d+)?)%"
ETA = r"\bETA\s+([0-9:]+)"
CONVERTING = "変換中..."
LOADING = "ダウンロード中..."
ERROR_MARK = "ERROR:"


def parse_progress(line: Column) -> Column:
    """(percent, eta, status) of one line, all null for other lines."""
    text = strip(line)
    converting = text.rlike(CONVERT_MARKS)
    percent = blank_to_null(F.regexp_extract(text, PERCENT, 1)).try_cast("double")
    known = F.when(converting, F.lit(100.0)).otherwise(percent)
    eta = F.when(~converting & percent.isNotNull(), blank_to_null(F.regexp_extract(text, ETA, 1)))
    status = F.when(known >= 100, F.lit(CONVERTING)).when(known.isNotNull(), F.lit(LOADING))
    return F.struct(known.alias("percent"), eta.alias("eta"), status.alias("status"))


def format_percent(percent: Column) -> Column:
    """Clamped to 0..100; a whole number when within 0.05 of one, else one decimal."""
    p = F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))
    whole = F.bround(p, 0)
    return (
        F.when(percent.isNull(), F.lit("--%"))
        .when(F.abs(p - whole) < 0.05, F.concat(whole.cast("long").cast("string"), F.lit("%")))
        .otherwise(F.concat(F.format_string("%.1f", p), F.lit("%")))
    )


def error_reason(line: Column) -> Column:
    """Text after the error mark, the whole line when nothing follows, null for other lines."""
    text = strip(line)
    return F.when(
        text.startswith(ERROR_MARK),
        F.coalesce(blank_to_null(strip(F.substring(text, F.lit(len(ERROR_MARK) + 1), F.length(text)))), text),
    )
