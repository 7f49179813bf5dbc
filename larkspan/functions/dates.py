"""Day and time expressions on text. The zone is a fixed +9 h offset, never the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import blank_to_null, let, norm_text

# Fixed values of the display formats.
WEEKDAYS = ["月", "火", "水", "木", "金", "土", "日"]
WEEKDAY_SUFFIX = r"\([月火水木金土日]\)"
AIRED_WORD = "放送"
NO_DAY = "----------(-)"
OFFSET_SECONDS = 9 * 3600
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?(?:(Z)|([+-])(\d{2}):?(\d{2}))?$"
WORDS = ("時間", "分", "秒")


def to_day(y: Column, m: Column, d: Column) -> Column:
    """A date from digit strings, null when they name no day."""
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _pick(c: Column, pattern: str) -> Column:
    y, m, d = (F.regexp_extract(c, pattern, g) for g in (1, 2, 3))
    return F.when(c.rlike(pattern), to_day(y, m, d))


def format_day(day: Column) -> Column:
    """`YYYY-MM-DD(weekday)` with fixed labels."""
    names = F.array(*[F.lit(w) for w in WEEKDAYS])
    return let(day, lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("("), names[F.weekday(d)], F.lit(")")))


def _clean_day(c: Column) -> Column:
    return F.replace(norm_text(c), F.lit(AIRED_WORD), F.lit(""))


def parse_day(c: Column) -> Column:
    """First reading that gives a day: 8 leading digits, 年月日, dashes, slashes, 年月日 anywhere."""
    return let(_clean_day(c), _read_day)


def _read_day(text: Column) -> Column:
    bare = F.regexp_replace(text, WEEKDAY_SUFFIX, "")
    return F.coalesce(
        _pick(text, r"^(\d{4})(\d{2})(\d{2})"),
        _pick(bare, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$"),
        _pick(bare, r"^(\d{4})-(\d{1,2})-(\d{1,2})$"),
        _pick(bare, r"^(\d{4})/(\d{1,2})/(\d{1,2})$"),
        _pick(text, r"(\d{4})年(\d{1,2})月(\d{1,2})日"),
    )


def iso_seconds(c: Column, naive_offset: int = 0) -> Column:
    """Epoch seconds of an ISO text, null when it is none. A text without zone counts at `naive_offset`."""
    fields = F.when(c.rlike(ISO), F.split(F.regexp_replace(c, ISO, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|"))

    def read(f: Column) -> Column:
        number = lambda g: F.coalesce(f[g - 1].try_cast("long"), F.lit(0))
        clock = number(2) * 3600 + number(3) * 60 + number(4)
        shift = number(7) * 3600 + number(8) * 60
        offset = F.when(f[4] != "", F.lit(0)).when(f[5] == "-", -shift).when(f[5] == "+", shift).otherwise(F.lit(naive_offset))
        in_range = (number(2) < 24) & (number(3) < 60) & (number(4) < 60)
        day = F.try_to_date(f[0], "yyyy-MM-dd")
        return F.when(in_range, F.unix_date(day).cast("long") * 86400 + clock - offset)

    return let(fields, read)


def local_day(epoch: Column, offset: int = OFFSET_SECONDS) -> Column:
    """The day at the fixed offset."""
    return F.date_from_unix_date(F.floor((epoch + offset) / 86400).cast("int"))


def format_onair(onair: Column, started: Column | None = None) -> Column:
    """Start time first (moved to +9 h when it has a zone), then the parsed text, else the raw text."""
    raw = F.coalesce(blank_to_null(_clean_day(onair)), F.lit(NO_DAY))
    by_text = F.coalesce(format_day(parse_day(onair)), raw)
    if started is None:
        return by_text
    return F.coalesce(format_day(local_day(iso_seconds(started, OFFSET_SECONDS))), by_text)


def format_event_date(c: Column) -> Column:
    """Exactly 8 digits, or 8 digits and then a non-number; other texts as `format_onair`."""
    day = _pick(c, r"^(\d{4})(\d{2})(\d{2})$")
    longer = F.when(~F.substring(c, F.lit(9), F.length(c)).rlike(r"^\d*$"), _pick(c, r"^(\d{4})(\d{2})(\d{2}).+$"))
    return F.coalesce(format_day(F.coalesce(day, longer)), format_onair(c))


def local_time(epoch: Column, seconds: bool = False, offset: int = OFFSET_SECONDS) -> Column:
    """`HH:MM` (or with seconds) at the fixed offset; '' when the epoch is missing."""
    of_day = F.pmod(F.floor(epoch + offset).cast("long"), F.lit(86400))
    fields = [F.floor(of_day / 3600), F.floor(of_day % 3600 / 60)] + ([of_day % 60] if seconds else [])
    clock = F.concat_ws(":", *[F.lpad(f.cast("string"), 2, "0") for f in fields])
    return F.when(epoch.isNotNull(), clock).otherwise(F.lit(""))


def local_date(epoch: Column, offset: int = OFFSET_SECONDS) -> Column:
    """`YYYYMMDD` at the fixed offset; '' when the epoch is missing."""
    return F.coalesce(F.date_format(local_day(epoch, offset), "yyyyMMdd"), F.lit(""))


def _whole(seconds: Column) -> Column:
    return seconds.try_cast("double").cast("long")


def _hms(total: Column):
    return F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60


def format_duration(seconds: Column) -> Column:
    """Duration in words; '' for null, zero and negative values."""
    return let(_whole(seconds), _words)


def _words(total: Column) -> Column:
    h, m, s = _hms(total)
    hour, minute, second = WORDS
    text = (
        F.when(h > 0, F.concat(h.cast("string"), F.lit(hour), m.cast("string"), F.lit(minute), s.cast("string"), F.lit(second)))
        .when(m > 0, F.concat(m.cast("string"), F.lit(minute), s.cast("string"), F.lit(second)))
        .otherwise(F.concat(s.cast("string"), F.lit(second)))
    )
    return F.when(total > 0, text).otherwise(F.lit(""))


def format_duration_clock(seconds: Column) -> Column:
    """`HH:MM:SS` with dashes for the parts that are zero from the left."""
    return let(_whole(seconds), _clock)


def _clock(total: Column) -> Column:
    h, m, s = _hms(total)
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    text = F.concat_ws(
        ":",
        F.when(h > 99, h.cast("string")).when(h > 0, two(h)).otherwise(F.lit("--")),
        F.when((h > 0) | (m > 0), two(m)).otherwise(F.lit("--")),
        two(s),
    )
    return F.when(total > 0, text).otherwise(F.lit(""))


def sort_day(c: Column) -> Column:
    """(1, ordinal day) or (0, 0): unreadable days sort first."""
    ordinal = F.unix_date(parse_day(c)) + 719163
    return F.struct(
        F.when(ordinal.isNotNull(), 1).otherwise(0).alias("ok"), F.coalesce(ordinal, F.lit(0)).alias("day")
    )


def sort_ts(c: Column) -> Column:
    """(1, epoch) for ISO text or at least 9 digits, else (0, 0)."""

    def read(text: Column) -> Column:
        digits = F.when(text.rlike(r"^\d{9,}$"), text.try_cast("double"))
        # an 8-digit basic ISO date also counts as ISO
        basic = F.unix_date(_pick(text, r"^(\d{4})(\d{2})(\d{2})$")).cast("double") * 86400
        return F.coalesce(iso_seconds(text).cast("double"), basic, digits)

    def key(value: Column) -> Column:
        return F.struct(
            F.when(value.isNotNull(), 1).otherwise(0).alias("ok"), F.coalesce(value, F.lit(0.0)).alias("ts")
        )

    return let(let(norm_text(c), read), key)


def sort_duration(c: Column) -> Column:
    """(1, seconds) read back from the duration words, (0, 0) when missing or zero."""
    text = norm_text(c)
    hour, minute, second = WORDS
    pattern = rf"^(?:(\d+){hour})?(?:(\d+){minute})?(?:(\d+){second})?$"
    h, m, s = (F.coalesce(F.regexp_extract(text, pattern, g).try_cast("long"), F.lit(0)) for g in (1, 2, 3))
    total = F.when(text.rlike(pattern), h * 3600 + m * 60 + s).otherwise(F.lit(0))
    return F.struct(F.when(total > 0, 1).otherwise(0).alias("ok"), total.alias("seconds"))


def epoch_seconds(ts_ntz: Column) -> Column:
    """Whole epoch seconds of a timestamp without zone, independent of the session zone."""
    day = F.to_date(ts_ntz)
    return (
        F.unix_date(day).cast("long") * 86400
        + F.hour(ts_ntz).cast("long") * 3600
        + F.minute(ts_ntz).cast("long") * 60
        + F.second(ts_ntz).cast("long")
    )
