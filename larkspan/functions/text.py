"""Scalar text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.unicode import nfkc, nfkc_casefold

# Names and limits that file systems impose.
FORBIDDEN = r'[\\/:*?"<>|]'
FORBIDDEN_AND_CONTROL = r'[\\/:*?"<>|\x00-\x1f\x7f]'
RESERVED_STEMS = (
    "CON PRN AUX NUL COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 "
    "LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9"
).split()
NAME_BYTES = 255
TITLE_BYTES_MIN = 30
# index prefix 8, date 8, two underscores, suffix reserve 32
TITLE_BYTES_USED = 8 + 8 + 2 + 32
UNTITLED = "(無題)"
UNCLASSIFIED = "未分類"

# White space characters of Unicode.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Wide and full-width blocks of the East Asian Width property.
WIDE = (
    r"[\x{1100}-\x{115F}\x{231A}-\x{231B}\x{2329}-\x{232A}\x{23E9}-\x{23EC}\x{2E80}-\x{303E}"
    r"\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{A960}-\x{A97F}"
    r"\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE10}-\x{FE19}\x{FE30}-\x{FE6F}\x{FF01}-\x{FF60}"
    r"\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}\x{20000}-\x{3FFFD}]"
)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, for expressions that use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Remove all white space at both ends."""
    return F.trim(c, F.lit(SPACES))


def norm_text(c: Column) -> Column:
    """Null as '', ideographic space as space, trimmed."""
    return strip(F.translate(F.coalesce(c, F.lit("")), "\u3000", " "))


def fold_text(c: Column) -> Column:
    """Compatibility form, case folded and trimmed: the key of a tolerant search."""
    return strip(nfkc_casefold(F.coalesce(c, F.lit(""))))


def squash(c: Column) -> Column:
    """Compatibility form without any white space."""
    return F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"(?U:\s)+", "")


def truncate_bytes(c: Column, limit) -> Column:
    """Cut to at most `limit` UTF-8 bytes on a character boundary."""
    n = limit if isinstance(limit, Column) else F.lit(limit)

    def cut(p: Column) -> Column:
        # a character starts at the first byte that is left out, so that byte is no continuation
        starts = lambda m: ~F.hex(F.substring(p["raw"], m + 1, F.lit(1))).between("80", "BF")
        last = F.array_max(F.filter(F.sequence(F.greatest(p["n"] - 3, F.lit(0)), p["n"]), starts))
        return F.decode(F.substring(p["raw"], F.lit(1), last), "UTF-8")

    return F.when(
        F.octet_length(c) > n, let(F.struct(F.encode(c, "UTF-8").alias("raw"), n.alias("n")), cut)
    ).otherwise(c)


def _rstrip_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"[ .]+$", "")


def safe_name(c: Column, fallback: str = "unknown", strict: bool = True) -> Column:
    """A text as one path element. `strict` also handles control characters, reserved stems and length."""
    base = _rstrip_dots(F.regexp_replace(norm_text(c), FORBIDDEN_AND_CONTROL if strict else FORBIDDEN, "_"))
    if strict:
        base = let(let(base, _avoid_reserved), _fit_name)
    return F.coalesce(blank_to_null(base), F.lit(fallback))


def _avoid_reserved(name: Column) -> Column:
    stem = F.substring_index(name, ".", 1)
    rest = F.substring(name, F.length(stem) + 1, F.length(name))
    return F.when(F.upper(stem).isin(RESERVED_STEMS), F.concat(stem, F.lit("_"), rest)).otherwise(name)


def _fit_name(name: Column) -> Column:
    short = _rstrip_dots(truncate_bytes(name, NAME_BYTES))
    return F.when(F.octet_length(name) > NAME_BYTES, short).otherwise(name)


def part_title(c: Column, length: int = 40) -> Column:
    """File part of a chapter title: forbidden characters removed, blanks as underscores, cut."""
    clean = F.replace(strip(F.regexp_replace(c, FORBIDDEN, "")), F.lit(" "), F.lit("_"))
    return F.left(F.coalesce(blank_to_null(clean), F.lit("untitled")), F.lit(length))


def capture_title(c: Column, fallback: str = "book", length: int = 80) -> Column:
    """Folder name of a capture: forbidden characters replaced, runs of underscores collapsed, cut."""
    runs = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\n\r\t]', "_"), "_+", "_")
    cut = strip(F.left(F.regexp_replace(runs, "^_+|_+$", ""), F.lit(length)))
    return F.coalesce(blank_to_null(cut), F.lit(fallback))


def display_title(series: Column, item: Column) -> Column:
    """`[series] item` when both are given and differ, else the one that is given."""
    s, i = norm_text(series), norm_text(item)
    return F.when((s != "") & (i != "") & (s != i), F.concat(F.lit("["), s, F.lit("] "), i)).otherwise(
        F.coalesce(blank_to_null(s), blank_to_null(i), F.lit(UNTITLED))
    )


def title_budget(title: Column) -> Column:
    """Bytes that an event title may use in a file name that also holds the item title."""
    return F.greatest(F.lit(NAME_BYTES - TITLE_BYTES_USED) - F.octet_length(title), F.lit(TITLE_BYTES_MIN))


def display_width(c: Column) -> Column:
    """Columns on a terminal: wide and full-width characters count twice."""
    return F.length(c) + F.regexp_count(c, F.lit(WIDE))


def clean_list(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda v: v != "")


def ordered_distinct(values: Column, fallback: Column | None = None) -> Column:
    """Trimmed, non-empty, distinct values in first-seen order, then the fallback."""
    cleaned = clean_list(values)
    if fallback is not None:
        cleaned = F.concat(cleaned, F.filter(F.array(strip(fallback)), lambda v: v != ""))
    return F.array_distinct(cleaned)


def label_text(labels: Column, codes: Column, lookup: Column) -> Column:
    """Labels joined by ` / `; else the looked-up codes; else the sentinel."""
    own, known = clean_list(labels), clean_list(codes)
    mapped = F.transform(known, lambda k: F.coalesce(lookup[k], F.lit(UNCLASSIFIED)))
    return (
        F.when(F.size(own) > 0, F.array_join(own, " / "))
        .when(F.size(known) > 0, F.array_join(mapped, " / "))
        .otherwise(F.lit(UNCLASSIFIED))
    )


def item_key(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("_"), b)


def split_key(key: Column) -> Column:
    """Parts of `a_b`, split at the first underscore; null when the key has none."""
    at = F.locate("_", key)
    return F.when(
        at > 0,
        F.struct(
            F.substring(key, F.lit(1), at - 1).alias("head"),
            F.substring(key, at + 1, F.length(key)).alias("tail"),
        ),
    )


def event_key(event_id: Column, date: Column, title: Column) -> Column:
    """The id, else `date:title`."""
    return F.coalesce(
        blank_to_null(strip(event_id)),
        F.concat(F.coalesce(date, F.lit("")), F.lit(":"), F.coalesce(title, F.lit(""))),
    )


def storage_id(site: Column, sub: Column, title: Column, shown: Column) -> Column:
    """Folder name of an item: both ids, else its title."""
    a, b = strip(F.coalesce(site, F.lit(""))), strip(F.coalesce(sub, F.lit("")))
    by_title = safe_name(F.coalesce(blank_to_null(title), blank_to_null(shown), F.lit("unknown")))
    return F.when((a != "") & (b != ""), F.concat(safe_name(a), F.lit("_"), safe_name(b))).otherwise(by_title)


def title_variants(site: Column, sub: Column, title: Column, shown: Column) -> Column:
    """Ordered distinct safe names under which an item may have been stored."""
    ids = F.regexp_replace(
        F.concat(F.coalesce(site, F.lit("")), F.lit("_"), F.coalesce(sub, F.lit(""))), "^_+|_+$", ""
    )
    return F.array_distinct(F.array(safe_name(title), safe_name(shown), safe_name(ids)))


def output_name(date: Column, item: Column, title: Column, suffix: str, index: Column | None = None) -> Column:
    """`date_item_title.suffix`, with the list index in front when given."""
    body = F.concat(date, F.lit("_"), item, F.lit("_"), truncate_bytes(title, title_budget(item)), F.lit(f".{suffix}"))
    return body if index is None else F.concat(index.cast("string"), F.lit("_"), body)


def name_stems(dates: Column, titles: Column, variants: Column) -> Column:
    """All `date_item_title` stems that a stored file may have (item titles × variants × dates)."""
    with_dates = F.flatten(
        F.transform(
            titles,
            lambda t: F.flatten(
                F.transform(
                    variants,
                    lambda v: F.when(
                        F.size(dates) > 0, F.transform(dates, lambda d: F.concat_ws("_", d, t, v))
                    ).otherwise(F.array(F.concat_ws("_", t, v))),
                )
            ),
        )
    )
    return F.array_distinct(with_dates)


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits of any length compare as numbers and letters ignore case."""
    parts = F.split(F.lower(c), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    # without leading zeros a number with more digits is greater, so the count of digits goes first
    number = lambda p: let(
        F.regexp_replace(p, r"^0+(?=\d)", ""), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d)
    )
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def unescape(c: Column) -> Column:
    r"""Decode `\n`, `\t`, `\r` and `\\`, reading each escape once from the left."""
    def between(part: Column) -> Column:
        for code, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    # pairs of backslashes are one each; what lies between them has the other escapes
    return F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), r"\\\\"), between), "\\")


def fingerprint(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def strict_pairs(a: Column, b: Column) -> Column:
    """Zip of two arrays that must have the same length."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(
        F.raise_error(F.lit("arrays differ in length"))
    )


def joined_fields(columns: Sequence[Column]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
