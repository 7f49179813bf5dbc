"""Recognition of contents rows and chapter headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import blank_to_null, let, strip
from larkspan.functions.unicode import nfkc

# Patterns of contents rows and headings.
# Both kinds of rows at once, the leader row first.
ANY_ROW = r"^(?:(.+?)\s*[\.․…⋯・‥…]{2,}|(\S(?:.*\S)?)\s{2,})\s*(\d{1,4})\s*$"
SPLIT_MARK = "\n"  # a line has none
CONTENTS_WORD = r"(?i)(目次|もくじ|Contents)"
CHAPTER_TITLE = (
    r"(?i)^(第\s*[0-9〇一二三四五六七八九十百]+\s*章|Chapter\s*\d+"
    r"|はじめに|まえがき|序章|プロローグ|おわりに|あとがき|エピローグ|付録|索引|Appendix|Index)"
)
HEADINGS = (
    r"^(第\s*[0-9〇一二三四五六七八九十百]+\s*章)(?![ぁ-ゖ、。,.])",
    r"(?i)^(Chapter\s+\d+)(?:\s+|$)",
    r"(?i)^(Part\s+\d+)(?:\s+|$)",
    r"(?i)^(はじめに|まえがき|序章|プロローグ|Preface|Introduction|Prologue)(?:\s+|$)",
    r"(?i)^(おわりに|エピローグ|Epilogue|Conclusion|付録|Appendix|索引|Index)(?:\s+|$)",
)
HEADING_KEY = r"(?i)^(?:第\s*(\S+?)\s*章|chapter\s+(\d+))$"
TITLE_EDGE = r"^[ .・‥…]+|[ .・‥…]+$"


def is_contents_row(line: Column) -> Column:
    """The stripped line ends in leader dots or a wide gap and a page number.

    The look at the last character spares most lines the two searches.
    """
    return F.right(line, F.lit(1)).rlike(r"\d") & line.rlike(ANY_ROW)


def has_contents_word(head: Column) -> Column:
    return head.rlike(CONTENTS_WORD)


def contents_row(line: Column, normalise: bool = True) -> Column:
    """(title, printed_page, is_chapter) of one line, null when it is no contents row."""
    return let(strip(nfkc(line) if normalise else line), _read_row)


def _read_row(text: Column) -> Column:
    """One search gives title and page; a line that is no row comes back without the mark."""
    marked = F.when(
        F.right(text, F.lit(1)).rlike(r"\d") & ~text.contains(SPLIT_MARK), F.regexp_replace(text, ANY_ROW, f"$1$2{SPLIT_MARK}$3")
    )

    def row(m: Column) -> Column:
        title = F.regexp_replace(F.substring_index(m, SPLIT_MARK, 1), TITLE_EDGE, "")
        return let(title, lambda t: fields(t, F.substring_index(m, SPLIT_MARK, -1).try_cast("int")))

    def fields(title: Column, page: Column) -> Column:
        made = F.struct(title.alias("title"), page.alias("printed_page"), title.rlike(CHAPTER_TITLE).alias("is_chapter"))
        return F.when((title != "") & (page > 0), made)

    return let(marked, lambda m: F.when(m.contains(SPLIT_MARK), row(m)))


def heading_of(line: Column) -> Column:
    """The heading text by the first pattern that matches the stripped line, else null."""
    def read(text: Column) -> Column:
        found = F.coalesce(*[blank_to_null(F.regexp_extract(text, p, 1)) for p in HEADINGS])
        return F.when(F.length(text) >= 2, found)

    return let(strip(line), read)


def heading_key(title: Column) -> Column:
    """The chapter number for both spellings of a chapter, else the title in lower case."""
    return F.coalesce(
        blank_to_null(F.regexp_extract(title, HEADING_KEY, 1)),
        blank_to_null(F.regexp_extract(title, HEADING_KEY, 2)),
        F.lower(title),
    )
