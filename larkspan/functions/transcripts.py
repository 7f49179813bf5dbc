"""Validation and clean-up of transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import blank_to_null, let, strip

# Character ranges, thresholds and phrases.
JAPANESE = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]"
LATIN = r"[A-Za-z]"
LOOP = r"(?s)^(.{1,15}?)\1{2,}"
FILLERS = [
    "えーと", "あのー", "そのー", "その", "ねえ", "まあ", "ほら", "つまり", "いわば", "ともかく", "ところで", "それにしても",
]
CORRECTION_WORD = "じゃなくて"
CORRECTION = r"(.+)じゃなくて(.+)"
SENTENCE_END = r"(ですね|です|ます|でした|ました)(?=[^。？！\s])"
STOPS = r"[。？！]$"
BOILERPLATE = [
    "ご視聴ありがとうございました", "ご視聴、ありがとうございました", "チャンネル登録お願いします", "チャンネル登録をお願いします",
    "高評価お願いします", "Subtitles by", "Translated by", "視聴してくれてありがとう", "最後までご視聴いただき",
    "Thank you for watching", "Thanks for watching", "【字幕】", "[音楽]", "（音楽）", "(音楽)", "( 音楽 )", "（ 音楽 ）",
    "(拍手)", "（拍手）", "[笑い]", "(音声)", "（音声）", "( 音声 )", "（ 音声 ）", "[音声]", "【音声】", "(音声指示)",
    "（音声指示）", "(無音)", "（無音）", "(ノイズ)", "（ノイズ）", "( 雑音 )", "(雑音)", "（雑音）", "( 咳 )", "(咳)", "（咳）",
    "(笑い)", "（笑い）", "(ため息)", "（ため息）",
]


def script_class(c: Column) -> Column:
    """Main script by the share of Japanese letters among Japanese and Latin letters."""
    counts = F.struct(F.regexp_count(c, F.lit(JAPANESE)).alias("j"), F.regexp_count(c, F.lit(LATIN)).alias("l"))

    def verdict(share: Column) -> Column:
        return (
            F.when(share.isNull(), "unknown").when(share >= 0.8, "japanese").when(share >= 0.2, "mixed").otherwise("english")
        )

    return let(let(counts, lambda n: n["j"] / F.nullif(n["j"] + n["l"], F.lit(0))), verdict)


def repeat_loop(c: Column) -> Column:
    """Shortest opening pattern of 1..15 characters that is repeated at least 3 times, else null."""
    return F.when(F.length(c) >= 6, blank_to_null(F.regexp_extract(c, LOOP, 1)))


def validate_text(c: Column, accept: tuple[str, ...] = ("japanese", "mixed")) -> Column:
    """First verdict of: empty, language, loop, valid."""

    def verdict(text: Column) -> Column:
        return (
            F.when(text == "", "empty")
            .when(~script_class(text).isin(*accept), "language")
            .when(repeat_loop(text).isNotNull(), "loop")
            .otherwise("valid")
        )

    return let(strip(F.coalesce(c, F.lit(""))), verdict)


def final_stop(c: Column) -> Column:
    return let(c, lambda x: F.when((x != "") & ~x.rlike(STOPS), F.concat(x, F.lit("。"))).otherwise(x))


def apply_terms(c: Column, terms: Column) -> Column:
    """Replace each reading by its target, in the order of the term array."""
    return F.aggregate(terms, c, lambda acc, t: F.replace(acc, t["reading"], t["target"]))


def remove_all(c: Column, phrases: list[str]) -> Column:
    for phrase in phrases:
        c = F.replace(c, F.lit(phrase), F.lit(""))
    return c


def refine_text(c: Column, strength: str = "standard", terms: Column | None = None) -> Column:
    """`none`, `light` (final stop), `standard` (fillers, corrections, terms, stops), `aggressive` (line breaks too)."""
    if strength == "none":
        return c
    if strength == "light":
        return final_stop(strip(c))
    # the search for a correction is quadratic in a line without one
    text = let(
        remove_all(c, FILLERS),
        lambda x: F.when(x.contains(CORRECTION_WORD), F.regexp_replace(x, CORRECTION, "$2")).otherwise(x),
    )
    if terms is not None:
        text = apply_terms(text, terms)
    text = final_stop(F.regexp_replace(strip(text), SENTENCE_END, "$1。"))
    return break_lines(text) if strength == "aggressive" else text


def break_lines(c: Column, width: int = 40) -> Column:
    """A new line after each stop, and after the first blank once a line has `width` characters.

    A line holds no stop but at its end, so one pass of a regular expression finds all ends:
    the first blank at position `width` or later with no stop before it, else the next stop.
    """
    ends = rf"([^。？！]{{{width - 1}}}[^。？！ ]* |[^。？！]*[。？！])"
    return F.regexp_replace(c, ends, "$1\n")


def strip_boilerplate(c: Column) -> Column:
    """Remove the fixed phrases one after the other, then trim."""
    return strip(remove_all(c, BOILERPLATE))


def mask_message(c: Column) -> Column:
    """Numbers and paths replaced by tokens, so that messages of one kind become equal."""
    text = F.regexp_replace(c, r"\d+\.\d+", "N.N")
    text = F.regexp_replace(text, r"\b\d+\b", "N")
    return F.regexp_replace(text, r"/[^\s]+", "PATH")
