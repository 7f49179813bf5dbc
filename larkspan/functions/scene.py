"""Scalar helpers for scene elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour names with (fill, stroke), and element defaults.
PALETTE = {
    "blue": ("#a5d8ff", "#4a9eed"),
    "green": ("#b2f2bb", "#22c55e"),
    "orange": ("#ffd8a8", "#f59e0b"),
    "purple": ("#d0bfff", "#8b5cf6"),
    "red": ("#ffc9c9", "#ef4444"),
    "yellow": ("#fff3bf", "#eab308"),
    "teal": ("#c3fae8", "#0d9488"),
    "dark": ("#e9ecef", "#1e1e1e"),
    "gray": ("#f1f3f5", "#495057"),
    "white": ("#ffffff", "#1e1e1e"),
    "black": ("#1e1e1e", "#1e1e1e"),
    "pink": ("#fcc2d7", "#e64980"),
    "cyan": ("#99e9f2", "#0c8599"),
    "violet": ("#eebefa", "#ae3ec9"),
    "lime": ("#d8f5a2", "#74b816"),
    "indigo": ("#c5d2fe", "#4f46e5"),
    "default": ("transparent", "#1e1e1e"),
}
INK = "#1e1e1e"
DEFAULTS = {"x": 100.0, "y": 100.0, "width": 140.0, "height": 70.0, "stroke_width": 2.0, "opacity": 100.0}

# Style word -> (property, value). A bare word counts as its own value.
STYLE_WORDS = {
    "dashed": ("stroke_style", "dashed"),
    "stroke=dashed": ("stroke_style", "dashed"),
    "dotted": ("stroke_style", "dotted"),
    "stroke=dotted": ("stroke_style", "dotted"),
    "solid": ("stroke_style", "solid"),
    "stroke=solid": ("stroke_style", "solid"),
    "solid=fill": ("fill_style", "solid"),
    "fill=solid": ("fill_style", "solid"),
    "hachure": ("fill_style", "hachure"),
    "fill=hachure": ("fill_style", "hachure"),
    "cross-hatch": ("fill_style", "cross-hatch"),
    "crosshatch": ("fill_style", "cross-hatch"),
    "fill=cross-hatch": ("fill_style", "cross-hatch"),
    "fill=crosshatch": ("fill_style", "cross-hatch"),
    "dots": ("fill_style", "dots"),
    "fill=dots": ("fill_style", "dots"),
    "round": ("roundness", "round"),
    "rounded": ("roundness", "round"),
    "roundness=round": ("roundness", "round"),
    "roundness=1": ("roundness", "round"),
    "roundness=true": ("roundness", "round"),
    "sharp": ("roundness", "sharp"),
    "roundness=sharp": ("roundness", "sharp"),
    "roundness=0": ("roundness", "sharp"),
    "roundness=false": ("roundness", "sharp"),
    "roundness=none": ("roundness", "sharp"),
    "virgil": ("font", "1"),
    "hand": ("font", "1"),
    "sans": ("font", "2"),
    "helvetica": ("font", "2"),
    "mono": ("font", "3"),
    "code": ("font", "3"),
    "cascadia": ("font", "3"),
    "left": ("align", "left"),
    "center": ("align", "center"),
    "right": ("align", "right"),
    "both": ("arrows", "both"),
    "double": ("arrows", "both"),
}
FONT_VALUES = {
    "virgil": "1", "hand": "1", "handwritten": "1", "1": "1",
    "helvetica": "2", "sans": "2", "normal": "2", "2": "2",
    "cascadia": "3", "mono": "3", "code": "3", "3": "3",
}
STYLE_KEYS = {
    "w": "stroke_width", "width": "stroke_width", "strokewidth": "stroke_width",
    "rough": "roughness", "roughness": "roughness", "opacity": "opacity",
    "font": "font", "fontfamily": "font",
    "align": "align", "textalign": "align", "valign": "valign", "verticalalign": "valign",
    "startarrow": "start_arrow", "start": "start_arrow", "endarrow": "end_arrow", "end": "end_arrow",
    "arrowhead": "arrows", "arrowheads": "arrows", "arrows": "arrows", "arrow": "arrows",
}
NUMERIC = ("stroke_width", "roughness", "opacity")
ALLOWED = {"align": ("left", "center", "right"), "valign": ("top", "middle", "bottom")}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def style_tokens(c: Column) -> Column:
    """(property, value) of each known token of a style text, in token order."""
    words = literal_map({k: f"{p}\t{v}" for k, (p, v) in STYLE_WORDS.items()})
    keys, fonts = literal_map(STYLE_KEYS), literal_map(FONT_VALUES)

    def parse(token: Column) -> Column:
        parts = F.split(token, "=")
        return F.struct(F.element_at(parts, 1).alias("key"), F.coalesce(F.get(parts, 1), F.lit("")).alias("value"))

    def look_up(token: Column) -> Column:
        key, value = token["key"], token["value"]
        # a word that is known with its value, else by itself whatever its value
        known = F.coalesce(words[F.concat(key, F.lit("="), value)], words[key])
        return F.struct(key.alias("key"), value.alias("value"), known.alias("known"), keys[key].alias("named"))

    def read(token: Column) -> Column:
        key, value, known, named = token["key"], token["value"], token["known"], token["named"]
        short = F.regexp_extract(key, r"^w(\d+)$", 1)
        number = F.when(value == "", F.lit("0")).when(value.try_cast("double").isNotNull(), value)
        given = lambda v: F.when(v.isNotNull(), F.struct(named.alias("name"), v.alias("value")))
        none = F.struct(named.alias("name"), F.lit(None).cast("string").alias("value"))
        by_key = (
            F.when(named == "stroke_width", given(F.when(value.try_cast("double") > 0, value)))
            .when(named.isin(*NUMERIC), given(number))
            .when(named == "font", given(fonts[value]))
            .when(named == "align", given(F.when(value.isin(*ALLOWED["align"]), value)))
            .when(named == "valign", given(F.when(value.isin(*ALLOWED["valign"]), value)))
            .when(named == "arrows", given(F.when(value.isin("both", "double"), F.lit("both"))))
            .when(named.isNotNull() & (value == "none"), none)
            .otherwise(given(F.when(value == "", F.lit("arrow")).otherwise(value)))
        )
        return (
            F.when(
                known.isNotNull(),
                F.struct(
                    F.substring_index(known, "\t", 1).alias("name"), F.substring_index(known, "\t", -1).alias("value")
                ),
            )
            .when(short.try_cast("double") > 0, F.struct(F.lit("stroke_width").alias("name"), short.alias("value")))
            .when(named.isNotNull(), by_key)
        )

    tokens = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[;, ]+"), lambda t: t != "")
    # steps of their own, as a lookup would be repeated at every use
    return F.filter(F.transform(F.transform(F.transform(tokens, parse), look_up), read), lambda s: s.isNotNull())


def style_props(c: Column) -> Column:
    """Map property -> value; a later token wins. An arrow that is switched off has a null value."""
    return F.aggregate(
        style_tokens(c),
        F.create_map().cast("map<string,string>"),
        lambda acc, s: F.map_concat(F.map_filter(acc, lambda k, v: k != s["name"]), F.create_map(s["name"], s["value"])),
    )


def resolve_color(c: Column, fallback: str = "blue") -> Column:
    """(fill, stroke) of a colour name or a hex colour."""
    fills = literal_map({k: v[0] for k, v in PALETTE.items()})
    strokes = literal_map({k: v[1] for k, v in PALETTE.items()})
    name = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    white, is_hex = name.isin("#fff", "#ffffff"), name.startswith("#")
    return F.struct(
        F.coalesce(
            fills[name], F.when(white, F.lit("#ffffff")), F.when(is_hex, c), F.lit(PALETTE[fallback][0])
        ).alias("fill"),
        F.coalesce(
            strokes[name], F.when(white, F.lit(INK)), F.when(is_hex, c), F.lit(PALETTE[fallback][1])
        ).alias("stroke"),
    )


def move(value: Column, absolute: Column, delta: Column, relative: Column) -> Column:
    """A coordinate after a move: shifted by `delta` when relative, else replaced when given."""
    return F.when(relative, F.coalesce(value, F.lit(0.0)) + F.coalesce(delta, F.lit(0.0))).otherwise(
        F.coalesce(absolute, value)
    )


def resize(value: Column, absolute: Column, factor: Column, scale: Column) -> Column:
    """A size after a resize: scaled and rounded half up, or replaced when given."""
    scaled = F.when(factor > 0, F.floor(F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(10.0)) * factor + 0.5).cast("double"))
    return F.when(scale, F.coalesce(scaled, value)).otherwise(F.coalesce(absolute, value))


def scale_points(points: Column, factor: Column) -> Column:
    return F.transform(points, lambda p: F.transform(p, lambda v: v * factor))


def rotate(angle: Column, by: Column, relative: Column) -> Column:
    return F.when(relative, F.coalesce(angle, F.lit(0.0)) + by).otherwise(by)


def expand_range(template: Column, first: Column, last: Column, name: str = "i") -> Column:
    """One text per number of the range; none when the range is empty."""
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.replace(template, F.lit(f"${{{name}}}"), i.cast("string")))
