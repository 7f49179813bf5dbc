"""Numeric rules on arrays and page measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the page rules.
BLANK_DENSITY = 0.005
ASPECT_LIMIT = 0.30
EDGE_LIMIT = 0.02
WHITE_LIMIT = 0.30
LANDSCAPE = 1.3
SEAM_CONFIDENCE = 140
QUAD_MIN, QUAD_MAX = 0.10, 0.998
SPEECH_LEVEL = 0.01


def rms(samples: Column) -> Column:
    """Root of the mean square; 0 for no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def speech_state(samples: Column, level: float = SPEECH_LEVEL) -> Column:
    return F.when(rms(samples) > level, "speaking").otherwise("silence")


def mix_down(samples: Column, channels: int) -> Column:
    """Mean over the channels of each frame; a last short frame divides by the full count."""
    frames = F.ceil(F.size(samples) / channels).cast("int")
    return F.transform(
        F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.aggregate(
            F.slice(samples, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, x: a + x.cast("double")
        )
        / channels,
    )


def resample_nearest(samples: Column, rate: int, target: int = 16000) -> Column:
    """Every sample at index floor(i · rate / target)."""
    count = F.floor(F.size(samples) * F.lit(target) / rate).cast("int")
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.element_at(samples, (F.floor(i * F.lit(rate) / target) + 1).cast("int")),
    )


def quad_area_ratio(points: Column, width: Column, height: Column) -> Column:
    """Area of a polygon of ordered (x, y) points over the area of its image (shoelace sum)."""
    n = F.size(points)
    turned = F.concat(F.slice(points, F.lit(2), n - 1), F.slice(points, F.lit(1), F.lit(1)))
    cross = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2 / (width * height)


def valid_quad(points: Column, width: Column, height: Column) -> Column:
    return (F.size(points) == 4) & quad_area_ratio(points, width, height).between(QUAD_MIN, QUAD_MAX)


def aspect_diff(src_w: Column, src_h: Column, out_w: Column, out_h: Column) -> Column:
    source = src_w / src_h
    return F.abs(source - out_w / out_h) / F.greatest(source, F.lit(0.001))


def page_issues(density: Column, aspect: Column, edge_max: Column, white_min: Column) -> Column:
    """Names of the rules that a page breaks, in rule order."""
    return F.filter(
        F.array(
            F.when(density < BLANK_DENSITY, "blank"),
            F.when(aspect > ASPECT_LIMIT, "aspect"),
            F.when(edge_max > EDGE_LIMIT, "clipped"),
            F.when(white_min < WHITE_LIMIT, "background"),
        ),
        lambda v: v.isNotNull(),
    )


def spread_class(width: Column, height: Column, confidence: Column) -> Column:
    return (
        F.when(width / height >= LANDSCAPE, "landscape_spread")
        .when((height > width) & (confidence > SEAM_CONFIDENCE), "portrait_spread")
        .otherwise("single")
    )


def seam_offset_pct(position: Column, size: Column) -> Column:
    return (position / size - 0.5) * 100
