"""Keyed scene tables: defaults, box joins, upserts and change commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.scene import DEFAULTS, move, resize, rotate, scale_points

# The words that address every element.
EVERYTHING = ("*", "all")
NEAR = 10.0


def format_element(raw: dict[str, Column]) -> dict[str, Column]:
    """Geometry and style of an element with its defaults; 0 counts as missing for stroke width and opacity."""
    number = lambda n: raw.get(n, F.lit(None)).try_cast("double")
    text = lambda n, d: F.coalesce(F.nullif(raw.get(n, F.lit(None)).cast("string"), F.lit("")), F.lit(d))
    return {
        "type": text("type", "rectangle"),
        **{n: F.coalesce(number(n), F.lit(DEFAULTS[n])) for n in ("x", "y", "width", "height")},
        **{n: F.coalesce(F.nullif(number(n), F.lit(0.0)), F.lit(DEFAULTS[n])) for n in ("stroke_width", "opacity")},
        "stroke_color": text("stroke_color", "#1e1e1e"),
        "background_color": text("background_color", "transparent"),
        "fill_style": text("fill_style", "solid"),
    }


def proximity_anti(old: DataFrame, new: DataFrame, key: str = "id", x: str = "x", y: str = "y", tol: float = NEAR, inclusive: bool = True):
    """Old rows that have no new row with another key within `tol` in both directions.

    Both sides fall into cells as wide as the tolerance. A new row in the same cell always is near
    (both differences stay below the tolerance), so one row per cell with the least and the greatest key
    settles most old rows, also in a crowded cell. What is left meets the distinct positions of the new
    rows in the cells around it.
    """
    # coordinates are finite; a cell is half open, [n · tol, (n + 1) · tol)
    cell = lambda c: F.floor(F.col(c) / tol)
    placed = old.withColumns({"_cx": cell(x), "_cy": cell(y)})
    spots = (
        new.groupBy(F.col(x).alias("_nx"), F.col(y).alias("_ny"))
        .agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        .withColumns({"_cx": cell("_nx"), "_cy": cell("_ny")})
    )
    cells = spots.groupBy("_cx", "_cy").agg(F.min("_lo").alias("_clo"), F.max("_hi").alias("_chi"))
    other = lambda lo, hi: (F.col(lo) != F.col(key)) | (F.col(hi) != F.col(key))
    alone = placed.join(cells, ["_cx", "_cy"], "left").filter(
        F.col("_clo").isNull() | ~other("_clo", "_chi")
    ).drop("_clo", "_chi")
    near = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    around = spots.withColumn("_d", F.explode(F.array(*near))).select(
        (F.col("_cx") + F.col("_d.a")).alias("_cx"), (F.col("_cy") + F.col("_d.b")).alias("_cy"), "_nx", "_ny", "_lo", "_hi"
    )
    dx, dy = F.abs(alone[x] - around["_nx"]), F.abs(alone[y] - around["_ny"])
    close = (dx <= tol) & (dy <= tol) if inclusive else (dx < tol) & (dy < tol)
    met = (
        (alone["_cx"] == around["_cx"])
        & (alone["_cy"] == around["_cy"])
        & close
        & ((around["_lo"] != alone[key]) | (around["_hi"] != alone[key]))
    )
    return alone.join(around, met, "left_anti").select(*old.columns)


def upsert_by_id(base: DataFrame, delta: DataFrame, key: str, columns: Sequence[str], version: str = "version", seq: str | None = None):
    """New rows override the columns that they provide and raise the version; unknown keys are added."""
    if seq is not None:
        rest = [c for c in delta.columns if c not in (key, seq)]
        delta = delta.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")
    new = delta.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = base.join(new, F.col(key) == F.col("_key"), "full_outer")
    known, changed = F.col(key).isNotNull(), F.coalesce(F.col("_new"), F.lit(False))
    raised = F.when(known & changed, F.coalesce(F.nullif(F.col(version), F.lit(0)), F.lit(1)) + 1).when(known, F.col(version))
    return joined.select(
        F.coalesce(key, "_key").alias(key),
        *[F.coalesce(f"_n_{c}", c).alias(c) for c in columns],
        F.coalesce(raised, F.lit(1)).alias(version),
    )


def resolve_anchor(df: DataFrame, elements: DataFrame, ref: str, name: str, default: tuple[float, float], target: bool = False):
    """Add `name_x`, `name_y`: an `x,y` literal, the centre of the referenced element, or the default."""
    centre = elements.select(
        F.col("id").alias("_id"),
        (F.col("x") + F.coalesce("width", F.lit(0.0)) / 2).alias("_cx"),
        (F.col("y") + F.coalesce("height", F.lit(0.0)) / 2).alias("_cy"),
    )
    joined = df.join(centre, F.col(ref) == F.col("_id"), "left")
    literal = F.col(ref).contains(",")
    part = lambda i, d: F.coalesce(F.trim(F.split_part(F.col(ref), F.lit(","), F.lit(i))).try_cast("double"), F.lit(d))
    return joined.withColumns(
        {
            f"{name}_x": F.when(literal, part(1, default[0] if target else 0.0)).otherwise(F.coalesce("_cx", F.lit(default[0]))),
            f"{name}_y": F.when(literal, part(2, 0.0)).otherwise(F.coalesce("_cy", F.lit(default[1]))),
        }
    ).drop("_id", "_cx", "_cy")


# -- change commands -----------------------------------------------------------------------------

CHANGE = "seq long, op string, id string, text string, number double, second double"


def commands(changes: DataFrame) -> DataFrame:
    """One row per element id with its net commands; a later change of a kind replaces an earlier one.

    `changes`: seq, op, id, text, number, second. A move gives x and y (`move_by` differences), a resize width and
    height (`scale` a factor), a rotation an angle (`rotate_by` a difference). The last command of each kind counts,
    with all of its values. One aggregate with map-side partial results.
    """
    kind = lambda name, ops, relative: F.max_by(
        F.struct(F.col("op").isin(*relative).alias("relative"), F.col("number").alias("a"), F.col("second").alias("b")),
        F.when(F.col("op").isin(*ops), F.col("seq")),
    ).alias(name)
    op = lambda name: F.col("op") == name
    has = lambda name: F.max(F.when(op(name), True)).alias(name)
    last = lambda name, value: F.max_by(value, F.when(op(name), F.col("seq"))).alias(name)
    return changes.groupBy("id").agg(
        has("delete"),
        has("hide"),
        last("show", F.coalesce("number", F.lit(100.0))),
        last("group", F.col("text")),
        has("ungroup"),
        F.max_by(F.col("text"), F.when(op("link"), F.col("seq"))).alias("link_to"),
        has("front"),
        has("back"),
        kind("moved", ("move", "move_by"), ("move_by",)),
        kind("sized", ("resize", "scale"), ("scale",)),
        kind("turned", ("rotate", "rotate_by"), ("rotate_by",)),
    )


def hide_show(opacity: Column, prev: Column, hide: Column, show: Column) -> tuple[Column, Column]:
    """(opacity, remembered opacity); hiding wins over showing."""
    hidden = F.coalesce(hide, F.lit(False))
    remembered = F.when(opacity != 0, opacity).otherwise(F.coalesce(F.nullif(prev, F.lit(0.0)), F.lit(100.0)))
    return (
        F.when(hidden, F.lit(0.0)).when(show.isNotNull(), show).otherwise(opacity),
        F.when(hidden, remembered).otherwise(prev),
    )


def group_tags(groups: Column, add: Column, clear: Column) -> Column:
    """Group tags after adding one (which wins) or clearing all."""
    none = F.array().cast("array<string>")
    return (
        F.when(add.isNotNull(), F.array_union(F.coalesce(groups, none), F.array(add)))
        .when(F.coalesce(clear, F.lit(False)), none)
        .otherwise(groups)
    )


def whole_delete(changes: DataFrame) -> Column:
    """Aggregate: whether one of the changes deletes everything."""
    return F.coalesce(F.max((F.col("op") == "delete") & F.col("id").isin(*EVERYTHING)), F.lit(False))


def _kept(elements: DataFrame, changes: DataFrame, net: DataFrame) -> DataFrame:
    """The elements that the changes do not delete, with their net commands."""
    whole = changes.agg(whole_delete(changes).alias("_all"))
    return elements.join(net, "id", "left").filter(~whole.scalar() & ~F.coalesce("delete", F.lit(False)))


def _commanded(rows: DataFrame, columns: Sequence[str], kinds: Sequence[str], fresh: Column | None = None, replaced: Column | None = None) -> DataFrame:
    """`columns` of the rows after their net commands, and the layer band.

    A `fresh` row comes with the batch: it remembers its opacity as it is when hidden, has no tags to clear and keeps its
    version. A `replaced` row has changed even without a command.
    """
    fresh, replaced = (F.lit(False) if c is None else c for c in (fresh, replaced))
    opacity, prev = hide_show(F.col("opacity"), F.col("prev_opacity"), F.col("hide"), F.col("show"))
    prev = F.when(fresh & F.coalesce("hide", F.lit(False)), F.col("opacity")).otherwise(prev)
    touched = F.coalesce(*[F.when(F.col(k).isNotNull(), True) for k in kinds if k not in ("front", "back", "delete")], F.lit(False))
    yes = lambda k: F.coalesce(F.col(f"{k}.relative"), F.lit(False))
    factor = F.col("sized.a")
    new = {
        "opacity": opacity,
        "prev_opacity": prev,
        "groups": group_tags(F.col("groups"), F.col("group"), F.col("ungroup") & ~fresh),
        "link": F.coalesce(F.col("link_to"), F.col("link")),
        "x": move(F.col("x"), F.col("moved.a"), F.col("moved.a"), yes("moved")),
        "width": resize(F.col("width"), F.col("sized.a"), factor, yes("sized")),
        "height": resize(F.col("height"), F.col("sized.b"), factor, yes("sized")),
        "angle": F.when(
            F.col("turned").isNotNull(), rotate(F.col("angle"), F.coalesce("turned.a", F.lit(0.0)), yes("turned"))
        ).otherwise(F.col("angle")),
        "version": F.when((touched | replaced) & ~fresh, F.coalesce(F.nullif(F.col("version"), F.lit(0)), F.lit(1)) + 1).otherwise(F.col("version")),
        "band": F.when(F.coalesce("back", F.lit(False)), -1).when(F.coalesce("front", F.lit(False)), 1).otherwise(0),
    }
    if "y" in columns:
        new["y"] = move(F.col("y"), F.col("moved.b"), F.col("moved.b"), yes("moved"))
    if "points" in columns:
        new["points"] = F.when(yes("sized") & (factor > 0), scale_points(F.col("points"), factor)).otherwise(F.col("points"))
    return rows.select(*[new.pop(c).alias(c) if c in new else F.col(c) for c in columns], *[v.alias(n) for n, v in new.items()])


def _netted(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    if "second" not in changes.columns:
        changes = changes.withColumn("second", F.lit(None).cast("double"))
    return changes, commands(changes)


def apply_changes(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """Elements after the change commands: deletes, hide and show, groups, links, geometry, layer band, version.

    `elements`: id, x, y, width, height, angle, points, opacity, prev_opacity, groups, link, version, ...; y and points
    may be missing. `changes` may lack the second value.
    """
    changes, net = _netted(changes)
    return _commanded(_kept(elements, changes, net), elements.columns, [c for c in net.columns if c != "id"])


def merge_batch(elements: DataFrame, added: DataFrame, changes: DataFrame) -> DataFrame:
    """Elements after a batch that brings new rows and change commands for old and new ones.

    Deletes meet the old elements only. A new row with the id of an element that stays overrides the columns it gives
    (null: not given); any other is new itself. Commands then reach both: also an element that the same batch adds is
    hidden, shown, grouped, linked and moved. `added` has the columns of `elements`, each id once.
    """
    changes, net = _netted(changes)
    kinds = [c for c in net.columns if c != "id"]
    old = _kept(elements, changes, net).select(*elements.columns, F.lit(True).alias("_old"))
    given = added.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in elements.columns if c != "id"], F.lit(True).alias("_new"))
    both = old.join(given, F.col("id") == F.col("_id"), "full_outer")
    merged = both.select(
        F.coalesce("id", "_id").alias("id"), *[F.coalesce(f"_n_{c}", c).alias(c) if c != "version" else F.coalesce(c, f"_n_{c}").alias(c) for c in elements.columns if c != "id"],
        F.col("_old").isNull().alias("_fresh"), (F.col("_old") & F.col("_new")).alias("_replaced"),
    )
    rows = merged.join(net, "id", "left")
    return _commanded(rows, elements.columns, kinds, F.col("_fresh"), F.coalesce("_replaced", F.lit(False)))
