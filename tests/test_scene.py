import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import scene as S


@pytest.mark.parametrize("tol,inclusive", [(10.0, True), (20.0, False)])
def test_proximity_matches_by_hand(spark, tol, inclusive):
    rng = random.Random(int(tol))
    # a crowded corner, coordinates on cell borders, and equal ids on both sides
    spot = lambda: float(rng.choice([rng.randrange(-40, 200), rng.randrange(0, 12), 10 * rng.randrange(0, 20)]))
    old = [(i, spot(), spot()) for i in range(150)]
    new = [(i, spot(), spot()) for i in range(140, 175)]
    near = (lambda d: d <= tol) if inclusive else (lambda d: d < tol)
    want = {i for i, x, y in old if not any(j != i and near(abs(a - x)) and near(abs(b - y)) for j, a, b in new)}
    cols = "id int, x double, y double"
    out = S.proximity_anti(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols), tol=tol, inclusive=inclusive)
    assert {r.id for r in out.collect()} == want
    assert 0 < len(want) < len(old)


def test_upsert_keeps_missing_columns_and_raises_version(spark):
    base = spark.createDataFrame([("a", 1.0, "red", 4), ("b", 2.0, "blue", 0)], "id string, x double, c string, version int")
    delta = spark.createDataFrame([("a", 9.0, None, 1), ("a", 5.0, None, 2), ("z", 7.0, "gray", 3)], "id string, x double, c string, seq int")
    got = {r.id: (r.x, r.c, r.version) for r in S.upsert_by_id(base, delta, "id", ["x", "c"], seq="seq").collect()}
    assert got == {"a": (5.0, "red", 5), "b": (2.0, "blue", 0), "z": (7.0, "gray", 1)}


ELEMENTS = "id string, x double, width double, height double, angle double, opacity double, prev_opacity double, groups array<string>, link string, version int"


def element(i, opacity=50.0, groups=()):
    return (i, 10.0, 4.0, 8.0, 0.0, opacity, None, list(groups), None, 1)


def apply(spark, elements, changes):
    e = spark.createDataFrame(elements, ELEMENTS)
    c = spark.createDataFrame([(n, *ch, *[None] * (4 - len(ch) + 1)) for n, ch in enumerate(changes)], S.CHANGE)
    return {r.id: r for r in S.apply_changes(e, c).collect()}


def test_commands(spark):
    got = apply(
        spark,
        [element("a"), element("b", 0.0), element("c", groups=["g"]), element("d", groups=["g"]), element("e"), element("f")],
        [
            ("hide", "a", None, None), ("show", "a", None, 70.0), ("show", "b", None, 30.0), ("group", "c", "g", None), ("group", "c", "h", None),
            ("ungroup", "c", None, None), ("ungroup", "d", None, None), ("delete", "e", None, None), ("front", "f", None, None), ("back", "f", None, None),
            ("move", "a", None, 50.0), ("move_by", "a", None, 5.0), ("scale", "b", None, 1.6), ("rotate_by", "d", None, 0.5), ("link", "a", "http://x", None),
        ],
    )
    assert (got["a"].opacity, got["a"].prev_opacity, got["a"].x, got["a"].link) == (0.0, 50.0, 15.0, "http://x")
    assert (got["b"].opacity, got["b"].width, got["b"].height) == (30.0, 6.0, 13.0)
    assert (got["c"].groups, got["d"].groups, got["d"].angle) == (["g", "h"], [], 0.5)
    assert "e" not in got
    assert (got["f"].band, got["f"].version, got["a"].version) == (-1, 1, 2)


def test_last_command_of_a_kind_counts(spark):
    got = apply(
        spark,
        [element("a"), element("b"), element("c")],
        [
            ("move_by", "a", None, 5.0), ("move", "a", None, 50.0), ("rotate_by", "a", None, 1.0), ("rotate", "a", None, 9.0),
            ("resize", "b", None, 30.0, 60.0), ("scale", "b", None, 2.0), ("scale", "c", None, 2.0), ("resize", "c", None, None, 60.0),
        ],
    )
    assert (got["a"].x, got["a"].angle) == (50.0, 9.0)
    assert [(got[k].width, got[k].height) for k in "bc"] == [(8.0, 16.0), (4.0, 60.0)]


def test_delete_everything(spark):
    assert apply(spark, [element("a"), element("b")], [("delete", "*", None, None)]) == {}


def test_anchors(spark):
    elements = spark.createDataFrame([("r", 10.0, 20.0, 4.0, None)], "id string, x double, y double, width double, height double")
    refs = spark.createDataFrame([("r",), ("3, 0",), ("bad,7",), ("gone",), (None,)], "ref string")
    got = {r.ref: (r.p_x, r.p_y) for r in S.resolve_anchor(refs, elements, "ref", "p", (1.0, 2.0)).collect()}
    assert got == {"r": (12.0, 20.0), "3, 0": (3.0, 0.0), "bad,7": (0.0, 7.0), "gone": (1.0, 2.0), None: (1.0, 2.0)}
    to = {r.ref: (r.p_x, r.p_y) for r in S.resolve_anchor(refs, elements, "ref", "p", (1.0, 2.0), target=True).collect()}
    assert to["bad,7"] == (1.0, 7.0)


def test_element_defaults(spark):
    cols = S.format_element({"x": F.lit("5"), "opacity": F.lit("0"), "type": F.lit("")})
    r = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    assert (r.x, r.y, r.width, r.opacity, r.type, r.fill_style) == (5.0, 100.0, 140.0, 100.0, "rectangle", "solid")


def test_commands_reach_rows_that_the_batch_adds(spark):
    old = [element("a"), element("b", 0.0), element("c"), element("d", groups=["g"])]
    added = [element("n", 70.0), element("b", 40.0), ("c", None, 9.0, None, None, None, None, None, None, 5), element("m", 20.0, ["x"])]
    ops = [("hide", "n", None, None), ("group", "n", "k", None), ("link", "m", "to", None), ("ungroup", "m", None, None), ("move_by", "m", None, 5.0), ("delete", "a", None, None), ("delete", "b", None, None), ("ungroup", "d", None, None), ("show", "gone", None, None)]
    changes = spark.createDataFrame([(k, op, i, text, number, None) for k, (op, i, text, number) in enumerate(ops)], S.CHANGE)
    out = S.merge_batch(spark.createDataFrame(old, ELEMENTS), spark.createDataFrame(added, ELEMENTS), changes)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {"n", "b", "c", "d", "m"}
    assert (got["n"].opacity, got["n"].prev_opacity, got["n"].groups, got["n"].version) == (0.0, 70.0, ["k"], 1)
    assert (got["m"].link, got["m"].groups, got["m"].x, got["m"].version) == ("to", ["x"], 15.0, 1)
    assert (got["b"].opacity, got["b"].version) == (40.0, 1)  # deleted and added anew
    assert (got["c"].x, got["c"].width, got["c"].version) == (10.0, 9.0, 2) and (got["d"].groups, got["d"].version) == ([], 2)
