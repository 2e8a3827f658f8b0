"""Planar geometry of warning polygons as native columns over array<struct<lat float, lon float>>.

Polygons have at most twenty points, so the quadratic tests stay small. A ring is the polygon without repeated
neighbours and without the closing point; a polygon that has fewer than three points left, or crosses itself, has
no area, contains nothing decidable and overlaps nothing: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: lengths and areas up to this count as none.
EPSILON = 1e-9


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: without it, each mention would repeat the value's whole expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _same(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) <= EPSILON) & (F.abs(a["y"] - b["y"]) <= EPSILON)


def _last(points: Column) -> Column:
    return F.try_element_at(points, F.lit(-1))


def _closed_up(points: Column) -> Column:
    """Points without repeated neighbours and without a last one that repeats the first."""
    none = F.slice(points, 1, 0)
    kept = F.aggregate(points, none, lambda acc, p: F.when((F.size(acc) > 0) & _same(_last(acc), p), acc).otherwise(F.concat(acc, F.array(p))))
    return _let(kept, lambda k: F.when((F.size(k) > 1) & _same(F.try_element_at(k, F.lit(1)), _last(k)), F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0)))).otherwise(k))


def ring(points: Column) -> Column:
    """array<struct<x double, y double>> (x: longitude), null if fewer than three points are left."""
    planar = F.transform(points, lambda p: F.struct(p["lon"].cast("double").alias("x"), p["lat"].cast("double").alias("y")))
    known = F.forall(planar, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < 1e308) & (F.abs(p["y"]) < 1e308))
    return F.when(known, _let(_closed_up(planar), lambda r: F.when(F.size(r) >= 3, r)))


def _turned(points: Column, by: int) -> Column:
    """The points in order from the one `by` places on."""
    return F.concat(F.slice(points, by + 1, F.size(points)), F.slice(points, 1, by))


def _edges(points: Column) -> Column:
    return F.zip_with(points, _turned(points, 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _between(a: Column, p: Column, b: Column) -> Column:
    low = lambda k: F.least(a[k], b[k]) - EPSILON
    high = lambda k: F.greatest(a[k], b[k]) + EPSILON
    return (p["x"] >= low("x")) & (p["x"] <= high("x")) & (p["y"] >= low("y")) & (p["y"] <= high("y"))


def _meet(e: Column, f: Column) -> Column:
    """Whether two edges cross or touch."""
    sides = F.array(_cross(e["a"], e["b"], f["a"]), _cross(e["a"], e["b"], f["b"]), _cross(f["a"], f["b"], e["a"]), _cross(f["a"], f["b"], e["b"]))
    return _let(sides, lambda s: _sides_meet(e, f, s))


def _sides_meet(e: Column, f: Column, sides: Column) -> Column:
    apart = lambda s, t: ((s > EPSILON) & (t < -EPSILON)) | ((s < -EPSILON) & (t > EPSILON))
    flat = lambda s: F.abs(s) <= EPSILON
    touch = (flat(sides[0]) & _between(e["a"], f["a"], e["b"])) | (flat(sides[1]) & _between(e["a"], f["b"], e["b"])) | (flat(sides[2]) & _between(f["a"], e["a"], f["b"])) | (flat(sides[3]) & _between(f["a"], e["b"], f["b"]))
    return (apart(sides[0], sides[1]) & apart(sides[2], sides[3])) | touch


def crosses_itself(points: Column) -> Column:
    """Whether edges of a ring that are not neighbours meet."""
    edges = F.transform(_let(points, _edges), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    apart = lambda every, e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == F.size(every) - 1))
    return _let(edges, lambda every: F.exists(every, lambda e: F.exists(every, lambda f: apart(every, e, f) & _meet(e, f))))


def signed_area(points: Column) -> Column:
    terms = F.transform(_let(points, _edges), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2


def is_convex(points: Column) -> Column:
    """All turns of a ring that are any have one direction, and there is one."""
    corners = _let(points, lambda r: F.zip_with(_edges(r), _turned(r, 2), lambda e, c: _cross(e["a"], e["b"], c)))
    turns = F.filter(corners, lambda t: F.abs(t) > EPSILON)
    return _let(turns, lambda found: (F.size(found) > 0) & (F.forall(found, lambda t: t > 0) | F.forall(found, lambda t: t < 0)))


def area(polygon: Column) -> Column:
    """Square degrees, null for no simple polygon."""
    return _let(ring(polygon), lambda r: F.when(r.isNotNull() & ~crosses_itself(r), F.abs(signed_area(r))))


def with_area(points: Column) -> Column:
    """The ring if it does not cross itself and has an area, else null: what holds_point takes."""
    return _let(points, lambda r: F.when(r.isNotNull() & ~crosses_itself(r) & (F.abs(signed_area(r)) > EPSILON), r))


def box(points: Column) -> Column:
    """south, north, west and east of a ring, wider by what still counts as its border."""
    gap = 1e-6
    low = lambda k: F.array_min(F.transform(points, lambda p: p[k])) - gap
    high = lambda k: F.array_max(F.transform(points, lambda p: p[k])) + gap
    return F.struct(low("y").alias("south"), high("y").alias("north"), low("x").alias("west"), high("x").alias("east"))


def contains(polygon: Column, lat: Column, lon: Column) -> Column:
    """Whether the polygon holds the point, its border included; null for no simple polygon with an area."""
    return holds_point(with_area(ring(polygon)), lat, lon)


def holds_point(valid: Column, lat: Column, lon: Column) -> Column:
    """contains() for a ring from with_area(), whose tests need not be made for each point."""

    def hit(e: Column, p: Column) -> Column:
        # Each edge is seen from its end back to its start, so that equal edges round alike everywhere.
        a, b = e["b"], e["a"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        return F.when(spans, p["x"] < a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])).otherwise(False)

    def decided(r: Column, p: Column) -> Column:
        border = F.exists(_edges(r), lambda e: (F.abs(_cross(e["a"], e["b"], p)) <= EPSILON) & _between(e["a"], p, e["b"]))
        odd = F.size(F.filter(_edges(r), lambda e: hit(e, p))) % 2 == 1
        return F.when(r.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull(), border | odd)

    point = F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))
    return _let(F.struct(valid.alias("r"), point.alias("p")), lambda v: decided(v["r"], v["p"]))


def _clipped(points: Column, e: Column, left: Column) -> Column:
    """What of the points lies on the inner side of an edge; `left`: the inside is to its left."""
    inside = lambda p: F.when(left, _cross(e["a"], e["b"], p) >= -EPSILON).otherwise(_cross(e["a"], e["b"], p) <= EPSILON)

    def cut(a: Column, b: Column) -> Column:
        sx, sy, ex, ey = b["x"] - a["x"], b["y"] - a["y"], e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        turn = sx * ey - sy * ex
        scale = ((e["a"]["x"] - a["x"]) * ey - (e["a"]["y"] - a["y"]) * ex) / F.when(F.abs(turn) > EPSILON, turn)
        return F.when(scale.isNotNull(), F.struct((a["x"] + scale * sx).alias("x"), (a["y"] + scale * sy).alias("y")))

    def step(s: Column) -> Column:
        known = F.struct(inside(s["a"]).alias("a"), inside(s["b"]).alias("b"))
        return _let(known, lambda k: F.array(F.when(k["a"] != k["b"], cut(s["a"], s["b"])), F.when(k["b"], s["b"])))

    # Each point with the one before it.
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))
    pairs = F.when(F.size(points) > 0, F.zip_with(before, points, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return F.coalesce(_closed_up(F.array_compact(F.flatten(F.transform(pairs, step)))), F.slice(points, 1, 0))


def shape(polygon: Column) -> Column:
    """A polygon's ring (corners) and what is told of it, found once: whether it crosses itself and is convex, its signed area,
    and the box that it is, if its edges run along the axes. Null without a ring."""

    def told(r: Column) -> Column:
        ends = lambda f, c: f(F.transform(r, lambda p: p[c]))
        box_ = F.struct(ends(F.array_min, "y").alias("south"), ends(F.array_max, "y").alias("north"), ends(F.array_min, "x").alias("west"), ends(F.array_max, "x").alias("east"))
        # The edges of a box never meet, and all its turns are its area; the tests of edges take many times what the rest does.
        side = lambda k: F.try_element_at(r, F.lit(3))[k] - F.try_element_at(r, F.lit(1))[k]
        crosses = F.when(_upright(r), F.lit(False)).otherwise(crosses_itself(r))
        convex = F.when(_upright(r), F.abs(side("x") * side("y")) > EPSILON).otherwise(is_convex(r))
        return F.when(r.isNotNull(), F.struct(r.alias("corners"), crosses.alias("crosses"), convex.alias("convex"), signed_area(r).alias("signed"), F.when(_upright(r), box_).alias("box")))

    return _let(ring(polygon), told)


def area_of(shape_: Column) -> Column:
    """area() of a shape."""
    return F.when(~shape_["crosses"], F.abs(shape_["signed"]))


def solid(shape_: Column) -> Column:
    """with_area() of a shape."""
    return F.when(~shape_["crosses"] & (F.abs(shape_["signed"]) > EPSILON), shape_["corners"])


def _upright(points: Column) -> Column:
    """Whether a ring has four corners and edges along the axes, in turn."""
    same = lambda i, j, k: F.try_element_at(points, F.lit(i))[k] == F.try_element_at(points, F.lit(j))[k]
    turns = lambda k, m: same(1, 2, k) & same(2, 3, m) & same(3, 4, k) & same(4, 1, m)
    return (F.size(points) == 4) & (turns("x", "y") | turns("y", "x"))


def overlap_area(one: Column, other: Column) -> Column:
    """Square degrees that two convex polygons share; null if one is not simple and convex."""
    return _let(F.struct(shape(one).alias("a"), shape(other).alias("b")), lambda v: shared_area(v["a"], v["b"]))


def shared_area(one: Column, other: Column) -> Column:
    """overlap_area() of two shapes. Boxes need no clipping."""

    def clipped(a: Column, b: Column) -> Column:
        left = b["signed"] >= 0
        inner = F.aggregate(_edges(b["corners"]), a["corners"], lambda acc, e: _clipped(acc, e, left))
        return _let(inner, lambda c: F.when(F.size(c) < 3, F.lit(0.0)).otherwise(F.abs(signed_area(c))))

    width = lambda low, high: F.greatest(F.lit(0.0), F.least(one["box"][high], other["box"][high]) - F.greatest(one["box"][low], other["box"][low]))
    boxes = one["box"].isNotNull() & other["box"].isNotNull()
    fit = ~one["crosses"] & ~other["crosses"] & one["convex"] & other["convex"]
    return F.when(boxes, width("south", "north") * width("west", "east")).when(fit, _let(F.struct(one.alias("a"), other.alias("b")), lambda v: clipped(v["a"], v["b"])))


def nonnegative(x: Column) -> Column:
    return F.when(F.abs(x) <= EPSILON, F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))


def share(part: Column, whole: Column, least: float = EPSILON) -> Column:
    """part / whole within [0, 1]; null if the whole is no more than `least`."""
    return F.when(part.isNotNull() & (whole > least), F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole)))
