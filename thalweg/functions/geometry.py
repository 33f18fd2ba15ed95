"""Columns over geometries: lines are arrays of struct<x,y,z,m>, polygons arrays of closed rings of such arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double,z:double,m:double>"


def vertex(x, y, z=None, m=None) -> Column:
    null = F.lit(None).cast("double")
    parts = {"x": x, "y": y, "z": null if z is None else z, "m": null if m is None else m}
    return F.struct(*((F.col(v) if isinstance(v, str) else v).cast("double").alias(k) for k, v in parts.items()))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def segments(line: Column) -> Column:
    """Pairs of consecutive vertices, with the segment's place from 0."""
    ends = F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))
    starts = F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s, i: F.struct(i.alias("at"), s["a"].alias("a"), s["b"].alias("b")))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def measured(line: Column) -> Column:
    """Segments with their distance from the line's start: struct<at,a,b,start,len>."""
    kind = f"array<struct<at:int,a:{VERTEX},b:{VERTEX},start:double,len:double>>"
    parts = segments(line)
    # Appending copies what is there, so a block of segments at a time is appended: blocks are as long as they are many.
    wide = F.greatest(F.ceil(F.sqrt(F.size(line).cast("double"))), F.lit(1)).cast("int")
    blocks = F.aggregate(F.array(F.struct(parts.alias("p"), wide.alias("w"))), F.array().cast(f"array<{kind.replace(',start:double,len:double', '')}>"), lambda _, s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s["p"]), F.lit(1)), s["w"]), lambda i: F.slice(s["p"], i, s["w"])))

    def step(acc: Column, s: Column) -> Column:
        size = distance(s["a"], s["b"])
        return F.struct((acc["d"] + size).alias("d"), F.array_append(acc["out"], F.struct(s["at"].alias("at"), s["a"].alias("a"), s["b"].alias("b"), acc["d"].alias("start"), size.alias("len"))).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        return F.aggregate(b, F.struct(acc["d"].alias("d"), F.array().cast(kind).alias("out")), step, lambda done: F.struct(done["d"].alias("d"), F.array_append(acc["out"], done["out"]).alias("out")))

    zero = F.struct(F.lit(0.0).alias("d"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(blocks, zero, block, lambda acc: F.flatten(acc["out"]))


def between(a: Column, b: Column, t: Column) -> Column:
    """The point at fraction t from a to b."""
    return F.struct(*((a[k] + (b[k] - a[k]) * t).alias(k) for k in "xyzm"))


def at_distance(line: Column, d: Column) -> Column:
    """The point at a distance along the line, clamped to its ends."""
    held = f"struct<a:{VERTEX},b:{VERTEX},start:double,len:double>"
    # d is worked out once and goes along, as does the last segment that starts before it.
    zero = F.struct(d.cast("double").alias("want"), F.lit(0.0).alias("start"), F.element_at(line, 1).cast(VERTEX).alias("first"), F.lit(None).cast(held).alias("last"))

    def step(acc: Column, s: Column) -> Column:
        size = distance(s["a"], s["b"])
        here = F.struct(s["a"].cast(VERTEX).alias("a"), s["b"].cast(VERTEX).alias("b"), acc["start"].alias("start"), size.alias("len"))
        return F.struct(acc["want"].alias("want"), (acc["start"] + size).alias("start"), acc["first"].alias("first"), F.when((acc["start"] <= acc["want"]) & (size > 0), here).otherwise(acc["last"]).alias("last"))

    def place(acc: Column) -> Column:
        last = acc["last"]
        return F.when(last.isNotNull(), between(last["a"], last["b"], F.least((acc["want"] - last["start"]) / last["len"], F.lit(1.0)))).otherwise(acc["first"])

    return F.aggregate(segments(line), zero, step, place)


def angle(a: Column, b: Column) -> Column:
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def ring_area(ring: Column) -> Column:
    """Unsigned area of a closed ring."""
    # About the first vertex, so that small rings far from the origin keep their digits.
    first = F.element_at(ring, 1)
    zero = F.struct(F.lit(0.0).alias("sum"), first["x"].alias("x"), first["y"].alias("y"))
    step = lambda acc, s: F.struct((acc["sum"] + (s["a"]["x"] - acc["x"]) * (s["b"]["y"] - acc["y"]) - (s["b"]["x"] - acc["x"]) * (s["a"]["y"] - acc["y"])).alias("sum"), acc["x"].alias("x"), acc["y"].alias("y"))
    return F.abs(F.aggregate(segments(ring), zero, step, lambda acc: acc["sum"])) / 2


def polygon_area(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc - ring_area(r)) + 2 * ring_area(F.element_at(rings, 1))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast."""

    def crosses(s: Column) -> Column:
        up = (s["a"]["y"] > y) != (s["b"]["y"] > y)
        return up & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.when(s["b"]["y"] != s["a"]["y"], s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])

    return F.size(F.filter(segments(ring), lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    return F.aggregate(rings, F.lit(False), lambda acc, r: acc != in_ring(x, y, r))


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Fraction along a-b of the point of the segment nearest to p."""
    size = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.when(size > 0, size)
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def cross(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Positive where p lies left of a-b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)
