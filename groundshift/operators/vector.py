"""Vector geometry as columns: UTM, measures, fishnets, zonal statistics, clipping and spatial joins.

A geometry is an array of struct<x, y>; rings are closed. Measures and predicates are higher-order functions inside
code generation; only round buffers, which have no closed form for general shapes, use an Arrow function.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# WGS 84 ellipsoid and UTM constants.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Rectifying radius and the Krueger coefficients of order four, from the third flattening n."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return radius, alpha, beta, delta


def utm_forward(lon: Column, lat: Column, zone: int = 44) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) of degrees."""
    radius, alpha, _, _ = _series()
    n = FLATTENING / (2 - FLATTENING)
    k = 2 * math.sqrt(n) / (1 + n)
    s, dl = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - F.atanh(s * k) * k)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))
    north, east = xi, eta
    for j, a in enumerate(alpha, 1):
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
    return east * (SCALE * radius) + FALSE_EASTING, north * (SCALE * radius)


def utm_inverse(x: Column, y: Column, zone: int = 44) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of UTM coordinates."""
    radius, _, beta, delta = _series()
    xi0, eta0 = y / (SCALE * radius), (x - FALSE_EASTING) / (SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j)) * b
        eta = eta - F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j)) * b
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.sin(chi * (2 * j)) * d
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183), F.degrees(lat)


def assert_srid(df: DataFrame, expected: int, actual: int | None) -> DataFrame:
    if actual is None:
        raise ValueError("layer has no CRS")
    if actual != expected:
        raise ValueError(f"Expected CRS EPSG:{expected}, got EPSG:{actual}")
    return df


def parse_wkt(text: Column) -> Column:
    """Outer ring, line or point of a WKT text as array<struct<x,y>>; built-in functions only."""
    body = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    numbers = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(body, ","), lambda p: F.struct(F.element_at(numbers(p), 1).cast("double").alias("x"), F.element_at(numbers(p), 2).cast("double").alias("y")))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def _steps(geom: Column) -> Column:
    return F.arrays_zip(F.slice(geom, 1, F.size(geom) - 1).alias("a"), F.slice(geom, 2, F.size(geom) - 1).alias("b"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Shoelace area in squared units; 0 for fewer than three points."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(ring, i)["x"] * F.try_element_at(ring, i + 1)["y"] - F.try_element_at(ring, i + 1)["x"] * F.try_element_at(ring, i)["y"], F.lit(0.0)))
    return F.abs(_sum(pairs)) / 2


def line_length(line: Column) -> Column:
    """Length of a line, or perimeter of a ring."""
    d = lambda i, c: F.try_element_at(line, i + 1)[c] - F.try_element_at(line, i)[c]
    return _sum(F.transform(F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1))), lambda i: F.coalesce(F.sqrt(d(i, "x") * d(i, "x") + d(i, "y") * d(i, "y")), F.lit(0.0))))


def bounds(geom: Column) -> dict[str, Column]:
    xs, ys = F.transform(geom, lambda p: p["x"]), F.transform(geom, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a pixel centre on the lower or left edge is inside, on the upper or right edge outside."""
    p = lambda i, c: F.element_at(ring, i)[c]
    crossing = lambda i: ((p(i, "y") > y) != (p(i + 1, "y") > y)) & (x < F.try_divide((p(i + 1, "x") - p(i, "x")) * (y - p(i, "y")), p(i + 1, "y") - p(i, "y")) + p(i, "x"))
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0), lambda a, i: a + F.coalesce(crossing(i), F.lit(False)).cast("int")) % 2 == 1


def boxes_intersect(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def rings_intersect(a: Column, b: Column) -> Column:
    """Whether two closed simple rings have a point in common: edges that touch or cross, or one ring inside the other."""

    def edges(ring: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("p"), F.element_at(ring, i + 1).alias("q")))

    def side(e: Column, p: Column) -> Column:
        return F.signum((e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (p["x"] - e["p"]["x"]))

    def overlap(e: Column, f: Column, axis: str) -> Column:
        low = lambda g: F.least(g["p"][axis], g["q"][axis])
        high = lambda g: F.greatest(g["p"][axis], g["q"][axis])
        return (low(e) <= high(f)) & (low(f) <= high(e))

    def touch(e: Column, f: Column) -> Column:
        return overlap(e, f, "x") & overlap(e, f, "y") & (side(e, f["p"]) * side(e, f["q"]) <= 0) & (side(f, e["p"]) * side(f, e["q"]) <= 0)

    within = contains_point(a, F.element_at(b, 1)["x"], F.element_at(b, 1)["y"]) | contains_point(b, F.element_at(a, 1)["x"], F.element_at(a, 1)["y"])
    return F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: touch(e, f))) | within


def clip_to_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sutherland-Hodgman against the four sides of a box; exact for convex rings, as cells and windows are.

    A fold over the sides: what is left after each one is a lambda variable, so the expression stays small.
    """
    side = lambda x, limit, low: F.struct(F.lit(x).alias("x"), limit.cast("double").alias("limit"), F.lit(low).alias("low"))
    sides = F.array(side(True, x0, True), side(True, x1, False), side(False, y0, True), side(False, y1, False))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def cut(left: Column, s: Column) -> Column:
        along = lambda p: F.when(s["x"], p["x"]).otherwise(p["y"])
        inside = lambda p: F.when(s["low"], along(p) >= s["limit"]).otherwise(along(p) <= s["limit"])

        def crossing(a: Column, b: Column) -> Column:
            share = F.coalesce(F.try_divide(s["limit"] - along(a), along(b) - along(a)), F.lit(0.0))
            return F.struct(F.when(s["x"], s["limit"]).otherwise(a["x"] + (b["x"] - a["x"]) * share).alias("x"), F.when(s["x"], a["y"] + (b["y"] - a["y"]) * share).otherwise(s["limit"]).alias("y"))

        def edge(ab: Column) -> Column:
            a, b = ab["a"], ab["b"]
            return F.array_compact(F.array(F.when(inside(a), a), F.when(inside(a) != inside(b), crossing(a, b))))

        pairs = F.transform(F.sequence(F.lit(1), F.size(left) - 1), lambda i: F.struct(F.element_at(left, i).alias("a"), F.element_at(left, i + 1).alias("b")))
        points = F.when(F.size(left) > 1, F.flatten(F.transform(pairs, edge))).otherwise(F.slice(left, 1, 0))
        return once(points, lambda p: F.when(F.size(p) > 0, F.concat(p, F.slice(p, 1, 1))).otherwise(p))

    plain = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.aggregate(sides, plain.cast("array<struct<x:double,y:double>>"), lambda left, s: cut(left, s).cast("array<struct<x:double,y:double>>"))


def clip_boxes(df: DataFrame, ring: str, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Adds `clipped` and `clipped_area`, and drops rows that leave nothing."""
    clipped = clip_to_box(F.col(ring), F.col(x0), F.col(y0), F.col(x1), F.col(y1))
    # One transform computes ring and area, so that the fold is evaluated once for each row.
    both = F.element_at(F.transform(F.array(clipped), lambda r: F.struct(r.alias("ring"), ring_area(r).alias("area"))), 1)
    return df.withColumn("_clip", both).filter("_clip.area > 0").withColumns({"clipped": F.col("_clip.ring"), "clipped_area": F.col("_clip.area")}).drop("_clip")


def buffer_bounds(geom: Column, distance: float) -> dict[str, Column]:
    b = bounds(geom)
    return {"x0": b["x0"] - distance, "y0": b["y0"] - distance, "x1": b["x1"] + distance, "y1": b["y1"] + distance}


def buffer_convex(geom: Column, distance: float, quarter: int = 16) -> Column:
    """Round buffer of a convex ring, line segment or point: hull of circles around its points."""
    if distance < 0:
        raise ValueError("distance must not be negative")

    def hull(points: list[tuple[float, float]]) -> list[dict]:
        points = sorted(set(points))
        if len(points) > 2:
            half = []
            for run in (points, points[::-1]):
                part: list = []
                for p in run:
                    while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                        part.pop()
                    part.append(p)
                half += part[:-1]
            points = half
        return [{"x": x, "y": y} for x, y in [*points, points[0]]]

    def run(geoms: pd.Series) -> pd.Series:
        turn = [math.tau * k / (4 * quarter) for k in range(4 * quarter)]
        return geoms.map(lambda g: None if g is None else hull([(p["x"] + distance * math.cos(t), p["y"] + distance * math.sin(t)) for p in g for t in (turn if distance else [0.0])]))

    # Not collapsed into later expressions, which may be lambdas.
    return F.pandas_udf(run, "array<struct<x:double,y:double>>").asNondeterministic()(geom)


def fishnet(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    """Square cells from the lower left of a rectangle, the last ones cut at its edge; row_idx, col_idx, box, area."""
    if size <= 0:
        raise ValueError("cell size must be positive")
    rows, cols = math.ceil((y1 - y0) / size - 1e-9), math.ceil((x1 - x0) / size - 1e-9)
    idx = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row_idx"), (F.col("id") % cols).cast("int").alias("col_idx"))
    box = idx.withColumns({"x0": F.lit(x0) + F.col("col_idx") * size, "y0": F.lit(y0) + F.col("row_idx") * size})
    box = box.withColumns({"x1": F.least(F.col("x0") + size, F.lit(float(x1))), "y1": F.least(F.col("y0") + size, F.lit(float(y1)))})
    return box.withColumns({"cell_id": F.col("row_idx") * cols + F.col("col_idx"), "area": (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))}).filter("area > 0")


def zonal_stats(zones: DataFrame, pixels: DataFrame, value: str, bucket: float, stats: tuple[str, ...] = ("count", "max", "mean", "min", "sum")) -> DataFrame:
    """Statistics of the pixels whose centres (x, y) lie in each zone (zone_id, ring); zones without any have count 0.

    An equi-join on the buckets that a zone's box covers, then the exact test: no pair of distant rows is ever formed.
    """
    unknown = set(stats) - {"count", "max", "mean", "min", "sum"}
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    b = bounds(F.col("ring"))
    cell = lambda c: F.floor(c / bucket).cast("long")
    wide = zones.select("zone_id", "ring", F.explode(F.sequence(cell(b["x0"]), cell(b["x1"]))).alias("bx"), cell(b["y0"]).alias("lo"), cell(b["y1"]).alias("hi")).select("zone_id", "ring", "bx", F.explode(F.sequence("lo", "hi")).alias("by"))
    met = wide.join(pixels.select("x", "y", F.col(value).cast("double").alias("v"), cell(F.col("x")).alias("bx"), cell(F.col("y")).alias("by")), ["bx", "by"]).filter(contains_point(F.col("ring"), F.col("x"), F.col("y")) & F.col("v").isNotNull())
    kinds = {"count": F.count("v"), "max": F.max("v"), "mean": F.round(F.avg("v"), 9), "min": F.min("v"), "sum": F.round(F.sum("v"), 9)}
    found = met.groupBy("zone_id").agg(*[kinds[s].alias(s) for s in sorted(stats)])
    out = zones.select("zone_id").join(found, "zone_id", "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0).cast("long"))) if "count" in stats else out


def pixel_of_point(x: Column, y: Column, x_min: float, y_max: float, size: float) -> dict[str, Column]:
    return {"row": F.floor((F.lit(y_max) - y) / size).cast("int"), "col": F.floor((x - F.lit(x_min)) / size).cast("int")}


def sample_raster(points: DataFrame, classes: DataFrame, x_min: float, y_max: float, size: float) -> DataFrame:
    """Class under each point; 0 where the raster has none."""
    at = points.withColumns(pixel_of_point(F.col("x"), F.col("y"), x_min, y_max, size))
    return at.join(classes.select("row", "col", "class_id"), ["row", "col"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def intersecting_pairs(left: DataFrame, right: DataFrame, bucket: float) -> DataFrame:
    """Pairs (left_id, right_id) of simple rings that intersect or touch, found by shared buckets, once each."""
    cell = lambda c: F.floor(c / bucket).cast("long")

    def wide(df: DataFrame, side: str) -> DataFrame:
        b = bounds(F.col("ring"))
        d = df.select(F.col("id").alias(f"{side}_id"), F.col("ring").alias(f"{side}_ring"), *[b[k].alias(f"{side}_{k}") for k in b])
        # One bucket more to the left and below, so that touching boxes meet.
        return d.withColumn("bx", F.explode(F.sequence(cell(F.col(f"{side}_x0")) - int(side == "left"), cell(F.col(f"{side}_x1"))))).withColumn("by", F.explode(F.sequence(cell(F.col(f"{side}_y0")) - int(side == "left"), cell(F.col(f"{side}_y1")))))

    c = {s: {k: F.col(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")} for s in ("left", "right")}
    return wide(left, "left").join(wide(right, "right"), ["bx", "by"]).filter(boxes_intersect(c["left"], c["right"])).drop("bx", "by").dropDuplicates(["left_id", "right_id"]).filter(rings_intersect(F.col("left_ring"), F.col("right_ring")))


def overlay(left: DataFrame, right_boxes: DataFrame, bucket: float, how: str = "intersection") -> DataFrame:
    """Pieces of convex rings cut by boxes that don't overlap each other: both ids and the piece's area.

    `intersection` has the common pieces, `difference` what each left ring has outside all boxes (right_id null),
    `identity` both; empty pieces are left out.
    """
    if how not in ("intersection", "difference", "identity"):
        raise ValueError(f"unknown overlay: {how}")
    pairs = intersecting_pairs(left, right_boxes, bucket)
    common = clip_boxes(pairs, "left_ring", "right_x0", "right_y0", "right_x1", "right_y1").select("left_id", "right_id", F.col("clipped_area").alias("area"))
    if how == "intersection":
        return common
    inside = common.groupBy("left_id").agg(F.sum("area").alias("inside"))
    rest = left.select(F.col("id").alias("left_id"), ring_area(F.col("ring")).alias("whole")).join(inside, "left_id", "left")
    outside = rest.withColumn("area", F.col("whole") - F.coalesce("inside", F.lit(0.0))).filter(F.col("area") > F.col("whole") * 1e-9)
    rest = outside.select("left_id", F.lit(None).cast(common.schema["right_id"].dataType).alias("right_id"), "area")
    return rest if how == "difference" else common.unionByName(rest)
