"""Analysis windows, centres and offset tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundshift.operators import scenes, vector


def parse_center(text: Column) -> Column:
    """struct<lon, lat> of `longitude,latitude`; null unless both are numbers in range."""
    parts = F.split(text, ",")
    lon, lat = (F.trim(F.try_element_at(parts, F.lit(i))).try_cast("double") for i in (1, 2))
    ok = (F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(ok, F.struct(lon.alias("lon"), lat.alias("lat")))


def target_grid(df: DataFrame, lon: str, lat: str, metres: float = 1000.0, pixel: float = 10.0) -> DataFrame:
    """Adds the bounds of a square window around a centre in UTM, and its number of pixels a side."""
    x, y = vector.utm_forward(F.col(lon), F.col(lat))
    half = metres / 2
    return df.withColumns({"_x": x, "_y": y}).withColumns({"x_min": F.col("_x") - half, "y_min": F.col("_y") - half, "x_max": F.col("_x") + half, "y_max": F.col("_y") + half, "pixels": F.lit(round(metres / pixel))}).drop("_x", "_y")


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of a closed ring by its moments about the first point."""
    origin = F.element_at(ring, 1)
    i = F.sequence(F.lit(1), F.size(ring) - 1)
    at = lambda k, c: F.element_at(ring, k)[c] - origin[c]
    cross = lambda k: at(k, "x") * at(k + 1, "y") - at(k + 1, "x") * at(k, "y")
    total = lambda f: F.aggregate(F.transform(i, f), F.lit(0.0), lambda a, v: a + v)
    area = total(cross)

    def along(c: str) -> Column:
        return F.try_divide(total(lambda k: (at(k, c) + at(k + 1, c)) * cross(k)), area * 3) + origin[c]

    return along("x"), along("y")


def centred_window(areas: DataFrame, km: float) -> DataFrame:
    """A square of km kilometres around each area's centroid; null where its corners leave the area (a convex ring)."""
    if not (math.isfinite(km) and km > 0):
        raise ValueError("window must be a positive finite number of kilometres")
    half = km * 500.0
    out = areas.withColumns(dict(zip(("cx", "cy"), ring_centroid(F.col("ring")), strict=True)))
    eps = 1e-9
    inside = F.lit(True)
    for dx in (-1, 1):
        for dy in (-1, 1):
            inside = inside & vector.contains_point(F.col("ring"), F.col("cx") + dx * (half - eps), F.col("cy") + dy * (half - eps))
    return out.withColumn("window", F.when(inside, vector.box_ring(F.col("cx") - half, F.col("cy") - half, F.col("cx") + half, F.col("cy") + half)))


def snapped_window(x: Column, y: Column, pixels: int, size: float = 10.0) -> tuple[Column, Column]:
    """Left and top of a window of pixels around a point, on the pixel grid: floor to the left, ceiling to the top."""
    half = pixels * size / 2
    return F.floor((x - half) / size) * size, F.ceil((y + half) / size) * size


def flag_text(flag: Column) -> Column:
    return F.when(flag, "true").when(~flag, "false").otherwise("absent")


def offset_maps(items: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """scene_id with maps of declared and effective offsets by band."""
    from groundshift.operators import raster

    day = F.date_format("datetime", "yyyy-MM-dd")
    declared = {b: F.coalesce(F.try_element_at(F.try_element_at("assets", F.lit(b))["raster:bands"], F.lit(1))["offset"], F.lit(0.0)) for b in bands}
    names = F.array(*[F.lit(b) for b in bands])
    effective = F.array(*[raster.reflectance_offset(d, F.col("baseline"), day, F.col("boa_present"), F.col("boa_flag")) for d in declared.values()])
    return items.select(F.col("id").alias("scene_id"), flag_text(F.col("boa_flag")).alias("flag"), F.map_from_arrays(names, F.array(*declared.values())).alias("declared"), F.map_from_arrays(names, effective).alias("effective"))


def epoch_records(items: DataFrame, edge: int) -> DataFrame:
    """Scenes with their epoch and tile (property, else id); an error names an epoch without any."""
    out = items.select(scenes.epoch_of(F.col("datetime"), edge).alias("epoch"), F.coalesce(F.col("mgrs"), F.col("id")).alias("tile"), "id").filter("epoch is not null")
    found = {r.epoch for r in out.select("epoch").distinct().collect()}
    for epoch in ("t1", "t2"):
        if epoch not in found:
            raise ValueError(f"no deduplicated items for {epoch}")
    return out


def window_reflectance(numbers: DataFrame, value: str, row0: int, col0: int, rows: int, cols: int, scale: float, offset: float, pad: int = 3) -> DataFrame:
    """number * scale + offset over a window, read with a margin for resampling; row and col count from the window."""
    near = numbers.filter(F.col("row").between(row0 - pad, row0 + rows - 1 + pad) & F.col("col").between(col0 - pad, col0 + cols - 1 + pad))
    return near.select((F.col("row") - row0).alias("row"), (F.col("col") - col0).alias("col"), (F.col(value).cast("double") * scale + offset).alias(value))
