"""The engine's workflows: epoch composites, change and association runs, terrain features, raster clips."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.operators import assoc, change, focal, raster, vector
from groundshift.sources.manifest import RunManifest


def load_stack(observations: DataFrame, bands: Iterable[str], rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Observations of a window with the wanted bands under their canonical names; both reach the scan as pruning."""
    df = observations.withColumnsRenamed(names or {})
    for column, limits in (("row", rows), ("col", cols)):
        if limits:
            df = df.filter(F.col(column).between(*limits))
    return df.select("scene_id", "ts", "epoch", "row", "col", "scl", *bands)


def epoch_composite(observations: DataFrame, epoch: str, months: Iterable[int] | None = None, month_balanced: bool = False, least_valid: float = 0.7, manifest: RunManifest | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(composite, valid fractions, coverage verdict) of an epoch: month filter, mask, median or month-balanced median."""
    months = list(months or [])
    if month_balanced and not months:
        raise ValueError("month-balanced compositing needs months that both epochs have")
    px = observations.filter(F.col("epoch") == epoch)
    if month_balanced:
        px = px.filter(F.month("ts").isin(months))
    masked = raster.mask_stack(px)
    fractions = raster.valid_fraction(masked)
    out = (raster.month_balanced_composite if month_balanced else raster.median_composite)(masked)
    verdict = raster.coverage(fractions, least_valid)
    if manifest:
        manifest.start_timer(f"composite_{epoch}")
        row = verdict.first()
        if row is None:
            raise RuntimeError(f"no scenes found for epoch {epoch}")
        manifest.stop_timer(f"composite_{epoch}")
        manifest.add_stats(epoch, mean_valid=row.mean_frac, min_valid=row.min_frac)
    return out, fractions, verdict


def smoke_test(observations: DataFrame, scenes: int = 3, band: str = "b04", side: int = 10) -> DataFrame:
    """Median of one band of the first scenes by time over a small window."""
    first = observations.select("ts", "scene_id").distinct().orderBy("ts", "scene_id").limit(scenes).select("scene_id")
    px = load_stack(observations, raster.BANDS, (0, side - 1), (0, side - 1)).join(F.broadcast(first), "scene_id", "left_semi")
    return raster.median_composite(raster.mask_stack(px)).select("epoch", "row", "col", band)


def change_run(first: DataFrame, second: DataFrame, window: int = 3, least_ha: float = 0.05, pixel_m: float = 10.0) -> dict[str, DataFrame]:
    """Cleaned class maps of two epochs (row, col, class_id) to matrix, class balances, masks and footprint."""
    a, b = (focal.postprocess(c, window, least_ha, pixel_m) for c in (first, second))
    pairs = a.withColumnRenamed("class_id", "c1").join(b.withColumnRenamed("class_id", "c2"), ["row", "col"])
    return {"pairs": pairs, "matrix": change.transition_matrix(pairs, pixel_m), "classes": change.class_stats(pairs, pixel_m), "masks": change.change_masks(pairs), "footprint": change.footprint(pairs, pixel_m)}


def association_run(masks: DataFrame, cell_px: int, per_row: int, pixel_area: float = 100.0, alpha: float = 0.05, top: int = 20, permutations: int = 999, seed: int = 42) -> dict[str, DataFrame]:
    """Masks to grid, rank correlation, Moran's I with permutations, local Gi* and hotspots."""
    grid = assoc.grid_aggregate(masks, cell_px, per_row, pixel_area)
    edges = assoc.queen_edges(grid)
    gi = assoc.gi_star(grid, edges, "loss_ha", alpha)
    return {"grid": grid, "spearman": assoc.spearman_p(assoc.spearman(grid, "gain_ha", "loss_ha")), "moran": assoc.morans_i(grid, edges, "loss_ha"), "moran_p": assoc.morans_permutation(grid, edges, "loss_ha", permutations, seed), "gi": gi, "hotspots": assoc.hotspots(gi, top)}


def terrain_features(dem: DataFrame, target: DataFrame, scale: float, step_m: float = 30.0) -> DataFrame:
    """Slope and encoded aspect on the native grid, then bilinear to the target: angles are averaged as vectors."""
    native = focal.aspect_encoding(focal.slope_aspect(dem, step_m))
    out = target.select("row", "col")
    for value in ("slope", "aspect_sin", "aspect_cos"):
        out = out.join(focal.regrid_bilinear(native, target, value, scale, scale), ["row", "col"])
    return out


def clip_raster(source: DataFrame, target: DataFrame, value: str, ring: DataFrame, scale: float, x_min: float, y_max: float, size: float, categorical: bool = False) -> DataFrame:
    """A raster on the target grid inside a boundary of one or more rings; nearest for classes, bilinear otherwise."""
    regrid = focal.regrid_nearest if categorical else focal.regrid_bilinear
    out = regrid(source, target, value, scale, scale).withColumns({"x": F.lit(x_min) + (F.col("col") + 0.5) * size, "y": F.lit(y_max) - (F.col("row") + 0.5) * size})
    # A boundary has few rings; they travel as one row.
    rings = ring.agg(F.collect_list("ring").alias("rings"))
    return out.join(F.broadcast(rings)).filter(F.exists("rings", lambda r: vector.contains_point(r, F.col("x"), F.col("y")))).select("row", "col", value)


def boundary(ways: DataFrame) -> DataFrame:
    """Outer rings of a boundary's ways: closed ways as they are, open ones chained where ends meet.

    A boundary has few ways; they are chained in one row.
    """
    def rings(parts: list) -> list:
        left, done = [[(p["x"], p["y"]) for p in g] for g in parts if len(g) > 1], []
        while left:
            ring = left.pop(0)
            while ring[0] != ring[-1]:
                for k, other in enumerate(left):
                    if other[0] == ring[-1] or other[-1] == ring[-1]:
                        ring += (other if other[0] == ring[-1] else other[::-1])[1:]
                        left.pop(k)
                        break
                else:
                    break
            if ring[0] == ring[-1] and len(ring) > 3:
                done.append([{"x": x, "y": y} for x, y in ring])
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for batch in batches:
            found = [r for lines in batch.column(0).to_pylist() for r in rings(lines)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, point)], names=["ring_id", "ring"])

    one = ways.agg(F.array_sort(F.collect_list(F.struct("osm_id", "geom"))).alias("w")).select(F.transform("w", lambda w: w["geom"]).alias("lines"))
    return one.mapInArrow(run, "ring_id int, ring array<struct<x:double,y:double>>")
