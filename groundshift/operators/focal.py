"""Neighbourhood operators on pixel tables: majority filter, sieve, gradients and regridding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(radius: int, diagonal: bool = True, centre: bool = True) -> Column:
    cells = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if (diagonal or r * c == 0) and (centre or r or c)]
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in cells])


def majority_filter(classes: DataFrame, window: int = 3, nodata: int = 0) -> DataFrame:
    """Most frequent class around each pixel; ties keep the centre if it is among them, else the smallest id.

    Pixels without data stay so and don't vote. A pixel sends its class to the pixels around it, and one group-by
    counts what arrives: partial sums before the exchange, no join.
    """
    votes = classes.filter(F.col("class_id") != nodata).select("row", "col", "class_id", F.explode(_offsets(window // 2)).alias("o"))
    votes = votes.select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.col("class_id").alias("vote"), F.when((F.col("o.dr") == 0) & (F.col("o.dc") == 0), F.col("class_id")).alias("own"))
    frame = classes.select("row", "col", F.lit(None).cast("int").alias("vote"), F.col("class_id").alias("own"))
    tally = frame.unionByName(votes).groupBy("row", "col", "vote").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    best = tally.groupBy("row", "col").agg(F.max("own").alias("centre"), F.max("n").alias("_"), F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("n", "vote"))).alias("votes"))
    # At most as many entries as there are classes.
    most = F.expr(f"case when centre is null then null when centre = {nodata} then {nodata} else (aggregate(votes, named_struct('n', 0L, 'v', 0), (a, x) -> case when x.n > a.n or (x.n = a.n and (x.vote = centre or (a.v <> centre and x.vote < a.v))) then named_struct('n', x.n, 'v', x.vote) else a end)).v end")
    return best.withColumn("class_id", most).filter("class_id is not null").select("row", "col", "class_id")


def component_labels(classes: DataFrame, connectivity: int = 4, tile: int = 256) -> DataFrame:
    """row, col, class_id, label: the smallest pixel number of each connected patch of one class.

    Patches are labelled inside tiles in one pass; the pairs of labels that meet across tile edges are few, and their
    components come from rounds of smallest-neighbour joins on that small table, until no label moves. Each round also
    takes a root's own root, so that labels cross long patches in doubling steps.
    """
    width = 1 << 31
    full = connectivity == 8

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): i for i, (r, c) in enumerate(zip(pdf["row"], pdf["col"], strict=True))}
        cls = pdf["class_id"].to_numpy()
        number = pdf["row"].to_numpy().astype("int64") * width + pdf["col"].to_numpy()
        root = list(range(len(pdf)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for (r, c), i in at.items():
            for n in ((r, c + 1), (r + 1, c), *(((r + 1, c + 1), (r + 1, c - 1)) if full else ())):
                j = at.get(n)
                if j is not None and cls[i] == cls[j]:
                    a, b = find(i), find(j)
                    if a != b:
                        if number[a] > number[b]:
                            a, b = b, a
                        root[b] = a
        return pdf.assign(label=[int(number[find(i)]) for i in range(len(pdf))])[["row", "col", "class_id", "label"]]

    tiles = classes.select("row", "col", "class_id")
    labelled = tiles.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).applyInPandas(label, "row int, col int, class_id int, label long")
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    rim = labelled.filter(edge("row") | edge("col"))
    near = rim.select("class_id", "label", F.explode(_offsets(1, full, False)).alias("o"), "row", "col").select("class_id", F.col("label").alias("a"), (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    links = near.join(rim.select("class_id", "row", "col", F.col("label").alias("b")), ["class_id", "row", "col"]).filter("a <> b").select("a", "b").distinct()
    if not links.take(1):
        return labelled
    # The rim of tiles only; written out each round where a shared folder is set.
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    roots = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    spark = classes.sparkSession
    durable = spark.sparkContext.getCheckpointDir() is not None
    while True:
        lower = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        lowered = roots.join(lower, F.col("node") == F.col("a")).select("node", F.least("root", "low").alias("low"), "root")
        above = roots.select(F.col("node").alias("k"), F.col("root").alias("next"))
        after = lowered.join(above, F.col("low") == F.col("k")).select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
        after = after.checkpoint() if durable else after.cache()
        moved = after.filter("moved").limit(1).count()
        roots = after.drop("moved")
        if not moved:
            break
    return labelled.join(roots, F.col("label") == F.col("node"), "left").select("row", "col", "class_id", F.coalesce("root", "label").alias("label"))


def remove_small_patches(classes: DataFrame, least_ha: float, pixel_m: float = 10.0, nodata: int = 0, connectivity: int = 4) -> DataFrame:
    """Patches with fewer pixels than `least_ha` needs, rounded up, become nodata."""
    import math

    least = math.ceil(least_ha * 10_000 / (pixel_m * pixel_m))
    labelled = component_labels(classes.filter(F.col("class_id") != nodata), connectivity)
    sizes = labelled.groupBy("class_id", "label").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    kept = labelled.join(sizes, ["class_id", "label"]).select("row", "col", F.col("class_id").alias("kept"))
    return classes.join(kept, ["row", "col"], "left").select("row", "col", F.coalesce("kept", F.lit(nodata)).alias("class_id"))


def postprocess(classes: DataFrame, window: int, least_ha: float, pixel_m: float = 10.0, nodata: int = 0) -> DataFrame:
    return remove_small_patches(majority_filter(classes, window, nodata), least_ha, pixel_m, nodata)


def gradients(dem: DataFrame, step_m: float = 30.0) -> DataFrame:
    """dz_dx along columns and dz_dy along rows: central differences inside, one-sided at the ends of a line.

    A missing or null neighbour inside makes the difference null; a line of one pixel has none.
    """
    z = F.col("elevation")

    def slope(line: str, place: str) -> Column:
        w = Window.partitionBy(line).orderBy(place)
        first, last = F.lag(place).over(w).isNull(), F.lead(place).over(w).isNull()
        before = F.when(F.lag(place).over(w) == F.col(place) - 1, F.lag(z).over(w))
        after = F.when(F.lead(place).over(w) == F.col(place) + 1, F.lead(z).over(w))
        return F.when(first, (after - z) / step_m).when(last, (z - before) / step_m).otherwise((after - before) / (2 * step_m))

    return dem.withColumns({"dz_dx": slope("row", "col"), "dz_dy": slope("col", "row")})


def slope_aspect(dem: DataFrame, step_m: float = 30.0) -> DataFrame:
    g = gradients(dem, step_m)
    x, y = F.col("dz_dx"), F.col("dz_dy")
    return g.withColumns({"slope": F.degrees(F.atan(F.sqrt(x * x + y * y))), "aspect": F.pmod(F.degrees(F.atan2(-x, y)), F.lit(360.0))})


def aspect_encoding(df: DataFrame) -> DataFrame:
    return df.withColumns({"aspect_sin": F.sin(F.radians("aspect")), "aspect_cos": F.cos(F.radians("aspect"))})


def regrid_nearest(source: DataFrame, target: DataFrame, value: str, row_scale: float, col_scale: float) -> DataFrame:
    """Value of the source pixel that holds each target pixel's centre; null outside."""
    at = target.select("row", "col", F.floor((F.col("row") + 0.5) * row_scale).cast("int").alias("sr"), F.floor((F.col("col") + 0.5) * col_scale).cast("int").alias("sc"))
    return at.join(source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), value), ["sr", "sc"], "left").select("row", "col", value)


def regrid_bilinear(source: DataFrame, target: DataFrame, value: str, row_scale: float, col_scale: float) -> DataFrame:
    """Mean of the four source pixels around each target centre by distance, over those that are known."""
    y, x = (F.col("row") + 0.5) * row_scale - 0.5, (F.col("col") + 0.5) * col_scale - 0.5
    at = target.select("row", "col", y.alias("y"), x.alias("x"), F.floor(y).cast("int").alias("y0"), F.floor(x).cast("int").alias("x0"))
    fy, fx = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    corners = F.array(*[F.struct((F.col("y0") + dy).alias("sr"), (F.col("x0") + dx).alias("sc"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    wide = at.select("row", "col", F.explode(corners).alias("k")).select("row", "col", "k.sr", "k.sc", "k.w")
    met = wide.join(source.filter(F.col(value).isNotNull()).select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).cast("double").alias("v")), ["sr", "sc"], "left")
    weight = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return met.groupBy("row", "col").agg(F.round(F.try_divide(F.sum(F.col("w") * F.col("v")), weight), 9).alias(value))
