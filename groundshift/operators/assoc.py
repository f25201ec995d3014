"""Change on grids and its spatial association: queen neighbours, Moran's I, local Gi*, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundshift.functions import special


def grid_aggregate(masks: DataFrame, cell_px: int, per_row: int, pixel_area_m2: float = 100.0) -> DataFrame:
    """Hectares of gain and loss of each square cell: one integer-bucket group-by, no spatial join."""
    cell = lambda c: F.floor(F.col(c) / cell_px).cast("int")
    ha = lambda cond: F.sum(F.when(cond, 1).otherwise(0)) * F.lit(pixel_area_m2) / F.lit(10_000.0)
    out = masks.groupBy(cell("row").alias("row_idx"), cell("col").alias("col_idx")).agg(
        ha(F.col("urban") == 1).alias("gain_ha"), ha(F.col("veg_loss") == 1).alias("loss_ha"), ha((F.col("urban") == 1) & (F.col("veg_loss") == 1)).alias("overlap_ha"), F.avg(F.col("urban").isNotNull().cast("double")).alias("valid_frac")
    )
    return out.select((F.col("row_idx") * per_row + F.col("col_idx")).alias("cell_id"), "row_idx", "col_idx", "gain_ha", "loss_ha", "overlap_ha", "valid_frac")


def queen_edges(cells: DataFrame) -> DataFrame:
    """Ordered pairs of cells that share an edge or corner: eight shifted copies and one equi-join."""
    shifts = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    moved = cells.select(F.col("cell_id").alias("src"), F.explode(shifts).alias("s"), "row_idx", "col_idx").select("src", (F.col("row_idx") + F.col("s.dr")).alias("row_idx"), (F.col("col_idx") + F.col("s.dc")).alias("col_idx"))
    return moved.join(cells.select("row_idx", "col_idx", F.col("cell_id").alias("dst")), ["row_idx", "col_idx"]).select("src", "dst")


def polygon_queen_edges(rings: DataFrame, digits: int = 6) -> DataFrame:
    """Neighbours of irregular cells (cell_id, ring array<struct<x,y>>): those that share a vertex."""
    v = rings.select("cell_id", F.explode("ring").alias("p")).select("cell_id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    return v.select(F.col("cell_id").alias("src"), "x", "y").join(v.select(F.col("cell_id").alias("dst"), "x", "y"), ["x", "y"]).filter("src <> dst").select("src", "dst").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def _with_totals(cells: DataFrame, value: str) -> DataFrame:
    totals = cells.agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("s2"))
    return cells.join(F.broadcast(totals))  # one row of totals


def morans_i(cells: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """n / S0 * sum(z_i z_j) / sum(z^2); null without links or variance."""
    z = _with_totals(cells, value).select("cell_id", (F.col(value) - F.col("mean")).alias("z"))
    cross = edges.join(z.select(F.col("cell_id").alias("src"), F.col("z").alias("zi")), "src").join(z.select(F.col("cell_id").alias("dst"), F.col("z").alias("zj")), "dst").agg(F.sum(F.col("zi") * F.col("zj")).alias("cross"), F.count("*").alias("s0"))
    square = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("sq"))
    i = F.when((F.col("s0") > 0) & (F.col("sq") > 0), F.col("n") / F.col("s0") * F.col("cross") / F.col("sq"))
    return square.join(F.broadcast(cross)).select("n", "s0", F.round(i, 9).alias("morans_i"))


def morans_permutation(cells: DataFrame, edges: DataFrame, value: str, permutations: int = 999, seed: int = 42) -> DataFrame:
    """Observed I and its permutation p-value (1 + extreme) / (P + 1).

    Each replicate deals the values over the cells by the order of a hash of seed, replicate and cell. Replicates are
    partitions of one job; nothing loops on the driver.
    """
    z = _with_totals(cells, value).select("cell_id", (F.col(value) - F.col("mean")).alias("z"))
    places = numbered(z, "cell_id")
    reps = places.select("cell_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("k"))
    order = Window.partitionBy("k").orderBy(F.when(F.col("k") == 0, F.col("pos").cast("long")).otherwise(F.xxhash64(F.lit(seed), "k", "cell_id")), "pos")
    dealt = reps.withColumn("take", F.row_number().over(order)).join(places.select(F.col("pos").alias("take"), "z"), "take").select("k", "cell_id", "z")
    src, dst = dealt.select("k", F.col("cell_id").alias("src"), F.col("z").alias("zi")), dealt.select("k", F.col("cell_id").alias("dst"), F.col("z").alias("zj"))
    sums = src.join(edges, "src").join(dst, ["k", "dst"]).groupBy("k").agg(F.sum(F.col("zi") * F.col("zj")).alias("cross"), F.count("*").alias("s0"))
    scale = z.agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("sq"))
    values = sums.join(F.broadcast(scale)).select("k", (F.col("n") / F.col("s0") * F.try_divide(F.col("cross"), F.col("sq"))).alias("i"))
    observed = values.filter("k = 0").select(F.col("i").alias("observed"))
    # Differences of rounding must not decide ties.
    return values.filter("k > 0").join(F.broadcast(observed)).agg(F.max("observed").alias("morans_i"), F.count("*").alias("permutations"), ((F.count_if(F.abs("i") >= F.abs("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_sim"))


def gi_star(cells: DataFrame, edges: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """Local Gi* with the cell itself among its neighbours, its one-sided normal p-value and significance."""
    own = cells.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))
    near = edges.unionByName(own).join(cells.select(F.col("cell_id").alias("dst"), F.col(value).alias("x")), "dst").groupBy("src").agg(F.sum("x").alias("wx"), F.count("*").cast("double").alias("w"))
    out = _with_totals(cells, value).join(near, F.col("cell_id") == F.col("src"))
    variance = F.col("s2") * (F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1)
    z = F.when((F.col("n") > 1) & (variance > 0), (F.col("wx") - F.col("mean") * F.col("w")) / F.sqrt(variance))
    out = out.withColumn("z", z)
    # The decision compares z with the quantile, so it needs no special function.
    return out.select("cell_id", value, F.round("z", 9).alias("z"), F.coalesce((F.col("z") > 0) & (F.col("z") >= special.normal_quantile(1 - alpha)), F.lit(False)).alias("significant"))


def hotspots(gi: DataFrame, top: int = 20) -> DataFrame:
    """The strongest significant cells, ties to the later cell; a top-k, no full sort."""
    first = gi.filter("significant").orderBy(F.desc("z"), F.desc("cell_id")).limit(top)
    return first.withColumn("hot_rank", F.row_number().over(Window.orderBy(F.desc("z"), F.desc("cell_id"))))


def hotspot_rank(gi: DataFrame, top: int = 20) -> DataFrame:
    ranks = hotspots(gi, top).select("cell_id", "hot_rank")
    return gi.join(F.broadcast(ranks), "cell_id", "left").select("cell_id", "z", "hot_rank")


def bucketed(df: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """Adds `bucket`: the slice between approximate quantiles that a value falls in, the same for equal values.

    Windows over a bucket stay small where one over the whole table would put all rows in one task.
    """
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    cuts = df.agg(F.array_sort(F.array_distinct(F.percentile_approx(value, shares, F.lit(20 * buckets)))).alias("_cuts"))
    return df.join(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def _before(df: DataFrame, weight: Column) -> DataFrame:
    """bucket, before: the sum of weight in earlier buckets, of which there are few."""
    totals = df.groupBy("bucket").agg(F.sum(weight).alias("t"))
    return totals.select("bucket", F.coalesce(F.sum("t").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def ranked_values(df: DataFrame, value: str, name: str) -> DataFrame:
    """value and its average rank for each distinct value: ranks come from counts of distinct values, not from rows."""
    counts = bucketed(df.groupBy(value).agg(F.count("*").alias("ties")), value)
    within = F.coalesce(F.sum("ties").over(Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("within", within).join(F.broadcast(_before(counts, F.col("ties"))), "bucket")
    return placed.select(value, (F.col("before") + F.col("within") + (F.col("ties") + 1) / 2.0).alias(name))


def numbered(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Adds the 1-based place of each row in the order of a unique key, bucket by bucket."""
    cut = bucketed(df, key)
    placed = cut.withColumn("within", F.row_number().over(Window.partitionBy("bucket").orderBy(key))).join(F.broadcast(_before(cut, F.lit(1))), "bucket")
    return placed.withColumn(name, (F.col("before") + F.col("within")).cast("int")).drop("bucket", "within", "before")


def spearman(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; null for fewer than two rows or a constant side."""
    both = cells.select(a, b).join(ranked_values(cells, a, "ra"), a).join(ranked_values(cells, b, "rb"), b)
    s = both.agg(F.count("*").alias("n"), F.covar_pop("ra", "rb").alias("cov"), F.var_pop("ra").alias("va"), F.var_pop("rb").alias("vb"))
    rho = F.when((F.col("n") >= 2) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("cov") / F.sqrt(F.col("va") * F.col("vb")))
    return s.select("n", F.round(rho, 9).alias("rho"))


def spearman_p(rho_df: DataFrame) -> DataFrame:
    """Adds the two-sided p-value of Student's t."""
    return rho_df.withColumn("p_value", special.t_two_sided(F.col("rho"), F.col("n")))
