"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products are nearest points after one more coordinate makes all norms equal. Each of several tables cuts
random projections of a vector into cells; a query visits its own bucket and perturbed ones in the order of their
estimated success, candidates of all tables are merged and ranked by the exact measure on the original vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundshift.llm import common

#: Bytes of vectors that one group of buckets may hold in a task.
SHARD_BYTES = 24 << 20
MOST_PROBES = 2048


def probe_order(k: int, most: int) -> np.ndarray:
    """Perturbation sets over the 2k boundaries ranked by distance, as a 0/1 matrix, best expected score first.

    Expected squared distances of ranked boundaries (Lv et al., VLDB 2007) make the order the same for all queries.
    """
    j = np.arange(1, 2 * k + 1)
    back = 2 * k + 1 - j
    z = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - back / (k + 1) + back * (back + 1) / (4 * (k + 1) * (k + 2)))
    rows, queue = [np.zeros(2 * k, np.int64)], [(z[0], (0,))]
    while queue and len(rows) < most:
        score, chosen = heapq.heappop(queue)
        if not any(2 * k - 1 - c in chosen for c in chosen):  # both sides of one coordinate exclude each other
            row = np.zeros(2 * k, np.int64)
            row[list(chosen)] = 1
            rows.append(row)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(queue, (score - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(queue, (score + z[last + 1], (*chosen, last + 1)))
    return np.array(rows)


@dataclass
class Family:
    """Hash functions of all tables, made from a seed."""

    dim: int
    norm: float
    width: float
    tables: int
    k: int
    unit: float = 1.0
    seed: int = 7
    axes: np.ndarray = field(init=False)
    shifts: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.axes = rng.normal(size=(self.tables, self.k, self.dim + 1))
        self.shifts = rng.uniform(0, 1, size=(self.tables, self.k))
        self.keys = rng.integers(1 << 62, size=self.k, dtype=np.int64) * 2 + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Points in units of the largest component of all, so that no square overflows."""
        x = x / self.unit
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def scaled(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        size = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return np.hstack([q / size * self.norm, np.zeros((len(q), 1))])

    def cells(self, points: np.ndarray, table: int) -> np.ndarray:
        return points @ self.axes[table].T / self.width + self.shifts[table]

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.floor(cells).astype(np.int64) * self.keys).sum(axis=1)

    def probes(self, cells: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Buckets to visit of each point, in the order given: its own one first."""
        low = cells - np.floor(cells)
        side = np.argsort(np.hstack([low, 1 - low]), axis=1, kind="stable")
        step = np.where(side < self.k, -1, 1) * self.keys[side % self.k]
        with np.errstate(over="ignore"):
            return self.bucket(cells)[:, None] + step @ order.T


def mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order whatever the block: equal vectors score equally."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (vectors * query).sum(axis=1)


def best(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k candidates of largest inner product, ties to the smaller id; repeated rows count once."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = vectors @ query
    whole = ids, vectors
    if len(rough) > 4 * k and np.isfinite(rough).all():
        cut = np.partition(rough, len(rough) - 2 * k)[len(rough) - 2 * k]
        near = rough >= cut - 1e-9 * max(1.0, abs(cut))
        ids, vectors = ids[near], vectors[near]
    scores = exact_scores(vectors, query)
    other = ids != query_id
    ids, scores = ids[other], scores[other]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    if len(ids) > 1:
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])])
        ids, scores = ids[fresh], scores[fresh]
    if len(ids) < k and len(whole[0]) > 4 * k:  # repeated rows filled the first cut
        rows = np.unique(np.column_stack([whole[0].astype(np.float64), whole[1]]), axis=0, return_index=True)[1]
        if len(rows) < len(whole[0]):
            return best(whole[0][rows], whole[1][rows], query_id, query, k)
    return ids[:k], scores[:k]


FOUND = pa.list_(pa.struct([("less", pa.float64()), ("vec_id", pa.int64())]))
FOUND_DDL = "query_id long, found array<struct<less:double,vec_id:long>>"


def matrix(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str, int, int, float, float, float]:
    """Rows that take part (vec_id, vec array), the element kind, dimension, number, largest component and, in units of it, largest and root mean square norm.

    Vectors that are null, zero, of another length than most, or hold null, NaN or infinite components are left out.
    """
    kind = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    element = "float" if kind == "<f4" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{element}>").alias("vec")).filter("vec_id is not null and vec is not null")
    rows = rows.filter("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    top = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("array_max(transform(vec, x -> abs(double(x))))")).alias("unit")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not top:
        return rows.select("vec_id", "vec"), kind, 0, 0, 1.0, 0.0, 0.0
    dim, n, unit = top[0]
    rows = rows.filter(F.size("vec") == dim)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x.cast("double") / F.lit(unit)) * (x.cast("double") / F.lit(unit)))
    most, mean = rows.agg(F.max(square), F.avg(square)).first()
    return rows.select("vec_id", "vec"), kind, dim, n, unit, math.sqrt(most), math.sqrt(mean)


def as_matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], dim: int, k: int) -> DataFrame:
    """Exact neighbours, with their vectors, of a bounded list of queries over all rows, a top k for each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), as_matrix(batch.column(1), dim)
            for q, v in queries:
                a, b = kept.get(q, (ids[:0], x[:0]))
                a, b = np.concatenate([a, ids]), np.concatenate([b, x])
                chosen, _ = best(a, b, q, v, k)
                at = np.unique(a, return_index=True)
                rows_at = at[1][np.searchsorted(at[0], chosen)]
                kept[q] = a[rows_at], b[rows_at]
        for q, v in queries:
            if q in kept:
                a, b = kept[q]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(a), pa.int64()), pa.array(-exact_scores(b, v)), pa.array(a), pa.array(list(b), pa.list_(pa.float64()))], names=["query_id", "less", "vec_id", "vec"])

    found = rows.mapInArrow(run, "query_id long, less double, vec_id long, vec array<double>")
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("less", "vec_id", "vec"))), 1, k).alias("found"))


def calibrate(rows: DataFrame, dim: int, n: int, unit: float, norm: float, spread: float, k: int, tables: int, target: float, sample: int) -> tuple[Family, np.ndarray | None]:
    """The hash family and the probe sequence whose recall on a bounded sample of queries, by brute force, meets the target.

    No sequence if none meets it: then every group must be searched, which is exact.
    """
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    queries = [(r.vec_id, np.asarray(r.vec, np.float64)) for r in picked]
    truth = {r.query_id: np.array([f.vec for f in r.found]).reshape(-1, dim) for r in brute_force(rows, queries, dim, k).collect()}
    cuts = max(1, round(0.6 * math.log2(max(2, n))))
    while True:
        family, order = Family(dim, norm, 2 * spread, tables, cuts, unit), probe_order(cuts, MOST_PROBES)
        first = np.full(sum(len(t) for t in truth.values()), len(order))
        for table in range(tables):
            at = 0
            for q, v in queries:
                near = truth.get(q, np.zeros((0, dim)))
                if len(near):
                    visited = family.probes(family.cells(family.scaled(v[None]), table), order)[0]
                    hit = family.bucket(family.cells(family.lifted(near), table))[:, None] == visited[None]
                    first[at : at + len(near)] = np.minimum(first[at : at + len(near)], np.where(hit.any(axis=1), hit.argmax(axis=1), len(order)))
                at += len(near)
        probes = 8
        while probes < len(order) and len(first) and (first < probes).mean() < target:
            probes *= 2
        if not len(first) or (first < min(probes, len(order))).mean() >= target:
            return family, order[:probes]
        if cuts == 1:
            return family, None
        cuts -= 1


def nearest(df: DataFrame, k: int = 20, every: int = 20, tables: int = 8, target: float = 0.97, sample: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows found, by largest inner product, of each row whose id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id and score (the exact inner product in double precision), ties to the smaller
    vec_id. Null, zero, odd-length or non-finite vectors and rows without an id take no part; repeated rows count
    once; an empty table gives an empty result; other columns don't matter.

    Every row is indexed once in each table and shuffled by groups of buckets that fit in memory; a bucket larger than
    a group is dealt over several, whose number follows its count (fewer than 10,000 such buckets by definition). Each
    task keeps only a query's best k of a group. The number of probes is set on `sample` queries against brute force
    over all rows to a recall of `target`; where none reaches it, and for queries that found fewer than k rows, all groups
    are searched. Products that overflow score infinitely, ties among them to the smaller vec_id.
    """
    spark = df.sparkSession
    rows, kind, dim, n, unit, norm, spread = vectors_of(df, id_col, vec_col)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = common.materialize(rows, "vectors")
    family, order = calibrate(rows, dim, n, unit, norm, spread, k, tables, target, sample)
    per_shard = max(1024, SHARD_BYTES // (8 * dim))
    shards = -(-n // per_shard)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = family.lifted(as_matrix(batch.column(1), dim))
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(family.bucket(family.cells(x, t)))], names=["table", "bucket"])

    hot: dict[tuple[int, int], int] = {}
    if shards > 1:
        limit = max(per_shard // 4, n * tables // common.HOT_SHARE)
        counted = rows.mapInArrow(buckets, "table int, bucket long").groupBy("table", "bucket").count().filter(F.col("count") > limit)
        hot = {(r.table, r.bucket): -(-r["count"] // limit) for r in counted.collect()}

    def shard(key: int, part: int = 0) -> int:
        return int(mixed(np.array([key + part * 0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF if part else key], np.int64))[0] % np.uint64(shards))

    schema = pa.schema([("table", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("vec_id", pa.int64()), ("vec", pa.binary()), ("keys", pa.binary())])

    def dealt(everything: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows_of(out: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    ids, x, asks = batch.column(0).to_pylist(), as_matrix(batch.column(1), dim), batch.column(2).to_pylist()
                    raw = [v.tobytes() for v in x.astype(kind)]
                    points = family.lifted(x)
                    for t in range(1 if everything else tables):
                        keys = family.bucket(family.cells(points, t))
                        places = mixed(keys) % np.uint64(shards)
                        out = []
                        for i, key in enumerate(keys.tolist()):
                            parts = hot.get((t, key))
                            out.append((t, shard(key, ids[i] % parts) if parts else int(places[i]), 0, ids[i], raw[i], keys[i].tobytes()))
                        yield rows_of(out)
                        ask = [i for i, a in enumerate(asks) if a]
                        if everything:
                            out = [(0, s, 1, ids[i], raw[i], b"") for i in ask for s in range(shards)]
                            for a in range(0, len(out), 4096):
                                yield rows_of(out[a : a + 4096])
                        elif ask:
                            visits = family.probes(family.cells(family.scaled(x[ask]), t), order)
                            where = mixed(visits) % np.uint64(shards)
                            for i, v, w in zip(ask, visits, where, strict=True):
                                to: dict[int, list[int]] = {}
                                for s in np.unique(w).tolist():
                                    to[s] = v[w == s].tolist()
                                for key in v.tolist() if hot else ():
                                    for part in range(1, hot.get((t, key), 1)):
                                        to.setdefault(shard(key, part), []).append(key)
                                yield rows_of([(t, s, 1, ids[i], raw[i], np.array(keys, np.int64).tobytes()) for s, keys in to.items()])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, raw, keys, index = None, [], [], [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                queries, found = [], []
                for table, part, sort, vec_id, vec, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (table, part) != group:
                        group, ids, raw, keys, index = (table, part), [], [], [], None
                    if sort == 0:
                        ids.append(vec_id)
                        raw.append(vec)
                        keys.append(key)
                        continue
                    if not ids:
                        continue
                    if index is None:
                        codes = np.frombuffer(b"".join(keys), np.int64)
                        by = np.argsort(codes, kind="stable")
                        codes, own = codes[by], np.asarray(ids, np.int64)[by]
                        x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)[by]
                        index, raw = True, []
                    query = np.frombuffer(vec, kind).astype(np.float64)
                    if key:
                        visit = np.unique(np.frombuffer(key, np.int64))
                        starts, ends = np.searchsorted(codes, visit), np.searchsorted(codes, visit, side="right")
                        full = ends > starts
                        if not full.any():
                            continue
                        rows_at = np.concatenate([np.arange(s, e) for s, e in zip(starts[full], ends[full], strict=True)])
                        near, scores = best(own[rows_at], x[rows_at], vec_id, query, k)
                    else:
                        near, scores = best(own, x, vec_id, query, k)
                    queries.append(vec_id)
                    found.append([{"less": -s, "vec_id": v} for v, s in zip(near.tolist(), scores.tolist(), strict=True)])
                if queries:
                    yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(found, FOUND)], names=["query_id", "found"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(asked: DataFrame, everything: bool) -> DataFrame:
        wide = asked.mapInArrow(dealt(everything), "table int, shard int, kind int, vec_id long, vec binary, keys binary")
        merged = wide.repartition(min(parts, max(1, tables * shards)), "table", "shard").sortWithinPartitions("table", "shard", "kind").mapInArrow(search, FOUND_DDL)
        return merged.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("found"))

    found = common.materialize(searched(rows.withColumn("ask", F.col("vec_id") % every == 0), order is None), "found")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id").distinct()
    short = asked.join(found.filter(F.size("found") >= min(k, n - 1)), F.col("vec_id") == F.col("query_id"), "left_anti")
    if short.count():
        again = rows.join(short.withColumnRenamed("vec_id", "short_id"), F.col("vec_id") == F.col("short_id"), "left").select("vec_id", "vec", F.col("short_id").isNotNull().alias("ask"))
        found = found.join(short, F.col("query_id") == F.col("vec_id"), "left_anti").unionByName(searched(again, True))
    else:
        common.drop(rows)
    return found.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "f.vec_id", (-F.col("f.less") + F.lit(0.0)).alias("score"))
