"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first deals the shingles over a ring, the second is read at
positions shifted around that ring, one shift for each coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.llm import common

WORDS = 5
BANDS, ROWS = 20, 4
U64 = np.uint64
#: Odd multipliers of a shingle's words; sums of products of 64-bit word hashes.
WEIGHTS = np.array([(xxhash.xxh64_intdigest(b"word %d" % i) | 1) for i in range(WORDS)], U64)
RING = np.uint32(0x9E3779B1)
#: Shingles in one in-memory group; larger groups of candidates are dealt out as pairs of blocks.
GROUP_SHINGLES = 1_500_000


class WordHashes(dict):
    """64-bit hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 100_000:
            self[word] = value
        return value


HASHES = WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of text with A-Z lower-cased; the whole sequence if shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    hashes = np.fromiter(map(HASHES.__getitem__, words), U64, n)
    if n < WORDS:
        total = np.array([n], U64)
        for i in range(n):
            total = total + hashes[i : i + 1] * WEIGHTS[i]
    else:
        total = np.zeros(n - WORDS + 1, U64)
        for i in range(WORDS):
            total += hashes[i : n - WORDS + 1 + i] * WEIGHTS[i]
    total ^= total >> U64(29)
    total *= U64(0xBF58476D1CE4E5B9)
    return np.unique(total)


def permuted(ring: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit ring, in place."""
    ring ^= ring >> np.uint32(16)
    ring *= np.uint32(0x7FEB352D)
    ring ^= ring >> np.uint32(15)
    ring *= np.uint32(0x846CA68B)
    ring ^= ring >> np.uint32(16)
    return ring


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least value of the second permutation, shifted k steps around the ring."""
    # The top half of the shingle hash is its place on the ring: the first permutation.
    places = (hashes >> U64(32)).astype(np.uint32)
    shifts = (np.arange(coordinates, dtype=np.uint32) * RING)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 256):
        np.minimum(out, permuted(places[None, at : at + 256] + shifts).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = sig.reshape(bands, rows).astype(U64)
    key = np.arange(1, bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
    for r in range(rows):
        key = (key ^ parts[:, r]) * U64(0x9E3779B97F4A7C15)
        key ^= key >> U64(31)
    return key.astype(np.int64)


def linked_pairs(sets: list[np.ndarray], percent: int, blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as (smaller index, index) edges, of the exact links 100 * |A & B| >= percent * |A | B|.

    Exact prefix filtering: two linked sets share one of the rarest shingles of each. With `blocks` (0 or 1 for each
    set), only links between different blocks count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    ids = ids.ravel()
    ends = np.cumsum(sizes)
    tokens = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    posts: dict[int, list[int]] = {}
    mark = np.zeros(len(df), bool)
    edges = []
    for x in order:
        own, n = tokens[x], int(sizes[x])
        if not n:
            continue
        keep = n - -(-percent * n // 100) + 1
        prefix = own[np.argsort(df[own], kind="stable")[:keep]]
        near: set[int] = set()
        for t in prefix.tolist():
            if df[t] > 1:
                post = posts.setdefault(t, [])
                near.update(post)
                post.append(int(x))
        near = [y for y in near if 100 * sizes[y] >= percent * n and (blocks is None or blocks[y] != blocks[x]) and find(y) != find(x)]
        if near:
            mark[own] = True
            for at in range(0, len(near), 512):
                part = near[at : at + 512]
                lengths = sizes[part]
                shared = np.add.reduceat(mark[np.concatenate([tokens[y] for y in part])].astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                for y in np.asarray(part)[100 * shared >= percent * (lengths + n - shared)]:
                    a, b = find(int(y)), find(int(x))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        edges.append((int(min(x, y)), int(max(x, y))))
            mark[own] = False
    return edges


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of (u, v) links: node and the smallest node that it reaches, for all nodes with a link.

    Alternates large-star and small-star steps on the link table (each a group-by and a join, both on nodes), written
    to the shared folder after every step, until nothing changes. Nothing but a change count reaches the driver.
    """
    now = common.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{tag}-links")
    last, total = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
        # A node may have a third of all links: such ones are broadcast, fewer than 10,000 by definition.
        large = common.join_counted(both.filter("v > u"), least, "u", "n", 2 * total, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = common.materialize(small, f"{tag}-links")
        state = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        common.drop(now)
        now, total = after, state[0]
        if state == last:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._groundshift_path = now._groundshift_path
            return out
        last = state


SKETCH = "doc_id long, n_shingles long, set_digest string, bands array<long>"


def sketch(df: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (null for the empty set) and the band keys of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, digests, keys = [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingles(text)
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else None)
                    keys.append(band_keys(signature(hashes, bands * rows), bands, rows) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_digest", "bands"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCH)


def _verified(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (u, v) between members (group, side, doc_id, set_digest, text), whose texts are compared as full sets.

    Rows come sorted by group, so a task holds one group at a time: at most GROUP_SHINGLES, or two blocks of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, sides, seen = None, [], [], [], set()

        def links() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                found = linked_pairs(sets, percent, np.array(sides) if None not in sides else None)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for g, side, doc, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    yield from links()
                    group, ids, sets, sides, seen = g, [], [], [], set()
                if (doc, digest) in seen:
                    continue
                hashes = shingles(text)
                if xxhash.xxh3_128_hexdigest(hashes.tobytes()) == digest:
                    seen.add((doc, digest))
                    ids.append(doc)
                    sets.append(hashes)
                    sides.append(side)
        yield from links()

    dealt = members.select("group", "side", "doc_id", "set_digest", "text").repartition(parts, "group").sortWithinPartitions("group", "doc_id")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by 100 * |A & B| >= percent * |A | B| on their 5-word shingle sets.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable, itself included) and kept (doc_id is the
    smallest). A null text, or one without words, has an empty set and is linked with nothing. A row without doc_id can
    name no class: component_id is null, kept is true. Repeated rows give a row each, in one class. An empty table
    gives an empty one; other columns don't matter.

    At a similarity of 0.85, 20 bands of 4 rows miss a pair with probability 4e-7. Equal sets are one class from a
    group-by, so copies never meet in a join. Candidate classes are components of a star in each band's bucket (one
    row for each entry, never pairs). Within a candidate class, links are found on full sets by exact prefix filtering,
    one class in memory at a time; a class of more than GROUP_SHINGLES is compared as pairs of blocks.
    """
    spark = df.sparkSession
    docs = common.materialize(sketch(df, bands, rows, id_col, text_col), "sketch")
    named = docs.filter("doc_id is not null and set_digest is not null")
    # Rows of one set have equal bands, so any row's will do.
    grouped = named.groupBy("set_digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    sets = common.materialize(grouped, "sets")
    total = sets.agg(F.sum("copies")).first()[0] or 0
    entries = sets.select("rep", F.posexplode("bands").alias("band", "key"))
    hubs = entries.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top").drop("top")
    stars = entries.join(hubs, ["band", "key"]).filter("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    classes = components(stars, "candidates")
    with_hub = classes.unionByName(classes.select(F.col("root").alias("node"), "root")).distinct()
    members = common.materialize(with_hub.join(sets, F.col("rep") == F.col("node")).select("node", "root", "set_digest", "n_shingles"), "members")

    # Candidate classes too large for one task become pairs of blocks.
    weights = members.groupBy("root").agg(F.sum("n_shingles").alias("weight"))
    large = weights.filter(F.col("weight") > GROUP_SHINGLES).select("root", F.ceil(F.col("weight") / GROUP_SHINGLES).cast("int").alias("blocks"))
    dealt = members.join(large, "root", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("set_digest"), F.col("blocks")).cast("int")))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.expr("sequence(0, blocks - 1)"))
    dealt = dealt.withColumn("other", F.explode(others))
    group = F.when(F.col("block").isNull(), F.concat_ws("-", "root")).otherwise(F.concat_ws("-", "root", F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("block").isNull() | (F.col("block") == F.col("other")), F.lit(None).cast("int")).otherwise((F.col("block") > F.col("other")).cast("int"))
    dealt = dealt.select(group.alias("group"), side.alias("side"), F.col("node"), "set_digest")
    dealt = common.materialize(dealt, "dealt")
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The comparison makes Spark build its runtime Bloom filter of the members, so that only their texts are shuffled.
    with common.settings(spark, {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB"}):
        found = components(_verified(dealt.filter(F.col("node") >= F.lit(-(2**63))).join(texts, F.col("node") == F.col("doc_id")), percent, parts), "verified")

    roots = sets.join(found, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "rep"))
    shared = roots.filter("copies > 1 or component_id <> rep").select("set_digest", "copies", "component_id")
    shared = common.materialize(shared, "shared")
    common.drop(sets, classes, members, dealt, found)
    out = common.join_counted(docs.select("doc_id", "n_shingles", "set_digest"), shared, "set_digest", "copies", total, "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
