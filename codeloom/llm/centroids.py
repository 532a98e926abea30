"""Centroid clustering by sort-means (operator 13).

Each round orders, for every centroid, the others by distance from it.  A
vector scans that order of the centroid it had before: one that is more than
twice as far from the old centroid as the vector is cannot be as near as the
old one, nor can any behind it, so the scan stops there, strictly beyond, as
ties go to the smaller number.

Vectors are integers, so that distances, sums and means are exact and do not
depend on any order.  They lie in blocks that carry the clusters of the last
round; a round reads and writes the blocks once and shuffles only sums, a row
for each task, cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024
#: Integers beyond this would take squared distances in 64 dimensions out of 64 bits.
LARGEST = 1 << 27
BLOCK = 4096
#: Distances are summed in two halves, of which neither overflows.
HALF = np.int64(1 << 31)

STATE = "ids binary, nameless binary, vectors binary, cluster binary, distance binary, sums binary"


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors with `dims` components, none null or non-finite, as floor(scale * x)."""
    e = F.col("embedding")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST)
    ok = vectors.where(e.isNotNull() & (F.size(e) == dims)).where(F.forall(e, fits))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each the others from near to far."""
    apart = np.array([squares(centroids, c) for c in centroids], np.int64).reshape(len(centroids), len(centroids))
    order = np.argsort(apart, axis=1, kind="stable")
    return apart, np.array([row[row != k] for k, row in enumerate(order)], np.int64).reshape(len(centroids), -1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, apart: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and squared distance of the vectors x, which were nearest to `before`."""
    cluster, reach = before.astype(np.int64), squares(x, centroids[before])
    best = reach.copy()
    for k in np.unique(before):
        rows = np.flatnonzero(before == k)
        for other in order[k]:
            rows = rows[(apart[k, other] + 3) // 4 <= reach[rows]]  # apart <= 4 * reach: not strictly beyond twice the distance
            if not len(rows):
                break
            d = squares(x[rows], centroids[other])
            closer = (d < best[rows]) | ((d == best[rows]) & (other < cluster[rows]))
            best[rows[closer]], cluster[rows[closer]] = d[closer], other
    return cluster, best


def totals(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the sums of all components, the number of vectors, and the distances in two halves."""
    wide = np.concatenate([x, np.ones((len(x), 1), np.int64), (distance // HALF)[:, None], (distance % HALF)[:, None]], axis=1)
    out = np.zeros((k, wide.shape[1]), np.int64)
    for c in np.unique(cluster):
        out[c] = wide[cluster == c].sum(0)
    return out


def blocks(kept: DataFrame, dims: int) -> DataFrame:
    """The vectors in blocks, all in cluster 0 as yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.iloc[i : i + BLOCK]
                x = np.array([np.asarray(v, np.int32) for v in part["v"]], "<i4").reshape(-1, dims)
                nothing = np.zeros(len(part), "<i8").tobytes()
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy().astype("<i8").tobytes()], "nameless": [part["nameless"].to_numpy().astype(np.uint8).tobytes()], "vectors": [x.tobytes()], "cluster": [np.zeros(len(part), "<i4").tobytes()], "distance": [nothing], "sums": [b""]})

    return kept.select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), F.col("vec_id").isNull().alias("nameless"), "v").mapInPandas(run, STATE)


def assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The blocks with the clusters that these centroids give, scanned from the ones before."""
    k, dims = centroids.shape
    apart, order = orders(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, nameless, vectors, cluster, _, _ in batch.itertuples(index=False):
                x = np.frombuffer(vectors, "<i4").reshape(-1, dims).astype(np.int64)
                cluster, distance = nearest(x, np.frombuffer(cluster, "<i4"), centroids, apart, order)
                yield pd.DataFrame({"ids": [ids], "nameless": [nameless], "vectors": [vectors], "cluster": [cluster.astype("<i4").tobytes()], "distance": [distance.astype("<i8").tobytes()], "sums": [totals(x, cluster, distance, k).tobytes()]})

    return state.mapInPandas(run, STATE)


def summed(state: DataFrame, k: int, dims: int) -> list[list[int]]:
    """The totals of all blocks: k rows of dims + 3 numbers come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k * (dims + 3), np.int64)
        for batch in batches:
            for raw in batch["sums"]:
                total += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "total": total[at]})

    parts = state.select("sums").mapInPandas(run, "at int, total long")
    out = [[0] * (dims + 3) for _ in range(k)]
    for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect():
        out[r["at"] // (dims + 3)][r["at"] % (dims + 3)] = int(r["total"])
    return out


def cluster(vectors: DataFrame, scratch: Scratch, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """Lloyd's clusters of integer vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the k vectors whose ids hash smallest with the
    seed.  Rounds end early where no centroid moved, as all later ones would
    be the same.

    Vectors of another length, null ones, and those with null, non-finite or
    too large components (2**27 / scale and more, where squared distances
    leave 64 bits) are left out.  Null ids hash as the empty string.  Repeated
    rows: each is a vector of its own, so that some first centroids may be
    alike; such ties go to the smaller number.  Fewer vectors than k: as many
    centroids.  Empty table: no rows.  Extra columns are ignored.
    """
    kept = integers(vectors, dims, scale)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.orderBy(place, "v").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return scratch.spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    state = scratch.save(blocks(kept, dims), "blocks")
    for left in range(rounds, -1, -1):
        after = scratch.save(assigned(state, centroids), "assigned")
        scratch.drop(state)
        state = after
        sums = summed(state, len(centroids), dims)
        moved = np.array([[x // row[dims] for x in row[:dims]] if row[dims] else old for row, old in zip(sums, centroids.tolist())], np.int64)
        if not left or (moved == centroids).all():
            break
        centroids = moved
    inertia = [row[dims + 1] * int(HALF) + row[dims + 2] for row in sums]
    whole = sum(inertia)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, sha = np.array(inertia, np.int64), np.array(digests, object)
        for batch in batches:
            for ids, nameless, at, distance in batch.itertuples(index=False):
                at = np.frombuffer(at, "<i4")
                named = pd.Series(np.frombuffer(ids, "<i8")).astype("Int64").mask(np.frombuffer(nameless, np.uint8).astype(bool))
                yield pd.DataFrame({"vec_id": named, "cluster": at, "distance": np.frombuffer(distance, "<i8"), "cluster_inertia": of[at], "inertia": np.int64(whole), "centroid_sha256": sha[at]})

    return state.select("ids", "nameless", "cluster", "distance").mapInPandas(run, schema)
