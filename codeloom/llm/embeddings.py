"""Embedding near-duplicates by an exact metric range join (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Bound on pivots, and so on what is broadcast: pivots times dimensions doubles.
MOST_PIVOTS = 4096
#: Rounding of distances that must not lose a pair.
SLACK = 1e-6


def stack(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def plain(vectors: DataFrame):
    """The embedding as array<float> if it is one, else array<double>; -0.0 becomes 0.0."""
    to = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    return F.transform("embedding", lambda x: x.cast(to) + F.lit(0).cast(to)).alias("embedding")


def classes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct usable vector: rep (smallest vec_id), copies, embedding, dim.

    Null or zero vectors and vectors with null or non-finite components are left out.
    """
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = vectors.where("vec_id is not null").where(usable).select("vec_id", plain(vectors))
    return v.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))


def join_cell(home: pd.DataFrame, other: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of home vectors with all others of a tile: per home row their weight, and a forest that connects what they connect."""
    a, b = stack(home["embedding"]), stack(other["embedding"])
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    ua, ub = (a / na[:, None]).astype(np.float32), (b / nb[:, None]).astype(np.float32)
    ra, rb, copies = home["rep"].to_numpy(), other["rep"].to_numpy(), other["copies"].to_numpy()
    links, low = np.zeros(len(a), np.int64), ra.copy()
    edges = []
    for i in range(0, len(a), 512):
        # Single precision finds what may reach the limit; double precision decides.
        x, y = np.nonzero(ua[i : i + 512] @ ub.T >= cosine - 1e-4)
        x += i
        apart = ra[x] != rb[y]
        x, y = x[apart], y[apart]
        for k in range(0, len(x), 1 << 18):
            p, q = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
            ok = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= cosine
            p, q = p[ok], q[ok]
            np.add.at(links, p, copies[q])
            edges.append(forest(ra[p], rb[q]))
    pairs = forest(*np.concatenate(edges, axis=1)) if edges else np.zeros((2, 0), np.int64)
    found = np.flatnonzero(links)
    return pd.DataFrame({
        "rep": np.concatenate([ra[found], pairs[0]]),
        "links": np.concatenate([links[found], np.zeros(pairs.shape[1], np.int64)]),
        "to": np.concatenate([ra[found], pairs[1]]),
    })


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (node, root) that connect the same nodes as the edges (a, b), at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], m)
        np.minimum.at(new, label[v], m)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.array([nodes[moved], nodes[label[moved]]], np.int64).reshape(2, -1)


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = 0.9, tile: int = 4096) -> DataFrame:
    """All links of cosine >= `cosine` between vectors: vec_id, n_links, component_id, kept.

    Equal vectors form a class and meet others once.  On the unit sphere
    cosine >= c means a distance of at most r = sqrt(2 - 2c).  Pivots, one for
    each `tile` classes, partition the vectors by nearest pivot; a vector is
    also sent to every cell that may hold a partner: by the triangle
    inequality a partner in cell j is within r of the line half way between
    the two pivots, and within the cell's radius + r of its pivot.  Each home
    vector so meets all its partners in its own cell, and cells join
    independently.  Cells are cut into tiles of about `tile` home rows by
    `tile` others, so a hot cell is many tasks; a tile multiplies matrices
    and returns sums and a spanning forest, never its pairs.

    Null, zero, null-holding and non-finite vectors link with nothing and are
    returned so.  Vectors of other length never link.  Repeated vec_ids: every
    row returns.  Empty table: no rows.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    rows = scratch.save(classes(vectors), "classes")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    results = []
    for dim, n in sorted(sizes.items()):
        part = rows.where(F.col("dim") == dim)
        k = min(MOST_PIVOTS, -(-n // tile))
        drawn = part.orderBy(F.xxhash64("rep"), "rep").limit(k).select("embedding").collect()  # at most MOST_PIVOTS
        pivots = stack([r["embedding"] for r in drawn])
        pivots /= np.sqrt((pivots * pivots).sum(1))[:, None]
        results.append(_join(part, scratch, pivots, cosine, reach, tile))
    if not results:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    found = scratch.save(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch).toDF("rep", "component")
    member = rows.join(links, "rep", "left").join(comp, "rep", "left").select("embedding", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = scratch.save(member, "members")
    v = vectors.select("vec_id", plain(vectors))
    return v.join(member, "embedding", "left").select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").cast("long").alias("component_id"),
        (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"),
    )


def _join(part: DataFrame, scratch: Scratch, pivots: np.ndarray, cosine: float, reach: float, tile: int) -> DataFrame:
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = stack(batch["embedding"])
            x /= np.sqrt((x * x).sum(1))[:, None]
            square = np.maximum(0, 2 - 2 * x @ pivots.T)
            home = square.argmin(1)
            mine = square[np.arange(len(x)), home]
            # Distance to the half way plane between home pivot and pivot j; the pivots may coincide.
            with np.errstate(divide="ignore", invalid="ignore"):
                off = (square - mine[:, None]) / (2 * between[home])
            near = np.nan_to_num(off, nan=0.0, posinf=0.0) <= reach
            near[np.arange(len(x)), home] = True
            yield batch.assign(home=home.astype(np.int32), radius=np.sqrt(mine), cells=[np.flatnonzero(r).astype(np.int32) for r in near], away=[np.sqrt(s[r]) for s, r in zip(square, near)])

    kind = dict(part.dtypes)["embedding"]
    placed = part.select("rep", "copies", "embedding").mapInPandas(cells, f"rep long, copies long, embedding {kind}, home int, radius double, cells array<int>, away array<double>")
    placed = scratch.save(placed, "placed")
    # Cell sizes and radii: one row for each pivot.
    cell = {r["home"]: (r["n"], r["radius"]) for r in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()}
    sent = placed.select("rep", "home", F.explode(F.arrays_zip("cells", "away")).alias("c")).select("rep", "home", F.col("c.cells").alias("cell"), F.col("c.away").alias("away"))
    reachof = placed.sparkSession.createDataFrame([(c, float(r + reach), -(-n // tile)) for c, (n, r) in cell.items()], "cell int, limit double, home_tiles int")
    sent = sent.join(F.broadcast(reachof), "cell").where("away <= limit or cell = home")  # at most MOST_PIVOTS rows
    arrived = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    tiles = placed.sparkSession.createDataFrame([(c, -(-n // tile)) for c, n in arrived.items()], "cell int, other_tiles int")
    hash_to = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n.cast("long")).cast("int")
    plan = scratch.save(sent.join(F.broadcast(tiles), "cell"), "plan")
    other = plan.withColumn("j", hash_to(F.col("other_tiles"), 1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("home_tiles") - 1)))
    home = plan.where("cell = home").withColumn("i", hash_to(F.col("home_tiles"), 2)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)))
    # Two cell tables: small rows first, and the vectors joined on.
    vectors = placed.select("rep", "copies", "embedding")
    columns = ["rep", "copies", "embedding"]
    home = home.select("rep", "cell", "i", "j").join(vectors, "rep").select("cell", "i", "j", *columns)
    other = other.select("rep", "cell", "i", "j").join(vectors, "rep").select("cell", "i", "j", *columns).toDF("cell_o", "i_o", "j_o", *[f"{c}_o" for c in columns])

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        return join_cell(a, b.rename(columns={f"{c}_o": c for c in columns}), cosine)

    return home.groupBy("cell", "i", "j").cogroup(other.groupBy("cell_o", "i_o", "j_o")).applyInPandas(join, "rep long, links long, to long")
