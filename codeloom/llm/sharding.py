"""Sharding by sampled splitters (operator 8).  DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: 2**64 as a double: scales a 64-bit hash into [0, 1).
SPAN = 18446744073709551616.0
#: A group of equal texts is placed by itself from this part of a shard on.
PART = 64


def unit(column: Column) -> Column:
    """A 64-bit hash as a double in [0, 1]."""
    return column.cast("double") / F.lit(SPAN) + F.lit(0.5)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few rows made by the JVM alone."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def splitters(keys: DataFrame, key: str, size: str, ranges: int) -> list[float]:
    """Quantile boundaries of `key` by `size`, from a sample drawn with probability proportional to size.

    The sample has 20 rows a range on average (40,000 at least) whatever the
    input, and only the boundaries come to the driver.  Rows are drawn by a hash of their id: reruns agree.
    """
    total = keys.agg(F.sum(size).alias("t")).first()["t"] or 0
    if not total:
        return []
    sample = max(40_000, 20 * ranges)
    drawn = keys.where(unit(F.xxhash64("doc_id", key, F.lit("splitter"))) * F.lit(float(total)) < F.col(size) * F.lit(float(sample)))
    at = [i / ranges for i in range(1, ranges)]
    if not at:
        return []
    found = drawn.agg(F.percentile_approx(key, at, 100_000).alias("q")).first()["q"]
    return sorted(set(found or []))


def place_groups(groups: list[tuple[int, int]], total: int, n_shards: int) -> tuple[list[dict], list[int]]:
    """Which shards take which bytes of the large groups (key, bytes), and how much room is left in each shard.

    Every shard holds an n-th of all bytes.  The largest group comes first
    and goes to the shard with most room, whole if it fits there, else cut
    over the shards with most room.
    """
    room = [total * (s + 1) // n_shards - total * s // n_shards for s in range(n_shards)]
    placed = []
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < size:
            s = max(range(n_shards), key=lambda i: (room[i], -i))
            take = max(1, min(size - at, room[s]))
            placed.append({"g": key, "lo": at, "hi": at + take, "shard": s})
            room[s] -= take
            at += take
    return placed, [max(0, r) for r in room]


def shard(docs: DataFrame, scratch: Scratch, n_shards: int = 8, ranges: int | None = None) -> DataFrame:
    """Put documents (doc_id, text, ...) into `n_shards` shards of near-equal bytes, equal texts together.

    Law `bytes`.  Documents are ordered by the hash of their text.  Sampled
    splitters cut that axis into ranges; a range over 1.5 times the wanted
    size is subdivided along the axis, and a text whose copies fill half a
    range or a 64th of a shard is a range of its own, subdivided by the hash
    of the id.  Exact sums of the pieces and a running sum within each give
    every document its place in bytes.

    Such large groups are placed first, each whole in the shard with most
    room; one that fits in no shard, as it is larger than a shard or the
    others have left no room, is the only kind that is cut.  The rest fills
    up the shards in order, a group of equal texts going where it starts, so
    each shard is within one 64th of itself, or one document, of the mean.

    Null text: size 1 and the checksum of the empty string.  Empty text:
    size 1, and in one group with null.  Null ids and repeated rows are rows
    of their own.  Empty table: no rows.  Extra columns are ignored.  Columns:
    doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law
    moves rows when shards are added).
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    ).withColumns({"k1": unit(F.col("g")), "k2": unit(F.xxhash64("doc_id", "g"))})
    keys = scratch.save(keys, "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0

    # Large groups: at most 2 * ranges + PART * n_shards rows, by their size.
    large_from = max(2, min(total // (2 * ranges), total // (PART * n_shards)))
    copies = keys.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    found = [(r["g"], r["bytes"]) for r in copies.where((F.col("bytes") >= large_from) & (F.col("n") > 1)).select("g", "bytes").collect()]
    placed, room = place_groups(found, total, n_shards)
    want = max(1, total // ranges)
    large = small_table(spark, [{"g": g, "whole": -(-b // want)} for g, b in found], "g bigint, whole int")
    keys = keys.join(F.broadcast(large), "g", "left")
    small = keys.where("whole is null")

    # Which range: 2**12 equal bins of the key axis lead to the few splitters inside the bin.
    bounds = splitters(small, "k1", "size", ranges)
    bins = 4096
    below, inside = [0] * (bins + 1), [[] for _ in range(bins + 1)]
    for b in bounds:
        inside[min(bins, int(b * bins))].append(b)
    for i in range(1, bins + 1):
        below[i] = below[i - 1] + len(inside[i - 1])
    table = small_table(spark, [{"bin": i, "below": below[i], "inside": inside[i]} for i in range(bins + 1)], "bin int, below int, inside array<double>")
    small = small.withColumn("bin", F.least(F.lit(bins), F.floor(F.col("k1") * bins).cast("int")))
    small = small.join(F.broadcast(table), "bin")  # 4097 rows, fixed
    small = small.withColumn("range", F.col("below") + F.size(F.filter("inside", lambda b: b <= F.col("k1")))).drop("bin", "below", "inside", "whole")

    # Overfull ranges: as many pieces as they hold the wanted size.  One row a range, of which there are `ranges` at most.
    loads = {r["range"]: r["s"] for r in small.groupBy("range").agg(F.sum("size").alias("s")).collect()}
    edges = [0.0, *bounds, 1.0]
    split = small_table(
        spark,
        [{"range": r, "pieces": -(-s // want) if s > 1.5 * want else 1, "lo": edges[r], "span": max(edges[r + 1] - edges[r], 1e-300)} for r, s in loads.items()],
        "range int, pieces int, lo double, span double",
    )
    small = small.join(F.broadcast(split), "range")  # `ranges` rows
    piece = F.floor((F.col("k1") - F.col("lo")) / F.col("span") * F.col("pieces")).cast("int")
    small = small.withColumn("piece", F.greatest(F.lit(0), F.least(F.col("pieces") - 1, piece))).withColumn("block", F.lit(0).cast("long"))
    big = keys.where("whole is not null").withColumns({"range": F.lit(0), "piece": F.least(F.col("whole") - 1, F.floor(F.col("k2") * F.col("whole")).cast("int")), "block": F.col("g")})
    # Block 0 is the small groups; a large group's block is its hash, and never 0.
    big = big.withColumn("block", F.when(F.col("block") == 0, F.lit(1)).otherwise(F.col("block")))
    columns = ["block", "range", "piece", "doc_id", "size", "text_crc32", "g", "k1", "k2"]
    keys = scratch.save(small.select(*columns).unionByName(big.select(*columns)), "pieces")

    # Where each piece starts, in bytes and rows: a row a piece, of which there are some 6 * ranges at most.
    sums = keys.groupBy("block", "range", "piece").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    ahead = Window.partitionBy("block").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("block", "range", "piece", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("at_bytes"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("at_rows"))
    w = Window.partitionBy("block", "range", "piece").orderBy("k1", "k2", "doc_id", "size", "text_crc32")
    ranked = (
        keys.withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(w) - 1)
        .join(F.broadcast(starts), ["block", "range", "piece"])
        .withColumns({"at": F.col("at_bytes") + F.col("before"), "rank": (F.col("at_rows") + F.col("row")).cast("long")})
        # Small groups go where their first document starts.
        .withColumn("start", F.when(F.col("block") == 0, F.min("at").over(Window.partitionBy("block", "range", "piece", "g"))).otherwise(F.col("at")))
    )
    upto, at = [], 0
    for s, r in enumerate(room):
        upto.append({"lo": at, "hi": at + r if s < n_shards - 1 else 1 << 62, "shard": s, "block": 0})
        at += r
    slots = small_table(spark, [u for u in upto if u["hi"] > u["lo"]] + [{**p, "block": p["g"] or 1} for p in placed], "block bigint, lo bigint, hi bigint, shard int")
    # n_shards rows for block 0; few rows for each large group, nearly always one.
    ranked = ranked.join(F.broadcast(slots.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("slots"))), "block")
    ranked = ranked.withColumn("shard", F.get(F.filter("slots", lambda x: x["hi"] > F.col("start")), F.lit(0))["shard"])
    ranked = scratch.save(ranked.select("doc_id", "size", "text_crc32", "shard", "block", "rank"), "ranked")
    # Within a shard: the small groups, then the large ones.  A row for each block of a shard.
    parts = ranked.groupBy("shard", "block").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("base", base).select("shard", "block", "first", "base")
    return ranked.join(F.broadcast(parts), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
