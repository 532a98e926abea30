"""Mixing sources to target weights by weighted fair queueing (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Scratch

#: Most times that a source, and with it a document, is used.
MOST = 3


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """Word targets of sources (source, source_size): (source, source_size, target, weight).

    Weights go round in code-point order of the source, null last.  The
    budget is the sum of all sizes.  target = min(most * size, level * weight)
    with the one level that spends the budget: what a capped source leaves is
    shared again by weight until none is above its cap.  One task sorts the
    sources, of which there is a row each.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(place) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i + 1).cast("int"))
    by_fill = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sources.withColumn("weight", weight)
    t = (
        t.withColumn("capped", F.coalesce(F.lit(most) * F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("level_here", (F.col("budget") - F.col("capped")) / F.col("left_weight"))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("level", F.max(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.col("level_here"))).over(everything))
    )
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"), "weight")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def shuffled_place(doc_id: Column, text: Column) -> Column:
    """Where a document comes in the shuffled order of its source: a hash of its id and text."""
    return F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


#: Total order of the queue; what still ties is alike in every number.
ORDER = ("finish", "place", "size", "round")


def queued(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...], digits: int | None) -> DataFrame:
    """Documents with their place in line: doc_id, source, size, place, source_size, target, weight, middle.

    `middle` is the number of words of the source up to and with half of the
    document, in the shuffled order of the source.  Running sums take two
    steps, because a source may hold a third of all rows: hash buckets,
    16**digits for a source, are summed first (map side), and documents then
    add up within their bucket.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled_place(F.col("doc_id"), F.col("text")).alias("place"))
    d = scratch.save(d, "sizes")
    if digits is None:
        # As many buckets as each holds rows: neither grows faster than the root of the input.
        rows, digits = d.count(), 1
        while 256**digits < rows:
            digits += 1
    d = d.withColumn("bucket", F.substring("place", 1, digits))
    buckets = scratch.save(d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = scratch.save(targets(buckets.groupBy("source").agg(F.sum("bucket_size").cast("long").alias("source_size")), weights), "targets")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(w), F.lit(0)))
    here = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = d.withColumn("in_bucket", F.coalesce(F.sum("size").over(here), F.lit(0)))
    known = buckets.join(sources, buckets["source"].eqNullSafe(sources["source"])).select(
        buckets["source"].alias("s"), F.col("bucket").alias("b"), "bucket_start", "source_size", "target", "weight"
    )
    run = run.join(known, run["source"].eqNullSafe(known["s"]) & (run["bucket"] == known["b"]))
    middle = F.col("bucket_start") + F.col("in_bucket") + F.col("size") / F.lit(2.0)
    return scratch.save(run.select("doc_id", "source", "size", "place", "source_size", "target", "weight", middle.alias("middle")), "queued")


def finish(round_: Column) -> Column:
    """Virtual finish time of a document in a round: words of its source served until then, divided by the weight."""
    return (round_ * F.col("source_size") + F.col("middle")) / F.col("weight")


def truncation(queue: DataFrame, scratch: Scratch) -> tuple | None:
    """The first entry (see ORDER) that the budget, the sum of all sizes, no longer holds; None if there is none.

    Every document that has words enters once for each round.  Entries are
    range-sorted by finish time; sums of the ranges say in which one the
    budget ends, and only that one is summed row by row.
    """
    entries = queue.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).select("size", "place", "round", finish(F.col("round")).alias("finish"))
    line = entries.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("range", F.spark_partition_id())
    line = scratch.save(line, "line")
    budget = queue.agg(F.sum("size")).first()[0] or 0
    sums = line.groupBy("range").agg(F.sum("size").alias("words"))
    # A row for each range.
    upto = sums.withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    last = upto.where(F.col("upto") > budget).orderBy("range").select("range", (F.col("upto") - F.col("words")).alias("before")).first()
    if last is None:
        return None
    within = line.where(F.col("range") == last["range"]).withColumn("upto", F.lit(last["before"]) + F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    return tuple(within.where(F.col("upto") > budget).orderBy(*ORDER).select(*ORDER).first())


def precedes(entry: list[Column], cut: tuple) -> Column:
    """Whether an entry comes before the cut in ORDER."""
    before = F.lit(False)
    for x, c in reversed(list(zip(entry, cut))):
        before = (x < F.lit(c)) | ((x == F.lit(c)) & before)
    return before


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), digits: int | None = None) -> DataFrame:
    """How many words the mix takes of every document: doc_id, source, size, source_size, target, taken, copies, place, middle, weight.

    Weighted fair queueing.  The documents of a source stand in a shuffled
    order and come MOST times round.  The virtual finish time of a document
    is the number of words of its source served until half of it is through,
    divided by the weight of the source: half, so that what a source gets is
    rounded to the nearest document and not down.  The mix is the global
    order by finish time, truncated where the words reach the budget, the sum
    of all sizes.  A source that has come round MOST times leaves the queue,
    so the others share the rest by weight: `target`, which is worked out
    from the sizes alone, is what each source comes near.

    Null source: a source of its own, last in order.  Null or empty text and
    text of white space: size 0, taken 0.  Null ids are ids like others.
    Repeated rows: rows of their own, side by side in the order.  Empty table
    or no words: nothing is taken.  Other columns are ignored.
    """
    queue = queued(docs, scratch, weights, digits)
    cut = truncation(queue, scratch)
    entry = lambda r: precedes([finish(F.lit(r)), F.col("place"), F.col("size"), F.lit(r)], cut) if cut else F.lit(True)
    copies = F.when(F.col("size") > 0, sum((entry(r).cast("int") for r in range(1, MOST)), entry(0).cast("int"))).otherwise(0)
    return queue.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "place", "middle", "weight"
    )


def mixed_documents(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The documents of the mix in its order, each as often as it is taken: range-sorted by virtual finish time.

    Columns of the input, unchanged, whatever they are called.  Documents
    without words are in no mix.  Rows that repeat id, text and source share
    their copies; which of them is used makes no difference to any count.
    """
    key = ["place", "source"]
    plan = mix(docs.select("doc_id", "text", "source"), scratch, weights).where("copies > 0")
    first = F.min_by(F.struct("middle", "source_size", "weight"), "middle").alias("at")
    plan = scratch.save(plan.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"), first), "plan")
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("rec"), shuffled_place(F.col("doc_id"), F.col("text")).alias("place"), "source")
    plan = plan.select(F.col("place").alias("p"), F.col("source").alias("s"), "copies", "rows", "at.middle", "at.source_size", "at.weight")
    hit = held.join(plan, (held["place"] == plan["p"]) & held["source"].eqNullSafe(plan["s"]))
    alone = hit.where("rows = 1").withColumn("times", F.col("copies"))
    alike = Window.partitionBy(*key).orderBy(F.lit(0))
    shared = hit.where("rows > 1").withColumn("row", F.row_number().over(alike))
    shared = shared.withColumn("times", F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("row") <= F.col("copies") % F.col("rows"), 1).otherwise(0)).drop("row")
    rounds = alone.unionByName(shared.where("times > 0")).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
    ordered = rounds.withColumn("finish", finish(F.col("round"))).repartitionByRange("finish", "place").sortWithinPartitions("finish", "place")
    return ordered.select("rec.*")
