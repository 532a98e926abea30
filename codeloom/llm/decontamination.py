"""Benchmark decontamination by spaced seeds (operator 3).  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Which tokens of a window count.  One of these fits beside any two substituted neighbours, and between substitutions of every third, fourth or later word.
MASKS = ("11111", "111011", "1101101", "111000011")
#: Items of fewer words than a mask are met as a whole, from this many words on; one or two words occur by chance.
SHORTEST = 3
#: Benchmark seeds up to this many are broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text: runs of letters and digits, in lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def seeds(words: str, masks=MASKS) -> Column:
    """Array of (pos, seed): the hash of the tokens that a mask keeps, at every place where the mask fits."""
    w = F.col(words)

    def of(k: int, mask: str) -> Column:
        kept = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(w) - len(mask) + 1
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[w[i + (j - 1)] for j in kept]).alias("seed")))

    return F.concat(*[of(k, m) for k, m in enumerate(masks)])


def overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, masks=MASKS, least: int = 8) -> DataFrame:
    """Which documents hold a passage of which benchmark item: doc_id, item_id, shift, matched, score.

    Seeds of both sides are joined; each hit fixes how far the item is
    shifted against the document, and there all words are compared.  A
    stretch scores one for each equal word and minus one for each other; the
    pair counts if the best stretch reaches `least`, or the whole item if
    that has fewer words.  So up to half of the words of a passage may be
    substituted, as long as one mask fits somewhere.  The best shift of each
    pair is returned.

    Null or empty texts and items, and items of fewer than SHORTEST words,
    overlap with nothing; items too short for the masks are met as a whole.
    Rows with a null doc_id or item_id are left out, for a pair could not
    name them.  Repeated rows give the pair once; different texts under one
    id are each compared.  Empty tables: no rows.  Extra columns are ignored.
    Documents meet the benchmark's seeds in the task that reads them, without
    a shuffle, while there are at most BROADCAST_SEEDS of them.
    """
    item = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("item_words"))
    item = scratch.save(item, "items")
    # Lengths of items that no mask fits: fewer than a mask has places.
    words_in = F.size("item_words")
    lengths = sorted(r[0] for r in item.where((words_in >= SHORTEST) & (words_in < min(map(len, masks)))).select(words_in).distinct().collect())
    wholes = tuple("1" * n for n in lengths)
    seed = item.select("item_id", F.explode(seeds("item_words", masks)).alias("s"))
    if wholes:
        masks = masks + wholes
        seed = seed.unionByName(item.where(words_in.isin(lengths)).select("item_id", F.explode(seeds("item_words", masks)).alias("s")))
    seed = seed.select("item_id", F.col("s.pos").alias("item_pos"), "s.seed")
    seed = scratch.save(seed, "item-seeds")
    few = seed.count() <= BROADCAST_SEEDS
    words = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("words"))
    places = words.select("doc_id", F.explode(seeds("words", masks)).alias("s")).select("doc_id", F.col("s.pos").alias("pos"), "s.seed")
    met = places.join(F.broadcast(seed) if few else seed, "seed")
    hits = met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.count("*").alias("hits"))
    hits = scratch.save(hits, "hits")
    # Back to the texts that were hit.
    hit_docs = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", word_hashes(F.col("text")).alias("words"))
    pairs = hit_docs.join(hits, "doc_id").join(item, "item_id")
    equal = F.transform(F.sequence(F.lit(1), F.size("item_words")), lambda i: F.coalesce(F.get("words", i + F.col("shift") - 1) == F.get("item_words", i - 1), F.lit(False)))
    best = F.aggregate(
        "equal",
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, e: F.struct(
            F.greatest(F.lit(0), acc["run"] + F.when(e, 1).otherwise(-1)).alias("run"),
            F.greatest(acc["best"], acc["run"] + F.when(e, 1).otherwise(-1)).alias("best"),
        ),
    )["best"]
    scored = pairs.withColumn("equal", equal).select(
        "doc_id", "item_id", "shift", F.size(F.filter("equal", lambda e: e)).alias("matched"), best.alias("score"), F.least(F.lit(least), F.size("item_words")).alias("needed")
    )
    return (
        scored.where("score >= needed")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("score", "matched", (-F.abs("shift")).alias("near"), "shift")).alias("b"))
        .select("doc_id", "item_id", "b.shift", "b.matched", "b.score")
    )
