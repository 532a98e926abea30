"""Very long texts, null ids and clashing columns where the tests of the operators have none."""

from __future__ import annotations

import random
import re
import sys
import zlib

import pandas as pd
from codeloom.llm import common, decontamination, jaccard, mixing, queries, sharding, urls
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def long_text(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_decontamination_in_a_very_long_text(spark, scratch, make_docs):
    """A passage in the midst of 60,000 words, every fifth of it substituted, and one at the very end; of two equal shifts the pair comes once."""
    rng = random.Random(1)
    items = [long_text(rng, 40) for _ in range(3)]
    words = long_text(rng, 60_000).split()
    near = [w if i % 5 else "other" for i, w in enumerate(items[0].split())]
    text = " ".join(words[:30_000] + near + words[30_000:] + items[1].split())
    docs = make_docs([(1, text), (2, " ".join(words)), (3, f"{items[2]} {items[2]}")])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.overlaps(docs, bench, scratch).collect()}
    assert set(got) == {(1, 0), (1, 1), (3, 2)}
    assert got[1, 1]["matched"] == got[3, 2]["matched"] == 40 and got[1, 0]["matched"] == 32


def test_mixing_with_a_very_long_text(make_docs, scratch):
    """One document holds most of its source; null ids and repeated rows beside it."""
    rng = random.Random(2)
    rows = [(0, long_text(rng, 150_000), "a")] + [(i, long_text(rng, 300), "ab"[i % 2]) for i in range(1, 120)] + [(None, "x y", None), (7, "same", "b"), (7, "same", "b")]
    got = mixing.mix(make_docs(rows), scratch).collect()
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t)) for _, t, _ in rows)
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    # The queue is cut before the document that the budget no longer holds, and that may be this one.
    budget, taken = sum(r["size"] for r in got), sum(r["taken"] for r in got)
    assert budget - 150_000 < taken <= budget


def test_sharding_with_a_very_long_text(make_docs, scratch):
    """A document larger than a shard beside small ones; equal texts, null and empty ones included, keep together."""
    rng = random.Random(3)
    rows = [(0, long_text(rng, 100_000))] + [(i, long_text(rng, 50)) for i in range(1, 300)] + [(None, "same text")] * 3 + [(900, "same text"), (901, None), (902, "")]
    got = sharding.shard(make_docs(rows), scratch).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t in rows)
    shards = {k: [r for r in got if r["shard"] == k] for k in range(8)}
    assert all(sorted(r["slot"] for r in held) == list(range(len(held))) for held in shards.values())
    assert len({r["shard"] for r in got if r["size"] == size("same text")}) == 1 == len({r["shard"] for r in got if r["size"] == 1})
    # Within one document of the mean.
    mean, largest = sum(r["size"] for r in got) / 8, size(rows[0][1])
    assert all(abs(sum(r["size"] for r in held) - mean) <= largest for held in shards.values())


def test_urls_that_are_long_or_nameless(spark, scratch):
    """Null page_ids are judged, a path of 200,000 characters is kept whole, and columns named like results are ignored."""
    path = "/en/" + "a/b-" * 50_000
    rows = [(None, "x://a.net/"), (None, None), (1, f"x://h.example.org{path}?q"), (1, "x://W.example.net/en/1"), (None, "x://w.org/fr/")]
    pages = spark.createDataFrame([(*r, "h", "r", "v") for r in rows], "page_id long, url string, host string, rule string, verdict string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((tuple(r)[:5] for r in urls.judge(pages, labels, scratch).collect()), key=repr)
    free = [r for r in got if r[3] is None]
    assert [r for r in got if r[3]] == sorted([(None, "a.net", "/", "net/", "block"), (None, "w.org", "/fr/", "org/fr/", "allow"), (1, "w.example.net", "/en/1", "example.net/en/", "allow")], key=repr)
    assert sorted(r[:3] for r in free if r[0]) == [(1, "h.example.org", path)] and [r for r in free if r[0] is None] == [(None, "", "", None, "allow")]


def test_batches_of_large_rows_are_cut_by_bytes(spark):
    """Blocks of a megabyte: 64 MB of them were a batch, in the JVM and in its worker."""
    queries.scratch(spark, "test")
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).cast("binary").alias("b"))

    def sizes(it):
        for batch in it:
            yield pd.DataFrame({"n": [len(batch)]})

    got = [r["n"] for r in rows.mapInPandas(sizes, "n long").collect()]
    assert sum(got) == 40 and max(got) <= 10


def test_jaccard_releases_what_an_earlier_operator_left_in_a_worker(spark, make_docs):
    """A reused worker held the lexicon and the words of the toxicity stage through all later ones."""
    docs = make_docs([(i, f"a b c d e {i}") for i in range(8)]).coalesce(1)

    def fill(it):
        common.per_process("toxicity", "k", lambda: "large")
        yield from it

    def left(it):
        for batch in it:
            yield pd.DataFrame({"n": [sum(k == "toxicity" for k in vars(sys.modules.get("_codeloom_worker", common)))]})

    one = spark.range(0, 1, 1, 1).select("id")
    one.mapInPandas(fill, "id long").collect()
    d = docs.select("text", docs["doc_id"].alias("doc"))
    jaccard.set_blocks(d, jaccard.Parameters()).select("block").mapInPandas(left, "n long").collect()
    workers = [r["n"] for r in one.mapInPandas(left, "n long").collect()]
    assert workers == [0]
