"""The pipeline against plain Python versions of its decisions."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_operators import jaccard_brute, prose, union


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark, with a planted case for every stage."""
    rng = random.Random(21)
    rows, toxic, held = [], {}, set()

    def put(text, source="a"):
        rows.append((len(rows), text, "en", source, len(text or "")))
        return len(rows) - 1

    for i in range(120):
        toxic[put(prose(rng, 40, 5000), "ab"[i % 2])] = 0
    for _ in range(40):
        toxic[put(prose(rng, 20, 5000) + " moron " + prose(rng, 20, 5000))] = 1
    unlabelled = [put(prose(rng, 20, 5000) + " moron, " + prose(rng, 20, 5000)) for _ in range(3)]
    copies = [put(rows[3][1]), put(rows[3][1].replace(" ", "  ", 3)), put(rows[4][1] + " extra word")]
    item = prose(rng, 25, 5000)
    leaks = [put(prose(rng, 30, 5000) + " " + item + " " + prose(rng, 30, 5000)) for _ in range(2)]
    empty, null = put("", "c"), put(None, None)
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    bad = {i for i, t in toxic.items() if t} | set(unlabelled)
    return path, rows, bad, copies, leaks, (empty, null)


def test_stages(spark, corpus, tmp_path):
    path, rows, bad, copies, leaks, blank = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    everything = {r[0] for r in rows}
    clean = everything - bad
    assert sorted(kept[0]) == sorted(clean)
    sets, edges = jaccard_brute([(i, rows[i][1]) for i in sorted(clean)])
    ids = sorted(clean)
    label = union(edges, sets)
    first = {ids[i] for i in sets if label[i] == i}
    assert sorted(kept[1]) == sorted(first) and not set(copies) & first
    assert sorted(kept[2]) == sorted(first - set(leaks))
    times = Counter(kept[3])
    assert set(times) <= first - set(leaks) - set(blank) and max(times.values()) <= 3
    words = {i: len((rows[i][1] or "").split()) for i in everything}
    budget = sum(words[i] for i in kept[2])
    assert abs(sum(words[i] * n for i, n in times.items()) - budget) <= 0.05 * budget
    assert Counter(kept[4]) == times
    total = corpus_pipeline.run(spark, path).collect()
    assert Counter(r["doc_id"] for r in total) == times
    assert sorted(r["start"] for r in total)[0] == 0


CLASHES = ("score", "row", "rec", "_doc", "_source", "_size", "_times", "_round", "place", "copies", "n", "key", "node", "component_id", "item_id", "shift", "plain_hits")


def test_awkward_rows(spark, tmp_path_factory, tmp_path):
    """Repeated and null ids, clashing columns: a row goes for its own text only."""
    rng = random.Random(31)
    item, base = prose(rng, 25, 5000), prose(rng, 40, 5000)
    labelled = [(i, prose(rng, 30, 5000) + (" moron" if i % 4 == 0 else "")) for i in range(100, 180)]
    rows = labelled + [(1, base), (1, prose(rng, 30, 5000)), (2, base + " more"), (2, prose(rng, 30, 5000)), (None, prose(rng, 30, 5000)), (None, base + " again"), (3, "a " + item), (3, prose(rng, 30, 5000)), (4, "x moron y"), (4, None), (5, "")]
    full = [(i, t, "en", "ab"[k % 2], 0, *("c",) * len(CLASHES)) for k, (i, t) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("awkward"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame(full, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    clean = Counter(r for r in rows if "moron" not in (r[1] or ""))
    assert kept[0] == clean
    assert kept[1] == clean - Counter([(2, base + " more"), (None, base + " again")])
    assert kept[2] == kept[1] - Counter([(3, "a " + item)])
    assert set(kept[3]) <= {r for r in kept[2] if r[1]}


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
