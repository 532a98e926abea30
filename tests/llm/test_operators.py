"""Each operator against a brute-force version, and on nulls, empties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyspark
import pytest
from codeloom.llm import blocks, common, decontamination, embeddings, jaccard, language, mixing, sharding, suffixes, tokens, toxicity, urls
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def union(edges, nodes):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark, scratch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    want = union(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


# 1


def test_planes():
    rng = np.random.default_rng(2)
    for width in (1, 3, 6, 8):
        for n in (0, 1, 5, 3000):
            v = rng.integers(0, 1 << 63, n, np.uint64) >> np.uint64(max(0, 63 - 8 * width))
            for x in (v, np.sort(v)):
                assert len(blocks.planes(x, width)) == width * n and (blocks.unplanes(blocks.planes(x, width), width) == x).all()


def jaccard_brute(rows):
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, edges


@pytest.mark.parametrize("width", [1, 6])
def test_jaccard_matches_brute_force(spark, scratch, make_docs, width):
    rng = random.Random(2)
    texts = []
    for _ in range(14):
        base = prose(rng, rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 40, 120, 300]), 60)
        texts += [base, base.upper()] + [edited(rng, base, rng.randrange(1, 1 + max(1, len(base.split()) // 12))) for _ in range(12)]
        texts += [base + " " + prose(rng, max(1, len(base.split()) // 5))]
    passage = prose(rng, 30)
    texts += [prose(rng, 60) + " " + passage for _ in range(10)]
    texts += ["", None, " \t", "Ä ä", "ä Ä", "one\x0btwo", "one two"] + [" ".join(f"a{i}" for i in range(k)) for k in range(1, 14)]
    rng.shuffle(texts)
    sets, edges = jaccard_brute(list(enumerate(texts)))
    want = union(edges, sets)
    got = {r["doc_id"]: r for r in jaccard.join(make_docs(texts), scratch, jaccard.Parameters(width=width)).collect()}
    assert len(got) == len(texts)
    for i in sets:
        assert got[i]["n_shingles"] == len(sets[i])
        assert got[i]["component_id"] == want[i], texts[i]


@pytest.mark.parametrize("light,rounds", [(1, 0), (12, 0), (40, 1), (5, 3)])
def test_jaccard_every_boundary_and_round(spark, scratch, make_docs, monkeypatch, light, rounds):
    rng = random.Random(light)
    base = [prose(rng, n, 50) for n in (6, 9, 11, 14, 18, 60)]
    texts = [edited(rng, b, rng.randrange(0, 2 + len(b.split()) // 14)) for b in base for _ in range(20)]
    monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    sets, edges = jaccard_brute(list(enumerate(texts)))
    want = union(edges, sets)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(make_docs(texts), scratch, jaccard.Parameters(crowd=3 if light % 2 else 2000), rounds=rounds).collect()}
    assert got == want


def test_jaccard_boundary():
    p = jaccard.Parameters()
    found = [jaccard.boundary(x, p) for x in (1.5, 2, 3, 5, 200)]
    assert found == sorted(found) and found[0] == 7 and found[-1] == p.light_most


def test_list_length(spark):
    of = lambda *levels: spark.createDataFrame([(bytearray(x),) for x in levels], "levels binary")
    assert blocks.list_length(of([0, 0, 2], [3, 3, 0, 9])) == 3.0
    assert blocks.list_length(of([0, 0])) == 2.0 == blocks.list_length(of())


def test_jaccard_of_a_table_that_repeats_itself(spark, scratch, make_docs):
    rng = random.Random(18)
    base = [prose(rng, 30, 100) for _ in range(12)]
    texts = base + [edited(rng, t, 1) for t in base]
    docs = make_docs(texts)
    sets, edges = jaccard_brute(list(enumerate(texts)))
    want = union(edges, sets)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.join(docs.unionByName(docs), scratch).collect()]
    assert Counter(got) == Counter([*want.items()] * 2)


def test_jaccard_edges(spark, scratch, make_docs):
    assert jaccard.join(make_docs([]), scratch).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (2, "a b c d e f"), (None, "q"), (3, None)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(make_docs(rows), scratch).collect())
    assert got == Counter({(1, 2, 1): 2, (2, 2, 2): 1, (2, 2, 1): 1, (None, 1, None): 1, (3, 0, 3): 1})
    # Classes without an id link others.
    base = prose(random.Random(19), 40, 500)
    words = base.split()
    chain = [(7, " ".join(words[:36])), (None, " ".join(words[2:40])), (4, " ".join(words[4:] + ["new", "end"]))]
    _, edges = jaccard_brute(chain)
    assert {(0, 1), (1, 2)} <= set(edges)
    assert Counter((r["doc_id"], r["component_id"]) for r in jaccard.join(make_docs(chain), scratch).collect()) == Counter([(7, 4), (None, 4), (4, 4)])


# 2


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for k in range(200):
        n, top = int(rng.integers(0, 5000)), [2, 50, 5000, 49408, 2**32 - 1][k % 5]
        x = rng.integers(0, top, n).astype(np.uint32)
        if k % 3 == 0:
            x = np.repeat(x, rng.integers(1, 300, n))[:6000]
        packed, blocks = tokens.encode(x)
        assert (tokens.decode(packed, len(x)) == x).all()
        raw = tokens.pack([1], [len(x)], x)
        for b in range(len(blocks)):
            assert (tokens.unpack(raw, b)[2] == x[b * tokens.BLOCK : (b + 1) * tokens.BLOCK]).all()


def test_simple8b_rejects_what_it_cannot_hold():
    with pytest.raises(ValueError):
        tokens.encode(np.array([1 << 33], np.uint64))
    with pytest.raises(ValueError):
        tokens.unpack(b"nope")


ODD = ["", "  ", None, "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "İstanbul ΑΣ ΑΣ.  x y é Å\x1cfoo it's IT'S don'T 123 ½ ²", "\u0301abc \u0301", "x\x85y", "ﬁ ſ K Å", "日本 語", "😀😀 👩‍👩‍👧", "a\n\n b", "ab " * 3000]


@pytest.mark.parametrize("file_ids", [7, 1 << 20])
def test_tokens(spark, scratch, make_docs, file_ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    texts = ODD + [prose(random.Random(3), 50)] * 2
    big = 2**53 + 1  # ids that a double would round
    rows = [(big - i, t) for i, t in enumerate(texts)] + [(None, None), (None, "no id"), (None, "z")]
    docs = make_docs(rows).repartition(3)
    files = tokens.write_ids(docs, scratch, path, 2, file_ids)
    got = sorted(tokens.read_ids(files).collect(), key=lambda r: r["start"])
    at = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.read_ids(tokens.write_ids(make_docs([]), scratch, path, 2)).count() == 0


def test_tokens_of_random_unicode():
    """The short cut for Latin pieces, against the whole tokenizer."""
    import public_tokenizers

    tk = tokens.PieceTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert tk.plain and tk.drops_space()
    rng = random.Random(17)
    latin = [chr(c) for c in range(0x21, 0x180)] + ["\u0301", "\u00ad", " ", " ", " "]
    wide = latin + [chr(rng.randrange(0x180, 0xD800)) for _ in range(400)] + [chr(rng.randrange(0x10000, 0x1F900)) for _ in range(50)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for alphabet in (latin, wide) for _ in range(1500)]
    lengths, ids = tk.encode(texts)
    at = 0
    for text, n in zip(texts, lengths.tolist()):
        assert ids[at : at + n].tolist() == tk.ids_of(text), text
        at += n
    # With a small memory that is cut back all the time.
    small = tokens.PieceTokenizer(public_tokenizers.path("word_bpe_49k.json"), most=300)
    parts = [small.encode(texts[i : i + 100] + texts[:5]) for i in range(0, len(texts), 100)]
    assert len(small.known) < len(tk.known) / 2
    for i, (some, their) in enumerate(parts):
        assert some.tolist() == lengths[100 * i : 100 * (i + 1)].tolist() + lengths[:5].tolist()
        assert their.tolist() == ids[int(lengths[: 100 * i].sum()) : int(lengths[: 100 * (i + 1)].sum())].tolist() + ids[: int(lengths[:5].sum())].tolist()


# 3


def overlaps_brute(docs, items):
    """(doc_id, item_id) of every pair with a stretch at any shift that scores enough; by comparing all words."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = set()
    for i, text in docs:
        a = cut(text)
        for j, item in items:
            b = cut(item)
            if i is None or j is None or len(b) < decontamination.SHORTEST:
                continue
            for shift in range(-len(b), len(a) + 1):
                run = best = 0
                for k, w in enumerate(b):
                    run = max(0, run + (1 if 0 <= k + shift < len(a) and a[k + shift] == w else -1))
                    best = max(best, run)
                if best >= min(8, len(b)):
                    found.add((i, j))
                    break
    return found


def test_decontamination(spark, scratch, make_docs):
    rng = random.Random(4)
    items = [prose(rng, n, 3000) for n in (14, 20, 30, 60, 38)] + ["a b c d e", "", None, "k l m n", "o p q", "yes", "no no"]
    bench = [*enumerate(items), (None, prose(rng, 20, 3000)), (3, items[3])]
    clean = [prose(rng, 100, 3000) for _ in range(20)]
    whole = [prose(rng, 40, 3000) + " " + it.upper() + ". " + prose(rng, 40, 3000) for it in items[:5]]
    part = [prose(rng, 30, 3000) + " " + " ".join(items[3].split()[20:40]), " ".join(items[3].split()[:12])]
    subst = [" ".join("zz" if k % every == phase % every else w for k, w in enumerate(it.split())) for it in items[:5] for every in (3, 4, 5, 6, 7) for phase in (0, 2)]
    subst += [" ".join("zz" if rng.random() < 0.25 else w for w in it.split()) for it in items[:5] for _ in range(6)]
    texts = clean + whole + part + subst + ["", None, "x a b c d e y", "k l m n", "x k l m z n", "say o p q", "yes no no", "a b c d"]
    docs = [*enumerate(texts), (None, items[0]), (7, items[0]), (8, clean[8])]
    bench_table = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.overlaps(make_docs(docs), bench_table, scratch).collect()}
    want = overlaps_brute(docs, bench)
    assert {(20 + i, i) for i in range(5)} | {(25, 3), (26, 3), (7, 0)} <= want
    assert set(got) == want
    assert got[20, 0]["shift"] == 40 and got[20, 0]["matched"] == 14
    assert decontamination.overlaps(make_docs([]), bench_table, scratch).count() == 0
    assert decontamination.overlaps(make_docs(texts), bench_table.limit(0), scratch).count() == 0


def test_decontamination_without_broadcast(spark, scratch, make_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    text = prose(random.Random(5), 30, 3000)
    bench = spark.createDataFrame([(1, text), (2, text)], "item_id long, text string")
    got = decontamination.overlaps(make_docs([(9, text), (9, text), (8, "x " + text)]), bench, scratch)
    assert {(r["doc_id"], r["item_id"], r["shift"]) for r in got.collect()} == {(9, 1, 0), (9, 2, 0), (8, 1, 1), (8, 2, 1)}


# 4


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_lexicon_matches_edit_distance():
    rng = random.Random(6)
    terms = ["idiot", "moron", "trash", "scum", "worthless", "idiots", "ab"]
    lexicon = toxicity.Lexicon(terms, 5)
    words = ["".join(rng.choice("abidotmrn") for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    words += [t[:i] + c + t[i + k :] for t in terms for i in range(len(t) + 1) for c in ("", "x", "ö") for k in (0, 1)]
    for w in words:
        near = [(d, t) for t in terms if (d := levenshtein(w, t)) == 0 or d == 1 and len(t) >= 5 and len(w) >= 4]
        want = min(near)[::-1] if near else None
        assert lexicon.match(w) == want, w


def test_lexicon_stems():
    lexicon = toxicity.Lexicon(["scum", "achlich*", "trash", "tra*"], 5)
    assert lexicon.match("achlichau") == ("achlich*", 0) and lexicon.match("achlichx" * 3) == ("achlich*", 0)
    assert lexicon.match("achlich") is None and lexicon.match("schlichau") is None
    assert lexicon.match("trash") == ("trash", 0) and lexicon.match("trashy") == ("tra*", 0) and lexicon.match("scum") == ("scum", 0)


def test_toxicity_grades(spark, scratch, make_docs):
    """Stems are found in inflected words, a surer term and more hits score higher, and cues of being spoken about are learned."""
    rng = random.Random(20)
    pad = lambda n=15: prose(rng, n, 300)
    rows = [(f"{pad()} {rng.choice(['idiot', 'moron'])} {pad()}", 1) for _ in range(200)] + [(f"{pad()} meh {pad()}", 1) for _ in range(60)] + [(f"{pad()} meh", 0) for _ in range(6)]
    rows += [(f"{pad()} verbost{rng.randrange(10**6)} {pad()}", 1) for _ in range(30)] + [(pad(30), 0) for _ in range(400)]
    rows += [(f"{pad(5)} dictionary idiot {pad(5)}", 0) for _ in range(14)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), scratch)
    assert {"moron", "meh", "verbost*"} <= set(model.terms) and "dictionary" in model.cues
    texts = ["w1 w2", "w1 meh w2", "w1 moron w2", "w1 moron w2 moron w3 moron", "w1 verbost77 w2", "w1 moron dictionary w2", "w1 verbost w2"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs(texts), model, ["doc_id"]).collect()}
    assert got[0] < got[1] < got[2] < got[3] and got[4] > 0.5 and got[5] < 0.3 and got[6] == got[0]
    clash = make_docs(texts).withColumns({c: F.lit("x") for c in ("score", "plain_hits", "quoted_hits", "_text", "_judged", "j", "sure")})
    kept = toxicity.score(clash, model, clash.columns)
    assert len(kept.columns) == len(set(kept.columns)) and {r["doc_id"]: r["score"] for r in kept.select("doc_id", "score").collect()} == got
    assert toxicity.score(make_docs([]), model, ["doc_id"]).count() == 0


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (400, len(toxicity.FEATURES))).astype(float)
    truth = np.array([-2.0, 1.5, -1.0, 0.5, 0.0, 0.0])
    p = 1 / (1 + np.exp(-(truth[0] + x @ truth[1:])))
    w = toxicity.logistic(x, 1000 * (1 - p), 1000 * p)
    assert np.abs(w - truth).max() < 0.1
    assert (toxicity.logistic(x, np.ones(400), np.zeros(400))[[1, 3, 4, 5]] >= 0).all()


def test_toxicity_learns_and_scores(spark, scratch, make_docs):
    rng = random.Random(7)
    rows = [(" ".join([prose(rng, 20), rng.choice(["idiot", "moron"]), prose(rng, 20)]), 1) for _ in range(60)] + [(prose(rng, 40), 0) for _ in range(300)]
    rows += [(None, 0), ("", 1), ("x", None)]
    train = spark.createDataFrame(rows, "text string, toxic int")
    model = toxicity.fit(train, scratch)
    assert model.terms == ["idiot", "moron"]
    quoted = 'w1 w2 he said "idiot" was the word w3 w4'
    texts = ["w1 idiot w2", "w1 IDIOT! w2", "w1 id1ot w2", "w1 mor0n, w2", quoted, "w1 w2 w3", "", None, "w1 " * 5000 + "idiot"]
    got = {r["doc_id"]: r for r in toxicity.score(make_docs(texts), model, ["doc_id"]).collect()}
    assert all(got[i]["score"] > 0.8 for i in (0, 1, 2, 3, 8))
    assert got[4]["quoted_hits"] == 1 and got[4]["score"] < 0.3
    assert all(got[i]["score"] < 0.3 for i in (5, 6, 7))
    nothing = toxicity.fit(train.limit(0), scratch)
    assert {r["score"] for r in toxicity.score(make_docs(texts), nothing, ["doc_id"]).collect()} == {0.0}


def test_training_rows(spark, make_docs):
    docs = make_docs([(i, f"t{i}") for i in range(400)] + [(None, "n"), (1, "again"), (2, None)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)] * 2 + [(0, 1, 1), (None, 1, 1), (350, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, toxicity.training_rows(docs, labels).collect()))
    want = [(f"t{i}", i % 2) for i in range(300)] + [("t0", 1), ("again", 1), (None, 0)]
    assert got == Counter(want)
    few = [toxicity.training_rows(d, labels, toxicity.Parameters(most_labels=100)).collect() for d in (docs, docs.repartition(5))]
    assert Counter(few[0]) == Counter(few[1]) and 60 <= len(few[0]) <= 140 and set(map(tuple, few[0])) <= set(want)
    assert toxicity.training_rows(docs, labels.limit(0)).count() == 0 == toxicity.training_rows(docs.limit(0), labels).count()


# 5


@pytest.mark.parametrize("tile", [8, 30, 4096])
def test_embeddings_match_brute_force(spark, scratch, tile):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6))
    vectors = [list(map(float, x)) for x in np.concatenate([base, base[:20] + 0.25 * rng.normal(size=(20, 6)), np.repeat(base[:1], 25, 0) + 0.1 * rng.normal(size=(25, 6)), 3 * base[:3], base[5:8]])]
    vectors += [None, [0.0] * 6, [math.nan] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.inf] * 6, [1.0, 0.0], [1.0, 0.01], [-0.0] * 5 + [1.0], [0.0] * 5 + [1.0]]
    rows = [(i * 3, v) for i, v in enumerate(vectors)] + [(0, vectors[0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, copies int, rep int")
    got = sorted(embeddings.near_duplicates(df, scratch, tile=tile).collect())

    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if usable(x) and usable(y) and len(x) == len(y) and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
            links.append((a, b))
    count = Counter(i for e in links for i in e)
    label = union([(rows[a][0], rows[b][0]) for a, b in links], {i for i, _ in rows})
    want = sorted((i, count[k], label[i], label[i] == i) for k, (i, _) in enumerate(rows))
    assert [tuple(r) for r in got] == want
    assert embeddings.near_duplicates(df.limit(0), scratch).count() == 0


# 6


def test_targets(spark):
    def want(sizes, weights=(5, 2, 1)):
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        w = {s: weights[i % 3] for i, s in enumerate(names)}
        budget, out, left = sum(sizes.values()), {}, set(names)
        while True:
            level = (budget - sum(out.values())) / sum(w[s] for s in left) if left else 0
            over = [s for s in left if level * w[s] > 3 * sizes[s]]
            if not over:
                return out | {s: level * w[s] for s in left}
            out |= {s: 3 * sizes[s] for s in over}
            left -= set(over)

    rng = random.Random(9)
    for k in range(6):
        sizes = {(None if i == 3 else f"s{i}"): rng.choice([0, 5, 100, 1000, 10**6]) + rng.randrange(3) for i in range(1 + 3 * k)}
        sizes = {s: n for s, n in sizes.items()}
        if not sum(sizes.values()):
            continue
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(want(sizes))


def mix_brute(rows, weights=(5, 2, 1)):
    """Copies of each row, by sorting every entry and adding up."""
    size = [len(SPACE.findall(t or "")) for _, t, _ in rows]
    place = [hashlib.md5(f"mix|{'' if i is None else i}|{t or ''}".encode()).hexdigest() for i, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    entries = []
    for k, name in enumerate(names):
        at, mine = 0, sorted((place[n], size[n], n) for n, r in enumerate(rows) if r[2] == name)
        total = sum(m[1] for m in mine)
        for p, z, n in mine:
            entries += [((r * total + at + z / 2) / weights[k % 3], p, z, r, n) for r in range(3) if z]
            at += z
    copies, spent = Counter(), 0
    for _, _, z, _, n in sorted(entries):
        spent += z
        if spent > sum(size):
            break
        copies[n] += 1
    return [(rows[n][0], size[n], size[n] * copies[n]) for n in range(len(rows))]


@pytest.mark.parametrize("digits", [1, 2, None])
def test_mix_is_the_truncated_queue(spark, scratch, make_docs, digits):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(0, 40)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)] + [(1000, None, "a"), (1001, "", None), (5, "x y", "e"), (5, "x y", "e"), (None, "q r s", "b"), (None, None, None)]
    docs = make_docs(rows)
    got = mixing.mix(docs, scratch, digits=digits).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter(mix_brute(rows))
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for s, rs in by.items():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs) == sum(len(SPACE.findall(t or "")) for _, t, x in rows if x == s)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 40
    again = mixing.mix(docs.repartition(7), scratch, digits=digits)
    assert Counter((r["doc_id"], r["taken"]) for r in again.collect()) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mixed_documents(spark, scratch, make_docs):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(0, 40)), rng.choice("aabc")) for i in range(300)] + [(5, "x y", "e")] * 2 + [(None, "q r s", "b")] * 3 + [(7, None, None), (None, "lone", None)]
    docs = make_docs(rows).withColumns({c: F.lit(1) for c in ("place", "copies", "rows", "times", "round", "finish", "middle", "weight", "rec", "p", "s", "target")})
    out = mixing.mixed_documents(docs, scratch)
    assert out.columns == docs.columns
    got, want = Counter((r["doc_id"], r["text"]) for r in out.collect()), Counter()
    words = {(i, t): len(SPACE.findall(t or "")) for i, t, _ in rows}
    for (i, _, taken), (_, t, _) in zip(mix_brute(rows), rows):
        want[i, t] += taken // max(1, words[i, t])
    assert got == +want
    assert mixing.mix(make_docs([]), scratch).count() == 0 == mixing.mixed_documents(make_docs([]), scratch).count()
    assert {r["taken"] for r in mixing.mix(make_docs(["", None, " "]), scratch).collect()} == {0} and mixing.mixed_documents(make_docs(["", None]), scratch).count() == 0


def test_mix_of_many_sources(spark, scratch, make_docs):
    rng = random.Random(16)
    rows = [(i, prose(rng, 1 + rng.randrange(30)), f"s{rng.randrange(60)}") for i in range(500)]
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(make_docs(rows), scratch).collect()) == Counter(mix_brute(rows))


# 7


def repeats_brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, b in enumerate(raw):
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]].append((i, k))
    gone = [bytearray(len(b)) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, k in at:
                gone[i][k : k + length] = b"\1" * length
    out = []
    for b, g in zip(raw, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_suffixes_match_brute_force(spark, scratch, make_docs, batches):
    rng = random.Random(11 + batches)
    passages = ["".join(rng.choice("abcdefghij é") for _ in range(n)) for n in (399, 400, 401, 450, 900)]
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ß") for _ in range(n))
    texts = [text(rng.randrange(0, 600)) for _ in range(10)]
    for _ in range(40):
        p = rng.choice(passages)
        a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
        p = rng.choice([p, p, p[a:b], p[:a] + "#" + p[a:]])
        texts.append(text(rng.randrange(0, 300)) + p + text(rng.randrange(0, 300)) + rng.choice(["", p]))
    texts += ["ab" * 500, "a" * 399, "a" * 400, "b" * 401, "c" * 1000, "", None] + [texts[12]] * 4
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(make_docs(texts), scratch, batches=batches).collect()}
    for i, w in enumerate(repeats_brute(texts, 400)):
        assert got[i] == w, (i, texts[i] and texts[i][:50])


def test_suffixes_edges(spark, scratch, make_docs):
    assert suffixes.remove_repeats(make_docs([]), scratch).count() == 0
    t = "".join(random.Random(12).choice("abcdefgh") for _ in range(500))
    got = suffixes.remove_repeats(make_docs([(1, t), (1, t), (1, "short"), (None, t)]), scratch, text_too=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == [(0, 500, 500, b""), (1, 5, 0, b"short"), (1, 500, 500, b""), (1, 500, 500, b"")]


def test_suffix_heads_are_ordered_like_bytes():
    rng = random.Random(31)
    raw = np.array([rng.choice([0, 97, 127, 128, 255]) for _ in range(400)], np.uint8)
    at = np.arange(385)
    by_head = sorted(at, key=lambda i, h=suffixes.heads(raw, at): (tuple(h[i]), i))
    assert by_head == sorted(at, key=lambda i: (raw[i : i + 16].tobytes(), i))


def test_suffix_index_meets_later_documents(spark, make_docs):
    rng = random.Random(32)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ß") for _ in range(n))
    passages = [text(n) for n in (390, 410, 700)]
    texts = [text(rng.randrange(0, 300)) + rng.choice(passages)[rng.randrange(20) :] + text(rng.randrange(0, 300)) for _ in range(45)]
    want = repeats_brute(texts, 400)
    # Judged among all documents up to their own part; the index is opened anew for each part.
    path, rows = None, list(enumerate(texts))
    for a, b in ((0, 15), (15, 20), (20, 45)):
        s = common.Scratch(spark, "later")
        index = suffixes.SuffixIndex(s, lasting=True) if path is None else suffixes.SuffixIndex.open(path, s)
        part = suffixes.remove_repeats(make_docs(rows[a:b]), s, batches=2, index=index, earlier=make_docs(rows[:a]))
        got = {r["doc_id"]: tuple(r)[1:] for r in part.collect()}
        assert got == dict(enumerate(repeats_brute(texts[:b], 400)[a:b], a))
        path = index.save()
        levels = spark.read.parquet(path).collect()
        assert sum(2 ** r["level"] for r in levels) == {15: 2, 20: 4, 45: 6}[b]
    assert got == {i: want[i] for i in range(20, 45)}
    with pytest.raises(ValueError):
        suffixes.remove_repeats(make_docs(rows[:1]), s, index=suffixes.SuffixIndex.open(path, s), earlier=make_docs(rows))


# 8


@pytest.mark.parametrize("ranges,hot", [(1, 200), (7, 40), (40, 200), (40, 900)])
def test_shards(spark, scratch, make_docs, ranges, hot):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(0, 80)) for _ in range(300)] + ["hot text " * 10] * hot + [None, "", "é€"]
    texts += [t for t in texts[:60] for _ in range(rng.randrange(1, 12))]
    docs = make_docs([*enumerate(texts), (5, texts[5]), (None, texts[6])])
    got = sharding.shard(docs, scratch, 8, ranges).collect()
    assert len(got) == len(texts) + 2
    load, slots, homes, bytes_of = Counter(), defaultdict(list), defaultdict(set), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        text = texts[6 if r["doc_id"] is None else r["doc_id"]] or ""
        homes[text].add(r["shard"])
        bytes_of[text] += r["size"]
        raw = text.encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    share = sum(load.values()) / 8
    assert set(load) == set(range(8))
    # A small group or a document may hang over.
    assert max(load.values()) - min(load.values()) <= 2 * (max(r["size"] for r in got) + share / 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Equal texts share a shard, but for those that fill one.
    assert {t for t, h in homes.items() if len(h) > 1} <= {t for t, b in bytes_of.items() if b > share}
    again = sharding.shard(docs.repartition(5), scratch, 8, ranges).collect()
    assert Counter(again) == Counter(got)


def test_shards_of_little(spark, scratch, make_docs):
    assert sharding.shard(make_docs([]), scratch).count() == 0
    for texts in ([None], ["a"] * 3, ["a", "b", "b", None, ""]):
        got = sharding.shard(make_docs(texts), scratch).collect()
        assert len(got) == len(texts) and all(0 <= r["shard"] < 8 for r in got)


def test_large_groups_that_fit_nowhere_are_cut():
    placed, room = sharding.place_groups([(1, 50), (2, 50), (3, 50)], 200, 4)
    assert room == [0, 0, 0, 50] and len(placed) == 3
    placed, room = sharding.place_groups([(7, 150), (8, 30)], 200, 4)
    assert sum(room) == 20 and sum(p["hi"] - p["lo"] for p in placed) == 180 and sum(p["g"] == 8 for p in placed) == 1


# 9


def test_language(spark, scratch, make_docs):
    rng = random.Random(14)
    words = {"aa": "lo ma ri ta su".split(), "bb": "kre thun gral vish ong".split(), "cc": "éta çou ñir üße œil".split()}
    text = lambda k, n: " ".join("".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 3))) for _ in range(n))
    train = spark.createDataFrame([(text(k, 30), k) for k in words for _ in range(60)] + [("123", None), (None, "aa"), ("", "bb")], "text string, lang string")
    model = language.fit(train, scratch)
    texts = [text(k, 25).upper() for k in words for _ in range(10)] + [None, "", "123 !?", "é", text("cc", 5000)]
    got = {r["doc_id"]: r for r in language.predict(make_docs(texts), model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(30)] == ["aa"] * 10 + ["bb"] * 10 + ["cc"] * 10
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (30, 31, 32))
    assert got[33]["lang_pred"] in words and got[34]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit(train.limit(0), scratch)
    assert {r["lang_pred"] for r in language.predict(make_docs(texts), nothing, ["doc_id"]).collect()} == {"und"}


def test_language_filter_answers_for_all_languages():
    p = language.Parameters()
    rng = np.random.default_rng(0)
    codes = [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(70)]
    model = language.LanguageFilter([f"l{i:02}" for i in range(70)], codes, p)
    for k in (0, 63, 64, 69):
        s, total = model.scores(np.zeros(500, int), codes[k], 1)
        assert total[0] == 500 and s[0].argmax() == k and s[0, k] > 0.999 and np.delete(s[0], k).max() < 0.1


ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
sys.path.remove(sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
for key in sys.argv[3:]:
    print("ROWS", key, __spark_entry__.queries()[key](spark, "/root/testdata/sf0.001").count())
"""


def spark_home(tmp_path):
    """The installed Spark with a `work` folder, which workers of a local cluster fill, of its own."""
    home, installed = tmp_path / "spark-home", os.path.dirname(pyspark.__file__)
    (home / "work").mkdir(parents=True)
    for name in os.listdir(installed):
        if name not in ("work", "logs"):
            (home / name).symlink_to(os.path.join(installed, name))
    return str(home)


def test_executors_without_the_package(tmp_path):
    """Driver and executors work in a folder of their own, without the repository on their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    environment["SPARK_HOME"] = spark_home(tmp_path)
    keys = ["op9_language_id", "op10_url_filter"]
    got = subprocess.run([sys.executable, "-c", ELSEWHERE, root, str(tmp_path / "shared"), *keys], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    found = dict(line.split()[1:] for line in got.stdout.splitlines() if line.startswith("ROWS"))
    assert set(found) == set(keys) and int(found["op9_language_id"]) == 200, got.stderr[-3000:]


def test_held_out(spark):
    rows = spark.range(50).toDF("doc_id").select("doc_id", language.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# 10


def test_urls(spark, scratch):
    good = [(i, f"https://site{chr(97 + i % 20)}.example.com/en/{i}") for i in range(200)]
    bad = [(200 + i, f"https://cheap-pills{chr(97 + i % 20)}.win-big.example.com/en/{i}") for i in range(40)]
    odd = [(500, None), (501, "no scheme"), (502, "x://A.Net"), (503, "x://a.net/"), (504, "x://Example.NET/en/1?q"), (505, "x://badexample.net/en/"), (506, "x://w.org/fr/#f"), (507, "x://w.org/fr"),
           (508, "x://big.win.example.org/en/"), (509, "HTTP://U@EXAMPLE.com/de/x"), (510, "x://example.com/de/x"), (511, "x://a://b/c"), (512, "x://a?://b"), (504, "x://Example.NET/en/1?q"), (513, "x://ÄB.net\n/")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in good + bad + odd], "page_id long, url string, html string, block int")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad[:30]], "doc_id long, quality int, toxic int")
    rows = urls.judge(pages, labels, scratch).collect()
    assert len(rows) == len(good + bad + odd)
    got = {r["page_id"]: tuple(r)[1:5] for r in rows}
    assert all(got[i][3] == "allow" for i, _ in good) and all(got[i][3] == "block" for i, _ in bad)
    assert got[500] == got[501] == ("", "", None, "allow")
    assert got[502] == ("a.net", "", None, "allow")
    assert got[503] == ("a.net", "/", "net/", "block")
    assert got[504] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[505] == ("badexample.net", "/en/", "net/", "block")
    assert got[506] == ("w.org", "/fr/", "org/fr/", "allow")
    assert got[507][:3] == ("w.org", "/fr", None)
    assert got[508][3] == "block"
    assert got[510] == ("example.com", "/de/x", "example.com/de/", "block")
    assert got[511][:2] == ("a:", "//b/c") and got[512][:2] == ("a", "")
    assert urls.judge(pages.limit(0), labels, scratch).count() == 0
    assert {r["verdict"] for r in urls.judge(pages.where("page_id < 200"), labels.limit(0), scratch).collect()} == {"allow"}


def rules_brute(rows, p):
    """Every set of up to three tokens that is a rule, by counting all sets."""
    n, blocks, hits, fits = len(rows), sum(b for _, b in rows), Counter(), Counter()
    for tokens, block in rows:
        for k in (1, 2, 3):
            for s in itertools.combinations(sorted(tokens), k):
                fits[s] += 1
                hits[s] += block
    found = {}
    for s in fits:
        x, m = hits[s] / fits[s], fits[s]
        z = 1.645
        sure = (x + z * z / (2 * m) - z * math.sqrt(x * (1 - x) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if hits[s] >= max(p.min_support * n, p.min_rows) and sure >= p.min_confidence and x * n / blocks >= p.min_lift:
            found[s] = x
    return found


def test_mined_rules_match_brute_force(spark, scratch):
    rng = random.Random(22)
    rows = []
    for _ in range(400):
        tokens = {f"t{rng.randrange(9)}" for _ in range(rng.randrange(1, 5))}
        if rng.random() < 0.3:
            tokens |= {"twin1", "twin2"}
        # Only the pair marks a page.
        rows.append((sorted(tokens), {"t1", "t2"} <= tokens or {"twin1", "t5"} <= tokens or rng.random() < 0.08))
    p = urls.RuleParameters(min_support=0.01)
    mined, item_of = urls.mine(spark.createDataFrame(rows, "tokens array<string>, block boolean"), scratch, p)
    got = {tuple(r["antecedent"]): r["confidence"] for r in mined.collect()}
    assert item_of["twin2"] == item_of["twin1"] == "twin1" and got
    want = rules_brute(rows, p)
    for tokens, _ in rows:
        rules = [want[s] for k in (1, 2, 3) for s in itertools.combinations(tokens, k) if s in want]
        own = {item_of[t] for t in tokens if t in item_of}
        fits = [c for s, c in got.items() if set(s) <= own]
        assert max(fits, default=None) == pytest.approx(max(rules, default=None))
    assert all(want[s] == pytest.approx(c) for s, c in got.items())


def test_one_url_of_many_tokens(spark, scratch):
    """An URL that repeats with 60 tokens is one item, not 2**60 sets."""
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04}")
    bad = "https://a.example.com/en/" + "/".join(word(i) for i in range(60))
    pages = spark.createDataFrame([(i, bad) for i in range(30)] + [(100 + i, f"https://b.example.com/en/{word(500 + i)}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i in [*range(20), *range(100, 300)]], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, scratch).collect()}
    assert all((v == "block") == (i < 30) for i, v in got.items()) and len(got) == 230
