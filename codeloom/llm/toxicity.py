"""Toxicity by a fuzzy lexicon and context windows (operator 4)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_process


@dataclass(frozen=True)
class Parameters:
    #: A lexicon word is in at least this share of toxic documents and this many ...
    min_share: float = 0.01
    min_docs: int = 4
    #: ... and a document with it is toxic with at least this probability (a lower bound).
    min_precision: float = 0.8
    #: Words from this length on match within one edit.
    fuzzy_from: int = 5
    #: Words on each side of a hit that are its context.
    window: int = 6
    #: Shortest and longest stem.
    stem_from: int = 5
    stem_to: int = 8
    #: Clean documents in which a word must stand near a term to be a cue that it is only spoken about.
    cue_docs: int = 10
    #: About how many labelled documents a model is fitted on at most, chosen by a hash of the id where there are more.
    most_labels: int = 200_000
    #: Most words a worker remembers the match of.
    remembered: int = 150_000


#: Quotation marks.
QUOTES = "\"'“”„«»"
#: Behind a stem in the lexicon: any word that goes on after it matches.
STEM = "*"


class Lexicon:
    """A trie of terms, walked in step with the Levenshtein automaton of each word looked up.

    A state is the set of (trie node, edits so far); states and their steps
    are made when first needed and kept, so most words die after two or three
    characters.  A term that ends in STEM matches every longer word, without
    edits.
    """

    def __init__(self, terms: list[str], fuzzy_from: int, exact_only: frozenset[str] = frozenset()):
        self.fuzzy_from, self.exact_only = fuzzy_from, exact_only
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        for t in terms:
            at = 0
            for c in t.removesuffix(STEM):
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.stem.append(None)
                at = self.child[at][c]
            (self.stem if t.endswith(STEM) else self.term)[at] = t
        self.names: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.stem_at: list[str | None] = []
        self.start = self._state({(0, 0)})

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the deletions that an edit allows: a term's character is missing from the word."""
        best: dict[int, int] = {}
        for node, e in pairs:
            best[node] = min(e, best.get(node, 9))
            if e == 0:
                for k in self.child[node].values():
                    best[k] = min(1, best.get(k, 9))
        return frozenset(best.items())

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        s = self._closed(pairs)
        if s not in self.names:
            self.names[s] = len(self.states)
            self.states.append(s)
            self.steps.append({})
            self.stem_at.append(next((self.stem[node] for node, e in s if e == 0 and self.stem[node]), None))
        return self.names[s]

    def _step(self, state: int, c: str) -> int:
        nxt: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if c in self.child[node]:
                nxt.add((self.child[node][c], e))
            if e == 0:
                nxt.add((node, 1))  # an extra character
                nxt.update((k, 1) for x, k in self.child[node].items() if x != c)
        self.steps[state][c] = to = self._state(nxt) if nxt else -1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits (0 or 1), or None; of equals the first in order, and the shortest stem."""
        at, stem = self.start, None
        for c in word:
            stem = stem or self.stem_at[at]
            to = self.steps[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                return (stem, 0) if stem else None
        found = [(e, t) for node, e in self.states[at] if (t := self.term[node]) and (e == 0 or len(t) >= self.fuzzy_from and len(word) >= self.fuzzy_from - 1 and t not in self.exact_only)]
        best = min(found)[::-1] if found else None
        return (stem, 0) if stem and (best is None or best[1]) else best


STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> set[str]:
    return {STRIP.sub("", w) for w in set(text.lower().split())} - {""}


#: What a document is judged by: its surest plain hit, whether all plain hits have an edit, how many plain hits, its surest quoted hit, how many quoted.
FEATURES = ("sure", "edited", "plain", "sure_quoted", "quoted")


@dataclass
class Model:
    #: Terms, and for each how much a document with it is likelier toxic than not (log odds).
    terms: list[str]
    odds: list[float]
    #: Of a logistic model: constant, then one for each of FEATURES.
    weights: list[float]
    p: Parameters
    #: Ordinary words within one edit of a term.
    ordinary: frozenset[str] = frozenset()
    #: Terms that have too many neighbours among ordinary words.
    exact_only: frozenset[str] = frozenset()
    #: Words that stand near terms where these are spoken about.
    cues: frozenset[str] = frozenset()

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.p.fuzzy_from, self.exact_only)

    def match(self, word: str, lexicon: Lexicon) -> tuple[str, int] | None:
        w = STRIP.sub("", word)
        return None if w in self.ordinary else lexicon.match(w)

    def features(self, text: str, lexicon: Lexicon, known: dict, odds: dict[str, float]) -> tuple[float, ...]:
        """FEATURES of a text; hits are plain or, by their context, quoted."""
        words = text.lower().split()
        found = {}
        for w in set(words):
            if w not in known:
                if len(known) >= self.p.remembered:
                    known.clear()
                known[w] = self.match(w, lexicon)
            if known[w]:
                found[w] = known[w]
        sure = sure_quoted = 0.0
        plain = edited = quoted = 0
        if found:
            for i, w in enumerate(words):
                if w in found:
                    term, edits = found[w]
                    if self.is_quoted(words, i):
                        quoted += 1
                        sure_quoted = max(sure_quoted, odds[term])
                    else:
                        plain += 1
                        edited += edits
                        sure = max(sure, odds[term])
        return sure, int(plain > 0 and edited == plain), plain, sure_quoted, quoted

    def is_quoted(self, words: list[str], i: int) -> bool:
        """Whether a pair of quotation marks is round the word, or a cue close by."""
        near = words[max(0, i - self.p.window) : i + self.p.window + 1]
        at = min(i, self.p.window)
        before = any(x[0] in QUOTES for x in near[: at + 1])
        after = any(x.rstrip(".,;:!?")[-1:] in QUOTES and x.rstrip(".,;:!?") for x in near[at:])
        return before and after or bool(self.cues) and any(STRIP.sub("", x) in self.cues for x in near)

    def score(self, features: tuple[float, ...]) -> float:
        if not self.terms:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], scaled(features)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scaled(features: tuple[float, ...]) -> tuple[float, ...]:
    """Counts of hits on a logarithmic scale."""
    sure, edited, plain, sure_quoted, quoted = features
    return sure, edited, math.log2(1 + plain), sure_quoted, math.log2(1 + quoted)


def logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights that fit counts of bad and good rows with features x best, by Newton's steps; constant first, and below zero only that and `edited`."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    keep = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (bad - (good + bad) * p) - penalty @ w
            hessian = (x * ((good + bad) * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
            step = np.zeros_like(w)
            step[keep] = np.linalg.solve(hessian[np.ix_(keep, keep)], gradient[keep])
            w += step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-8:
                break
        below = keep & (w < 0)
        below[[0, 1 + FEATURES.index("edited")]] = False
        if not below.any():
            return w
        keep &= ~below


def training_rows(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(text, toxic) of the documents that labels (doc_id, toxic) covers.

    Every document has at most one label of each kind, so that the labels
    broadcast are about `most_labels` at most; texts stay where they are read.
    Null ids and labels are left out, and labels without a document.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    n = known.count()
    if n > p.most_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil(p.most_labels / n * (1 << 20))))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def wilson(k: int, n: int, z: float = 1.28) -> float:
    """Lower bound of a share of which k of n were seen."""
    x = k / n
    return (x + z * z / (2 * n) - z * math.sqrt(x * (1 - x) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn_lexicon(train: DataFrame, scratch: Scratch, p: Parameters) -> dict[str, float]:
    """Words and stems that mark toxic documents, with their log odds, from rows (text, toxic 0/1): all rows are counted, in each task before the shuffle.

    A stem gathers the longer words that begin with it, and stands for them
    where it is met clearly more often than any of them.  At most (words of a
    document) / min_share words can reach the share, and a few times as many
    stems, so the lexicon fits anywhere.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def drain():
            for toxic, c in held.items():
                if c:
                    yield pd.DataFrame({"word": list(c), "toxic": toxic, "docs": list(c.values())})
                c.clear()

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                held[int(toxic)].update(words_of(text))
            if sum(map(len, held.values())) > 500_000:
                yield from drain()
        yield from drain()

    n = train.where("toxic = 1").count()
    counts = train.mapInPandas(count, "word string, toxic int, docs long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("good")
    )
    counts = scratch.save(counts, "words")
    least = max(p.min_docs, p.min_share * n)
    words = {r["word"]: (r["bad"], r["good"]) for r in counts.where((F.col("bad") >= least) & (F.length("word") >= 3)).collect()}
    words = {w: c for w, c in words.items() if wilson(c[0], sum(c)) >= p.min_precision}
    lengths = F.sequence(F.lit(p.stem_from), F.least(F.lit(p.stem_to), F.length("word") - 1))
    longer = counts.where(F.length("word") > p.stem_from).select(F.explode(F.transform(lengths, lambda k: F.substr("word", F.lit(1), k))).alias("stem"), "bad", "good")
    stems = longer.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("bad").alias("top"))
    stems = stems.where((F.col("bad") >= 2 * least) & (F.col("bad") >= 2 * F.col("top")) & (F.col("bad") >= p.min_precision * (F.col("bad") + F.col("good"))))
    chosen: dict[str, tuple[int, int]] = {}
    # The surest first, with caution, and of equals the longest; one inside another tells nothing new.
    for r in sorted(stems.collect(), key=lambda r: (-wilson(r["bad"], r["bad"] + r["good"], 3.0), -len(r["stem"]), r["stem"])):
        if wilson(r["bad"], r["bad"] + r["good"]) >= p.min_precision and not any(r["stem"].startswith(x[:-1]) or x.startswith(r["stem"]) for x in chosen):
            chosen[r["stem"] + STEM] = (r["bad"], r["good"])
    words = {w: c for w, c in words.items() if not any(w.startswith(x[:-1]) and len(w) >= len(x) for x in chosen)}
    return {t: math.log((bad + 0.5) / (good + 0.5)) for t, (bad, good) in sorted({**words, **chosen}.items())}


def learn_contexts(train: DataFrame, terms: list[str], p: Parameters) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """What only looks like a term, or is only spoken about: ordinary words, terms whose neighbours mark nothing, and cues.

    From documents without an exact hit: words within one edit of a term that
    are at home in clean documents are ordinary, and a term whose other
    neighbours, rare ones, are mostly in clean documents matches exactly
    only.  From documents with one: words close to a hit that are mostly in
    clean documents are cues.  There are at most as many neighbours as
    strings within one edit of a term, and cues must reach `cue_docs`.
    """

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, known = Lexicon(terms, p.fuzzy_from), {}
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = {}
                for w in words_of(text):
                    if w not in known:
                        if len(known) >= p.remembered:
                            known.clear()
                        known[w] = lexicon.match(w)
                    if known[w]:
                        found[w] = known[w]
                if all(e for _, e in found.values()):
                    out += [(t, w, int(toxic)) for w, (t, _) in found.items()]
                else:
                    words = [STRIP.sub("", w) for w in text.lower().split()]
                    near = {x for i, w in enumerate(words) if w in found and not found[w][1] for x in words[max(0, i - p.window) : i + p.window + 1]}
                    out += [("", w, int(toxic)) for w in near - found.keys() - {""}]
            yield pd.DataFrame(out, columns=["term", "word", "toxic"])

    counts = train.mapInPandas(forms, "term string, word string, toxic int").groupBy("term", "word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    counts = counts.where((F.col("term") != "") | (F.col("n") - F.col("bad") >= p.cue_docs) & (F.col("bad") < 0.2 * F.col("n"))).collect()
    cues = frozenset(r["word"] for r in counts if not r["term"] and wilson(r["n"] - r["bad"], r["n"]) >= 0.8)
    ordinary = frozenset(r["word"] for r in counts if r["term"] and r["n"] - r["bad"] >= 3 and r["bad"] < 0.5 * r["n"])
    by_term: dict[str, list[int]] = {}
    for r in counts:
        if r["term"] and r["word"] not in ordinary:
            x = by_term.setdefault(r["term"], [0, 0])
            x[0] += r["bad"]
            x[1] += r["n"]
    return ordinary, frozenset(t for t, (bad, n) in by_term.items() if bad < 0.7 * n), cues


def fit(train: DataFrame, scratch: Scratch, p: Parameters = Parameters()) -> Model:
    """Lexicon, contexts and weights, from all labelled rows (text, toxic).

    No rows, one class only or no word that tells them apart: everything scores 0.
    """
    # Copies of a text tell no more than one of them.
    train = train.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    train = scratch.save(train.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")).drop("h"), "distinct")
    odds = learn_lexicon(train, scratch, p)
    if not odds:
        return Model([], [], [0.0] * (1 + len(FEATURES)), p)
    terms = list(odds)
    model = Model(terms, list(odds.values()), [0.0] * (1 + len(FEATURES)), p, *learn_contexts(train, terms, p))
    seen = train.select("toxic", judged(model, F.col("text")).alias("j"))
    # A row for each combination of features: of labelled documents there are some `most_labels` at most, and most have no hit.
    rows = seen.groupBy(*[F.col(f"j.{f}").alias(f) for f in FEATURES]).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()
    x = np.array([scaled(tuple(r[f] for f in FEATURES)) for r in rows])
    bad, n = np.array([r["bad"] for r in rows], float), np.array([r["n"] for r in rows], float)
    model.weights = logistic(x, n - bad, bad).tolist()
    return model


JUDGED = "sure double, edited int, plain int, sure_quoted double, quoted int, score double"


def judged(model: Model, text: Column) -> Column:
    """Features and score of a text as a struct (JUDGED); only the text goes to Python, whatever else a row has."""
    key = "|".join(model.terms) + repr((model.p, model.odds, model.weights)) + "|".join(sorted(model.ordinary)) + "|".join(sorted(model.exact_only)) + "|".join(sorted(model.cues))

    @F.pandas_udf(JUDGED)
    def run(texts: pd.Series) -> pd.DataFrame:
        lexicon, known, odds = per_process("toxicity", key, lambda: (model.lexicon(), {}, dict(zip(model.terms, model.odds))))
        got = [model.features(t, lexicon, known, odds) if t else (0.0, 0, 0, 0.0, 0) for t in texts]
        return pd.DataFrame([(*f, model.score(f)) for f in got], columns=[*FEATURES, "score"])

    return run(text)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` with plain_hits, quoted_hits and score of every row.

    Null, empty and wordless texts have no hit, and the score of a text
    without one.  Whole texts are read, however long, and a repeated row gets
    the same score again.  Empty table: no rows.  Extra columns are ignored;
    of `keep`, columns named like a result give way to it.
    """
    rest = [c for c in keep if c not in ("plain_hits", "quoted_hits", "score")]
    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in rest]).alias("kept"), judged(model, docs["text"]).alias("judged"))
    j = F.col("judged")
    return found.select(*[F.col("kept").getField(c).alias(c) for c in rest], j["plain"].alias("plain_hits"), j["quoted"].alias("quoted_hits"), j["score"].alias("score"))
