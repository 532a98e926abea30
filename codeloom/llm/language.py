"""Language identification with language-bitmask n-gram filters (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UNKNOWN = "und"


@dataclass(frozen=True)
class Parameters:
    #: Characters of an n-gram; words are padded with one space on each side.
    n: int = 4
    #: An n-gram belongs to a language if this share of its documents has it ...
    min_share: float = 0.004
    #: ... and this share of the n-gram's share over all languages.
    min_purity: float = 0.15
    #: Hash functions of the Bloom filter, and bits per n-gram.
    hashes: int = 4
    bits: int = 16


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


_LETTER = None


def letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0."""
    global _LETTER
    if _LETTER is None:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low[0])  # some have more than one letter
        _LETTER = table
    return _LETTER


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as (text number, 64-bit n-gram), sorted by text.

    Runs of letters are lower-cased and padded; everything else is a gap.
    """
    table = letters()
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))[: len(joined)]
    low = table[joined]
    keep = (low != 0) | np.concatenate([[True], low[:-1] != 0])[: len(low)]  # letters, and the first gap after each run
    low = np.concatenate([[0], low[keep], np.zeros(n, np.uint32)]).astype(np.uint64)
    owner = owner[keep]
    m = len(owner)
    code, ok = np.zeros(m, np.uint64), np.ones(m, bool)
    with np.errstate(over="ignore"):
        for i in range(n):
            part = low[i : i + m]
            code = code * np.uint64(0x100000001B3) + part
            if 0 < i < n - 1:
                ok &= part != 0
    code, owner = code[ok], owner[ok]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    each = [np.unique(code[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return np.repeat(np.arange(len(texts)), [len(x) for x in each]), np.concatenate([np.zeros(0, np.uint64), *each])


class LanguageFilter:
    """A bit-sliced Bloom filter: a slot holds one bit for each language, so one lookup answers for all of them."""

    def __init__(self, languages: list[str], fill_codes: list[np.ndarray], p: Parameters):
        self.languages, self.p = languages, p
        size = 64
        while size < p.bits * max([1, *map(len, fill_codes)]):
            size *= 2
        self.mask = np.uint64(size - 1)
        self.words = -(-max(1, len(languages)) // 64)
        self.slots = np.zeros((self.words, size), np.uint64)
        for k, codes in enumerate(fill_codes):
            for seed in range(p.hashes):
                at = (mix64(codes, seed + 2) & self.mask).astype(np.int64)
                np.bitwise_or.at(self.slots[k // 64], at, np.uint64(1) << np.uint64(k % 64))
        #: Chance that an n-gram in no language passes for one of language k.
        self.false = np.array([self._filled(k) ** p.hashes for k in range(len(languages))])

    def state(self) -> dict:
        """What a filter consists of, in plain values: they can be broadcast to executors that lack this package."""
        return {**vars(self), "p": vars(self.p)}

    @classmethod
    def from_state(cls, state: dict) -> LanguageFilter:
        made = cls.__new__(cls)
        vars(made).update(state, p=Parameters(**state["p"]))
        return made

    def _filled(self, k: int) -> float:
        return float(((self.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean())

    def scores(self, owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's n-grams in each language, corrected for false positives; and the number of n-grams."""
        total = np.bincount(owner, minlength=n).astype(float)
        out = np.zeros((n, len(self.languages)))
        at = [(mix64(code, seed + 2) & self.mask).astype(np.int64) for seed in range(self.p.hashes)]
        for w in range(self.words):
            found = self.slots[w][at[0]]
            for a in at[1:]:
                found &= self.slots[w][a]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = (found >> np.uint64(k % 64)) & np.uint64(1)
                hits = np.bincount(owner, weights=bit.astype(float), minlength=n)
                out[:, k] = (hits - self.false[k] * total) / np.maximum(1e-9, (1 - self.false[k]) * np.maximum(total, 1))
        return np.clip(out, 0, 1), total


def fit(train: DataFrame, scratch: Scratch, p: Parameters = Parameters()) -> LanguageFilter:
    """Learn the filters from all rows (text, lang) with a language.

    Document counts of every n-gram by language come from all rows, summed in
    each task before they shuffle.  Only n-grams in `min_share` of a
    language's documents stay: at most (n-grams of a document) / min_share
    per language, whatever the corpus, so the filter fits everywhere.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = {}, 0

        def drain():
            for lang, parts in held.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "docs": n})

        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for i in range(0, len(part), 200):
                    _, code = grams(list(part["text"].iloc[i : i + 200]), p.n)
                    held.setdefault(lang, []).append(code)
                    rows += len(code)
                    if rows > 6_000_000:
                        yield from drain()
                        held, rows = {}, 0
        yield from drain()

    train = train.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    counts = train.mapInPandas(count, "lang string, code long, docs long").groupBy("lang", "code").agg(F.sum("docs").alias("docs"))
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], [], p)
    size = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, float(sizes[k]))]), F.col("lang"))
    shares = scratch.save(counts.withColumn("share", F.col("docs") / size).where(f"share >= {p.min_share} and docs >= 2 or share >= 0.05"), "shares")
    total = shares.groupBy("code").agg(F.sum("share").alias("all"))
    kept = shares.join(total, "code").where(f"share >= {p.min_purity} * all").select("lang", "code").toPandas()
    codes = {k: v["code"].to_numpy().view(np.uint64) for k, v in kept.groupby("lang")}
    return LanguageFilter(languages, [codes.get(k, np.zeros(0, np.uint64)) for k in languages], p)


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str]) -> DataFrame:
    """lang_pred and score for every row, beside the columns `keep`.

    A text's language is the one whose filter holds the largest corrected
    share of its distinct n-grams; `score` is that share, relative to the sum
    over languages.  Ties go to the first in order of name.  Null texts and
    texts without a letter: `und`, 0.  Letters but no n-gram, or no language
    learned: the first language (or `und`), 0.  Repeated rows are judged one
    by one, an empty table gives no rows, and whole texts count.
    """
    holder = docs.sparkSession.sparkContext.broadcast(model.state())
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", lang_pred string, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = LanguageFilter.from_state(holder.value)
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i : i + 200]
                texts = [t or "" for t in part["_text"]]
                has = np.array([any(c.isalpha() for c in t) for t in texts], bool)
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                if m.languages:
                    owner, code = grams(texts, m.p.n)
                    s, _ = m.scores(owner, code, len(texts))
                    best = s.argmax(1)
                    top = s[np.arange(len(texts)), best]
                    score = np.where(top > 0, top / np.maximum(s.sum(1), 1e-12), 0.0)
                names = [m.languages[b] if h and m.languages else UNKNOWN for b, h in zip(best, has)]
                yield part[keep].assign(lang_pred=names, score=np.where(has, score, 0.0))

    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
