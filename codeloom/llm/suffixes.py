"""Removal of long repeated passages with a logarithmic family of suffix arrays (operator 7).

Every window of `length` bytes is filed under one of its suffix starts, its
anchor: the first place in the window where the hash of the next SEED bytes
is least.  Equal windows have equal anchors, so a suffix array over anchors
alone (one place in 120) finds every repeat.  Anchors are sorted by the first
sixteen bytes of their suffix, then by the fingerprint of its first SEED
bytes, and under each by the fingerprint of their whole context, the bytes of
all windows filed there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Scratch
from .hashing import Rolling, mix

#: Bytes of a suffix that an anchor's fingerprint covers.
SEED = 160

#: What orders suffixes: two longs of eight bytes each, and the fingerprint.
KEY = ["head_a", "head_b", "seed"]

#: Bits of a place in a text; the bits of the hash above them decide first.
PLACE = 31


def sliding_argmin(rank: np.ndarray, w: int) -> np.ndarray:
    """For every w neighbours, the place of the first with the least upper bits."""
    n = len(rank) - w + 1
    blocks = -(-len(rank) // w)
    x = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    x[: len(rank)] = rank >> np.uint64(PLACE) << np.uint64(PLACE) | np.arange(len(rank), dtype=np.uint64)
    x = x.reshape(blocks, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def heads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sixteen bytes from each place on, as two longs that are ordered like the bytes."""
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 16)[at])
    return (first.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def anchors_of(text: bytes, length: int) -> pd.DataFrame:
    """Anchors of a text: head, seed and context fingerprints, and the first and last window filed under each."""
    if len(text) < length:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in [*KEY, "context", "first", "last"]})
    raw = np.frombuffer(text, np.uint8)
    r = Rolling(raw)
    rank = mix(r.windows(SEED), 3)
    at = sliding_argmin(rank, length - SEED + 1)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(at)]]) - 1
    head = heads(raw, at[first])
    return pd.DataFrame({"head_a": head[:, 0], "head_b": head[:, 1], "seed": rank[at[first]].view(np.int64), "context": r.of(first, last + length).view(np.int64), "first": first, "last": last})


def anchors(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """One row for each anchor of each document: doc, KEY, context, first, last, batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for doc, text in zip(batch["doc"], batch["text"]):
                found = anchors_of(text.encode(), length)
                if len(found):
                    found.insert(0, "doc", doc)
                    out.append(found)
            if out:
                yield pd.concat(out)

    found = docs.select("doc", "text").mapInPandas(run, "doc long, head_a long, head_b long, seed long, context long, first int, last int")
    return found.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))


def summed(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*KEY, "context").agg(F.sum("n").alias("n"), F.min("at").alias("at"))


class SuffixIndex:
    """Suffix arrays over anchors; level k stands for 2**k batches.

    An entry is a distinct (KEY, context) with how often it was seen and one
    place of it; a level is a table of entries in the order of their suffixes.
    `add` sorts a batch into a level 0, scans it against every level, and then
    merges equal levels as a binary counter carries, so each entry is merged a
    logarithmic number of times.

    A `lasting` index outlives its call: `save` names its tables in one more
    table and then deletes those it has replaced, and `open` goes on from there.
    """

    def __init__(self, scratch: Scratch, levels: dict[int, DataFrame] | None = None, lasting: bool = False):
        self.scratch = scratch
        self.levels = dict(levels or {})
        self.lasting = lasting
        self.replaced: list[DataFrame] = []
        #: Keys that are shared by different entries, a table for each scan.
        self.shared: list[DataFrame] = []

    @classmethod
    def open(cls, path: str, scratch: Scratch) -> SuffixIndex:
        """The lasting index that `save` wrote to `path`."""
        levels = {}
        # A row for each level: the logarithm of the number of batches.
        for r in scratch.spark.read.parquet(path).collect():
            levels[r["level"]] = scratch.spark.read.parquet(r["path"])
            levels[r["level"]].codeloom_path = r["path"]
        return cls(scratch, levels, lasting=True)

    def save(self) -> str:
        rows = [(k, level.codeloom_path) for k, level in self.levels.items()]
        path = self.scratch.save(self.scratch.spark.createDataFrame(rows, "level int, path string"), "family").codeloom_path
        self.scratch.drop(*self.replaced)
        self.replaced = []
        return path

    def add(self, batch: DataFrame) -> None:
        new = batch.groupBy(*KEY, "context").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last")).alias("at"))
        new = self.scratch.save(new.orderBy(*KEY, "context"), "level-0")
        self._scan(new)
        k = 0
        while k in self.levels:
            old = self.levels.pop(k)
            k += 1
            merged = self.scratch.save(summed(old.unionByName(new)).orderBy(*KEY, "context"), f"level-{k}")
            if self.lasting:
                self.replaced += [old, new]
            else:
                self.scratch.drop(old, new)
            new = merged
        self.levels[k] = new

    def _scan(self, new: DataFrame) -> None:
        """Keys under which the new entries meet different ones, in their own batch or in a level: suffixes with SEED bytes in common, whose contexts differ."""
        sides = [level.groupBy(*KEY).agg(F.min("context").alias("a"), F.max("context").alias("b")) for level in (new, *self.levels.values())]
        found = sides[0].where("a <> b").select(*KEY)
        for old in sides[1:]:
            met = sides[0].join(old.withColumnsRenamed({"a": "c", "b": "d"}), KEY).where("least(a, c) <> greatest(b, d)")
            found = found.unionByName(met.select(*KEY))
        self.shared.append(self.scratch.save(found, "shared"))

    def entries(self) -> DataFrame:
        """All entries with their total counts: the level, if there is but one, else a new table."""
        levels = list(self.levels.values())
        if len(levels) == 1:
            return levels[0]
        both = levels[0]
        for x in levels[1:]:
            both = both.unionByName(x)
        return self.scratch.save(summed(both), "entries")

    def mixed_keys(self) -> DataFrame:
        both = self.shared[0]
        for x in self.shared[1:]:
            both = both.unionByName(x)
        return both.distinct()


def repeated_windows(ranges: DataFrame, docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """Which windows of the ranges (doc, first, last, n) repeat elsewhere in them: (doc, first, last) of maximal runs.

    All windows of the ranges are fingerprinted in the task that holds the
    text and counted by `blocks`, for which no passage is hot.
    """
    per_doc = ranges.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    total = ranges.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    held = docs.join(per_doc, "doc").select("doc", "text", "ranges")

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fps, places, n = [], [], 0

        def block():
            # Two places in one document are two owners.
            every = np.concatenate(fps)
            row = blocks.pack(every, np.arange(n))
            row["idx"] = np.searchsorted(np.frombuffer(row["vals"], "<u8"), every).astype("<i4").tobytes()
            return pd.DataFrame({"block": [uuid.uuid4().hex], "places": [np.array(places, "<i8").tobytes()], **{k: [v] for k, v in row.items()}})

        for batch in it:
            for d, text, rs in zip(batch["doc"], batch["text"], batch["ranges"]):
                r = Rolling(np.frombuffer(text.encode(), np.uint8))
                for x in rs:
                    s = np.arange(x["first"], x["last"] + 1)
                    fps.append(r.of(s, s + length))
                    places.append((d, x["first"], len(s)))
                    n += len(s)
                if n >= blocks.BLOCK_VALUES:
                    yield block()
                    fps, places, n = [], [], 0
        if n:
            yield block()

    table = scratch.save(held.mapInPandas(pack, "block string, places binary, vals binary, twice binary, idx binary"), "blocks")
    scratch.drop()

    def runs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for idx, places, answers in zip(batch["idx"], batch["places"], batch["answers"]):
                hit = blocks.joined(answers)[np.frombuffer(idx, "<i4")] > 0
                d, first, n = np.frombuffer(places, "<i8").reshape(-1, 3).T
                doc = np.repeat(d, n)[hit]
                at = (np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n))[hit]
                if not len(doc):
                    continue
                order = np.lexsort((at, doc))
                doc, at = doc[order], at[order]
                begin = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
                end = np.concatenate([begin[1:], [True]])
                yield pd.DataFrame({"doc": doc[begin], "first": at[begin], "last": at[end]})

    answered = table.select("block", "idx", "places").join(blocks.by_block(blocks.levels(table, total, "<u8")), "block")
    found = scratch.save(answered.select("idx", "places", "answers").mapInPandas(runs, "doc long, first int, last int"), "runs")
    scratch.drop(table)
    return found


def repeats(docs: DataFrame, scratch: Scratch, length: int = 400, batches: int = 4, index: SuffixIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Windows of `length` bytes that start anywhere else too: runs (doc, first, last) of their starts.

    docs has (doc, text): doc unique, text not null.  They are added to
    `index`; `earlier` has the documents it holds already, whose windows count
    too, but whose own runs are not returned.
    """
    found = scratch.save(anchors(docs, length, batches), "anchors", partition_by="batch")
    index = index or SuffixIndex(scratch)
    for b in range(batches):
        index.add(found.where(F.col("batch") == b).drop("batch"))
    entries = index.entries()
    # Different contexts under one key: one of each is compared window by window.
    mixed = scratch.save(entries.join(index.mixed_keys(), KEY).select("at.doc", "at.first", "at.last", "n"), "mixed")
    # A context seen twice: all its windows repeat.
    twice = scratch.save(entries.where("n > 1").select(*KEY, "context"), "twice")
    whole = scratch.save(found.join(twice, [*KEY, "context"]).select("doc", "first", "last"), "whole")
    scratch.drop(found, twice, *index.shared)
    index.shared = []
    if not index.lasting:
        scratch.drop(*index.levels.values())
    if len(index.levels) > 1:
        scratch.drop(entries)
    if earlier is None:
        return whole.unionByName(repeated_windows(mixed, docs, scratch, length))
    runs = repeated_windows(mixed, docs.unionByName(earlier), scratch, length)
    return whole.unionByName(runs.join(docs.select("doc"), "doc", "left_semi"))


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = 400, batches: int = 4, text_too: bool = False, index: SuffixIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row,
    and with `text_too` the bytes that are left as `kept`.  Strings are judged
    on the input; overlaps, the same document and repeated rows count;
    matches never cross documents.

    Later documents: with a lasting `index`, docs are sorted and merged into
    its levels, and strings of `earlier`, all documents that it holds, count
    as elsewhere.  Rows are for docs only; what was decided before stays.
    Neither then may repeat a doc_id or lack one (ValueError).

    Null text is empty; a text shorter than `length` loses nothing.  Rows
    that repeat a doc_id are documents of their own.  Empty table: no rows.
    Extra columns are ignored.
    """
    # A key of its own for each row, written down so that it never changes.
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = None if earlier is None else earlier.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    ids = d.select(F.col("doc_id").cast("long").alias("doc"))
    ids = ids if old is None else ids.unionByName(old.select("doc"))
    several = ids.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null")
    if several.isEmpty():
        d = d.withColumn("doc", F.col("doc_id").cast("long"))
    elif index is not None:
        raise ValueError("documents of an index need ids that are theirs alone")
    else:
        d = scratch.save(d.withColumn("doc", F.monotonically_increasing_id()), "rows")
    spans = repeats(d.select("doc", "text"), scratch, length, batches, index, old)
    per_doc = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    per_doc = scratch.save(per_doc, "spans")
    scratch.drop()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for doc_id, text, rs in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = text.encode()
                kept, at, removed, n = [], 0, 0, 0
                for x in [] if rs is None else rs:
                    a, b = max(at, int(x["first"])), int(x["last"]) + length
                    if a > at or not n:
                        n += 1
                        kept.append(raw[at:a])
                    if b > a:
                        removed += b - a
                        at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc_id, len(raw), removed, n, hashlib.sha256(left).hexdigest(), left if text_too else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = d.join(per_doc, "doc", "left").select("doc_id", "text", "spans").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if text_too else done.drop("kept")
