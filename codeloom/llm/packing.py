"""Best-fit packing by sums of squares (operator 12).

Of the open bins, N(g) have a gap of g.  A piece goes where the sum of N(g)**2
over all gaps becomes smallest, a new bin included, so that no gap gets
common that nothing fits into.  Larger pieces come first.

Pieces are dealt to groups of bounded size by a hash, each packed by a task of
its own; then what each group has left open is packed again in the same way,
bins of several groups together and each as one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_process
from .tokens import PieceTokenizer

#: Pieces that are packed together.
GROUP = 4096


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Ids of every document and the end id, cut every `capacity` ids: key, doc_id, piece, start, length, ids_crc32, ids.

    `ids` are little-endian unsigned 32-bit integers; `key` is unique.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tk = per_process("tokenizer", path, lambda: PieceTokenizer(path))
        by_piece, key = tk.drops_space(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                texts = list(part["text"])
                if by_piece:
                    lengths, ids = tk.encode(texts)
                else:
                    got = [np.array(tk.ids_of(t), np.uint32) for t in texts]
                    lengths, ids = np.array([len(g) for g in got], np.int64), np.concatenate(got)
                raw = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4").tobytes()
                lengths = lengths.astype(np.int64) + 1
                cuts = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(part)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, lengths[doc] - start)
                at = 4 * ((np.cumsum(lengths) - lengths)[doc] + start)
                own = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                ids_of_docs = pd.Series(part["doc_id"].to_numpy()).astype("Int64").mask(part["nameless"].to_numpy())
                yield pd.DataFrame({
                    "key": key + np.arange(len(doc)), "doc_id": ids_of_docs.iloc[doc].reset_index(drop=True), "piece": piece.astype(np.int32),
                    "start": start, "length": length, "ids_crc32": [zlib.crc32(x) for x in own], "ids": own,
                })
                key += len(doc)

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("nameless"))
    return d.mapInPandas(run, "key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def place(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the order given, by sums of squares.

    A move changes the sum by what it does to two of the counts.  Where moves
    tie, an open bin is taken before a new one, of these the smallest gap, of
    its bins the one that got it last.
    """
    n = np.zeros(capacity + 1, np.int64)  # open bins of each gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for s in sizes:
        open_ = np.flatnonzero(n[s:]) + s
        gap = capacity
        if len(open_):
            change = 2 * (n[open_ - s] - n[open_]) + 2
            if open_[0] == s:
                change[0] = 1 - 2 * int(n[s])  # full bins don't count
            k = int(change.argmin())
            if s == capacity or change[k] <= 2 * n[capacity - s] + 1:
                gap = int(open_[k])
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = stacks[gap].pop()
            n[gap] -= 1
        bins.append(at)
        offsets.append(capacity - gap)
        if gap > s:
            stacks[gap - s].append(at)
            n[gap - s] += 1
    return bins, offsets


def level(items: DataFrame, capacity: int, group: int, seed: int) -> DataFrame:
    """Pack (name, size) in groups of about `group`: name, size, bin (smallest name in it), offset."""
    groups = max(1, -(-items.count() // group))

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["size", "name"], ascending=[False, True], ignore_index=True)
        bins, offsets = place(held["size"].tolist(), capacity)
        named = held.groupby(np.array(bins))["name"].transform("min")
        return pd.DataFrame({"name": held["name"], "size": held["size"], "bin": named, "offset": offsets})

    dealt = items.withColumn("deal", F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(run, "name long, size long, bin long, offset long")


def pack(docs: DataFrame, scratch: Scratch, path: str, end_id: int = 1, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Every piece of every document and its place: key, doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    Documents of more than `capacity` ids are cut, others never.  Full pieces
    are sequences of their own.  A sequence is named by the smallest key in it,
    and its pieces stand without gaps.

    Null or empty text: the end id alone.  Null ids stay null.  Repeated rows:
    pieces of their own.  Pieces of one size tie; keys, which differ, order
    them.  Very long texts: as many pieces as they take.  Empty table: no
    rows.  Extra columns are ignored.
    """
    made = scratch.save(pieces(docs, path, end_id, capacity), "pieces")
    narrow = made.where(F.col("length") < capacity).select(F.col("key").alias("name"), F.col("length").alias("size"))
    first = scratch.save(level(narrow, capacity, group, 1), "first")
    bins = first.groupBy("bin").agg(F.sum("size").alias("size")).where(F.col("size") < capacity)
    bins = scratch.save(bins.select(F.col("bin").alias("name"), "size"), "open")
    second = scratch.save(level(bins, capacity, group, 2), "second").select(F.col("name").alias("bin"), F.col("bin").alias("sequence"), F.col("offset").alias("base"))
    placed = first.join(second, "bin", "left").select(F.col("name").alias("key"), F.coalesce("sequence", "bin").alias("sequence"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("at"))
    return made.join(placed, "key", "left").select(
        "key", "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "key").alias("sequence_id"), F.coalesce("at", F.lit(0)).cast("long").alias("offset"), "ids"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids, ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), rows.alias("rows"))
    return whole.select("sequence_id", "n_ids", F.aggregate("rows", F.lit(b""), lambda ids, r: F.concat(ids, r["ids"])).alias("ids"))
