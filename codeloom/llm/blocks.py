"""Which hash values occur more than once in a corpus, without a row or a hot key for any of them.

Values travel as sorted binary arrays, cut by range into buckets; each block
of input sends a value once however often it holds it, so buckets are even
and no value is hot.  A level for each value comes back to its block: 0 if it
has one owner, else the number of blocks that hold it (254 at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a block, and of a bucket: what one task holds at a time.
BLOCK_VALUES = 1_000_000
BUCKET_VALUES = 4_000_000


def pack(values: np.ndarray, owner: np.ndarray) -> dict[str, bytes]:
    """Columns of a block: its distinct values, sorted, and which of them have two owners."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    twice = np.zeros(int(new.sum()), np.uint8)
    twice[(np.cumsum(new) - 1)[1:][~new[1:] & (o[1:] != o[:-1])]] = 1
    return {"vals": v[new].tobytes(), "twice": twice.tobytes()}


def planes(values: np.ndarray, width: int) -> bytes:
    """Differences of unsigned 64-bit values below 256**width, modulo that, as `width` planes of bytes, low bytes first.

    Where values ascend the high planes have little in them, which any codec
    of Spark's finds: a million sorted values of six bytes take about four.
    """
    steps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    """The values of `planes`."""
    held = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((held.shape[1], 8), np.uint8)
    out[:, :width] = held.T
    out = out.view("<u8").ravel()
    np.cumsum(out, out=out)
    return out & np.uint64(256**width - 1)


def levels(table: DataFrame, total: int, dtype: str, columns: tuple[str, ...] = ("vals", "twice"), read=lambda vals, twice: (vals, twice), width: int | None = None) -> DataFrame:
    """From (block, columns), of which `read` makes vals and twice: (block, bucket, n, levels) for each bucket that a block has values in; levels is a byte for each value.

    With `width`, values are of so many bytes, and travel as `planes`.
    """
    buckets = max(16, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_VALUES))
    span = 2.0 ** (8 * (width or np.dtype(dtype).itemsize))
    kind = dict(table.dtypes)["block"]
    sent = (lambda v: planes(v, width)) if width else (lambda v: v.tobytes())
    received = (lambda raw: unplanes(raw, width)) if width else (lambda raw: np.frombuffer(raw, dtype))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = (np.arange(1, buckets, dtype=np.float64) * (span / buckets)).astype(dtype)
        for batch in it:
            for block, *row in batch.itertuples(index=False):
                raw, twice = read(*row)
                v = np.frombuffer(raw, dtype)
                ends = [0, *np.searchsorted(v, bounds).tolist(), len(v)]
                rows = [(b, block, sent(v[ends[b] : ends[b + 1]]), twice[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]
                yield pd.DataFrame(rows, columns=["bucket", "block", "vals", "twice"])

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        parts = [received(x) for x in group["vals"]]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        v = every[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        count = np.diff(np.concatenate([np.flatnonzero(new), [len(v)]]))
        level = np.empty(len(v), np.uint8)
        level[order] = np.where(count > 1, np.minimum(count, 254), 0).astype(np.uint8)[np.cumsum(new) - 1]
        level = np.maximum(level, np.concatenate([np.frombuffer(x, np.uint8) for x in group["twice"]]))
        cuts = np.cumsum([0, *map(len, parts)])
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "n": [len(p) for p in parts], "levels": [level[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]})

    pieces = table.select("block", *columns).mapInPandas(cut, f"bucket int, block {kind}, vals binary, twice binary")
    return pieces.groupBy("bucket").applyInPandas(decide, f"block {kind}, bucket int, n int, levels binary")


def list_length(answers: DataFrame) -> float:
    """How many blocks hold a value that more than one does, as the median over all blocks and such values; 2 if there is none."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(256, np.int64)
        for batch in it:
            for x in batch["levels"]:
                seen += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"level": at.astype(np.int32), "n": seen[at]})

    # 254 rows at most.
    rows = sorted((r["level"], r["n"]) for r in answers.select("levels").mapInPandas(count, "level int, n long").where("level > 0").groupBy("level").agg(F.sum("n").alias("n")).collect())
    half, passed = sum(n for _, n in rows) / 2, 0
    for level, n in rows:
        passed += n
        if passed >= half:
            return float(max(2, level))
    return 2.0


def by_block(answers: DataFrame) -> DataFrame:
    """One row (block, answers) for each block."""
    return answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "levels"))).alias("answers"))


def joined(answers) -> np.ndarray:
    """The levels of a block's values, in their order."""
    return np.frombuffer(b"".join(bytes(a["levels"]) for a in answers), np.uint8)
