"""Values that run along long ordered groups, and pairs of what such groups hold.

A group may be cut into pieces of bounded size, in the order of the group.
Values then run inside pieces, and from piece to piece over a row for each, so
that no task holds a group.  Pairs are made by pairs of cells of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a cell.
CELL = 4096


def running(df: DataFrame, keys: list[str], by: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, piece: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """df with sums, and last values that are not null, of all rows of the group up to this one in the order of `by`.

    `piece` names the column of pieces, which ascends with `by`; without it a
    task takes each group whole.  `by` tells the rows of a group apart.  With
    pieces df is read twice, so it should be a written table, or made row by
    row from such a `table` that has the columns too.
    """
    sums, lasts = sums or {}, lasts or {}
    inside = Window.partitionBy(*keys, *([piece] if piece else [])).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.last(c, True).over(inside) for n, c in lasts.items()}
    if piece is None:
        return df.withColumns(own)
    held = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), F.col(by))).alias(f"_{n}") for n, c in lasts.items()]
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    carried = (df if table is None else table).groupBy(*keys, piece).agg(*held)
    carried = carried.select(*keys, piece, *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums], *[F.last(f"_{n}", True).over(before).alias(f"_{n}") for n in lasts])
    out = df.withColumns(own).join(carried, [*keys, piece])
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(n, f"_{n}") for n in lasts})
    return out.drop(*[f"_{n}" for n in (*sums, *lasts)])


def neighbours(df: DataFrame, keys: list[str], by: str, value: str, piece: str | None = None) -> DataFrame:
    """df with `prev`, `next` and `next2`: the values, none of them null, one row back and one and two rows on in the group; `piece` as above."""
    w = Window.partitionBy(*keys, *([piece] if piece else [])).orderBy(by)
    out = df.withColumns({"prev": F.lag(value).over(w), "next": F.lead(value).over(w), "next2": F.lead(value, 2).over(w)})
    if piece is None:
        return out
    over = Window.partitionBy(*keys).orderBy(piece)
    ends = out.groupBy(*keys, piece).agg(F.min_by(F.struct(F.col(value).alias("one"), F.col("next").alias("two")), by).alias("first"), F.max_by(value, by).alias("_last"))
    ends = ends.select(*keys, piece, F.lag("_last").over(over).alias("_prev"), F.lead("first.one").over(over).alias("_one"), F.coalesce(F.lead("first.two").over(over), F.lead("first.one", 2).over(over)).alias("_two"))
    out = out.join(ends, [*keys, piece])
    next2 = F.coalesce("next2", F.when(F.col("next").isNull(), F.col("_two")).otherwise(F.col("_one")))
    return out.withColumns({"prev": F.coalesce("prev", "_prev"), "next": F.coalesce("next", "_one"), "next2": next2}).drop("_prev", "_one", "_two")


def in_order(left: DataFrame, right: DataFrame, keys: list[str], size: int | None = None, cut: bool = True) -> DataFrame:
    """Rows of left (keys, pos_l, more) with rows of right (keys, pos_r, more) of the same group, where pos_l < pos_r.

    Positions start at 0 or later.  A group of up to `size` of them (CELL) is
    a key of its own.  Others are cut into cells of positions, and every pair
    of cells that may hold such pairs is a key, so that a key has the rows of
    one cell on either side.  A row has as many copies as its group has cells
    on its other side.  Without `cut`, for positions known to be few, groups
    are keys of their own.
    """
    if not cut:
        return left.join(right, keys).where("pos_l < pos_r")
    size = size or CELL
    at_l, at_r = F.floor(F.col("pos_l") / size), F.floor(F.col("pos_r") / size)
    # Only groups that go beyond the first cell are in these two.
    last = right.where(at_r > 0).groupBy(*keys).agg(F.max(at_r).alias("_last"))
    first = left.join(last, keys, "left_semi").groupBy(*keys).agg(F.min(at_l).alias("_first"))
    upto, since = F.coalesce("_last", F.lit(0)), F.coalesce("_first", F.lit(0))
    a = left.join(last, keys, "left").where(at_l <= upto)
    a = a.withColumns({"_a": at_l, "_b": F.explode(F.sequence(at_l, upto))}).drop("_last")
    b = right.join(first, keys, "left").where((at_r >= since) & ((at_r == 0) | F.col("_first").isNotNull()))
    b = b.withColumns({"_a": F.explode(F.sequence(since, at_r)), "_b": at_r}).drop("_first")
    return a.join(b, [*keys, "_a", "_b"]).where("pos_l < pos_r").drop("_a", "_b")
