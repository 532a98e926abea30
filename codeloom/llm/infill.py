"""Fill-in-middle transformation by a streaming matcher of constant memory (operator 11).

Units of a text are the matches of a pattern.  A first pass counts them; hashes
of the document's id then choose two ranks, and a second pass advances a lazy
iterator of matches to both.  No list of units is ever made.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Parameters:
    #: What a unit is; the default are lines with their ends.
    unit: str = r"[^\n]*\n|[^\n]+"
    seed: str = "7"
    #: Documents in a hundred that are transformed, and of these the ones whose suffix comes first.
    percent: int = 100
    spm_percent: int = 50
    #: What stands before prefix, suffix and middle.
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    #: Characters of output handed on at a time.
    chunk: int = 1 << 22

    def __post_init__(self):
        marks = self.marks
        if not all(marks) or any(a in b for a, b in itertools.permutations(marks, 2)):
            raise ValueError("marks must not be empty or hold each other")
        if any(a[k:] == b[: len(a) - k] for a, b in itertools.product(marks, marks) for k in range(1, len(a))):
            raise ValueError("a mark must not end as another begins: outputs could be read in two ways")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def drawn(doc_id: Column, p: Parameters) -> list[Column]:
    """Four numbers below 2**32 from the sha256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def count(unit: re.Pattern, text: str) -> int:
    return sum(1 for _ in unit.finditer(text))


def places(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Where units number `first` and `second` (from 1, first <= second; 0: the start) end."""
    matches = unit.finditer(text)
    a = next(itertools.islice(matches, first - 1, None)).end() if first else 0
    return a, next(itertools.islice(matches, second - first - 1, None)).end() if second > first else a


def transform(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Each document with its middle moved to the end: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The prefix ends after h1 % (n + 1) or h2 % (n + 1) units, the smaller, the
    middle after the larger, so either may be empty.  psm writes prefix,
    suffix, middle; spm suffix, prefix, middle.  Texts stay as they are, form
    plain and lengths null, if they are empty or null, hold a mark, or are not
    among the `percent`.  What no unit matches goes with the unit behind it, or
    at the end with the suffix.

    Null ids draw as the empty string does.  Repeated rows: each returns, and
    alike.  Very long texts: two passes over the text, of which only the
    document itself is held.  Empty table: no rows.  Extra columns are ignored.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = re.compile(p.unit)
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, named, h1, h2, h3, h4 in batch.itertuples(index=False):
                n = count(unit, text)
                lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
                if not text or h3 % 100 >= p.percent or any(m in text for m in p.marks):
                    row = (PLAIN, None, None, text)
                else:
                    a, b = places(unit, text, lo, hi)
                    parts = {"prefix": text[:a], "middle": text[a:b], "suffix": text[b:]}
                    form, order = (SPM, ("suffix", "prefix", "middle")) if h4 % 100 < p.spm_percent else (PSM, ("prefix", "suffix", "middle"))
                    row = (form, a, b - a, "".join(getattr(p, k) + parts[k] for k in order))
                rows.append((doc_id if named else None, n, *row))
                held += len(row[-1])
                if held >= p.chunk:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNotNull().alias("named"), *[h.alias(f"h{i}") for i, h in enumerate(drawn(F.col("doc_id"), p))])
    return d.mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    ids, n, form, prefix, middle, output = zip(*rows)
    whole = lambda x: pd.array(x, dtype="Int64")
    return pd.DataFrame({"doc_id": whole(ids), "n": n, "form": form, "prefix_chars": whole(prefix), "middle_chars": whole(middle), "output": output})


def restored(form: Column, output: Column, p: Parameters = Parameters()) -> Column:
    """The text that an output was made of, from output and form alone."""
    at = lambda mark: F.locate(mark, output)

    def between(mark: str, end: Column) -> Column:
        begin = at(mark) + len(mark)
        return F.substring(output, begin, end - begin)

    middle = between(p.middle, F.char_length(output) + 1)
    psm = F.concat(between(p.prefix, at(p.suffix)), middle, between(p.suffix, at(p.middle)))
    spm = F.concat(between(p.prefix, at(p.middle)), middle, between(p.suffix, at(p.prefix)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
