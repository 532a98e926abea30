"""A corpus pipeline of five stages: toxicity, near duplicates, decontamination, mixing and token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame, which is written and read back as the next one's docs.

Documents have doc_id, text and source, and may have columns of any other
name.  Null ids, null and empty texts and repeated rows pass the first three
stages as documents of their own; texts without words are in no mix.  Empty
labels or benchmark drop nothing; a missing table is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontamination, jaccard, mixing, queries, tokens, toxicity
from codeloom.llm.common import Scratch

#: A document is rejected from this score on.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below TOXIC; it learns from labelled rows that are not held out.

    Every row is judged by its own text; columns of any name stay as they are.
    """
    s = queries.scratch(spark, "pipeline-toxicity")
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"), s)
    return docs.where(toxicity.judged(model, docs["text"])["score"] < TOXIC)


def without(docs: DataFrame, s: Scratch, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs but those that `choose` names by doc_id.

    `choose` takes (doc_id, text).  Where ids repeat or are null, it gets a
    row number instead of the id, with rows in order of id, so that a row
    never goes for another one's text.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = s.save(choose(docs.select("doc_id", "text")).select("doc_id").distinct(), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    record = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    ordered = record.repartitionByRange(F.col("rec.doc_id").asc_nulls_last()).sortWithinPartitions(F.col("rec.doc_id").asc_nulls_last())
    rows = s.save(ordered.withColumn("row", F.monotonically_increasing_id()), "rows")
    gone = s.save(choose(rows.select(F.col("row").alias("doc_id"), F.col("rec.text").alias("text"))).select(F.col("doc_id").alias("row")).distinct(), "gone")
    return rows.join(gone, "row", "left_anti").select("rec.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, repeated rows included, the document of smallest id; null is the largest."""
    s = queries.scratch(spark, "pipeline-jaccard")
    return without(docs, s, lambda d: jaccard.join(d, s).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark."""
    s = queries.scratch(spark, "pipeline-decontamination")
    return without(docs, s, lambda d: decontamination.overlaps(d, queries.table(spark, sf_dir, "benchmark"), s))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order; a document comes as often as it is taken."""
    return mixing.mixed_documents(docs, queries.scratch(spark, "pipeline-mixing"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold for each document."""
    files = tokens.write_ids(docs, queries.scratch(spark, "pipeline-tokens"), queries.vocabulary(), 2)
    return tokens.read_ids(files)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: The learned toxicity scores and the vocabulary are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = queries.table(spark, sf_dir, "documents")
    s = queries.scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = s.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
