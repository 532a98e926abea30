"""The registered queries of this subpackage: each takes (spark, sf_dir) and works on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, embeddings, infill, jaccard, language, mixing, packing, sharding, suffixes, tokens, toxicity, urls
from .common import Scratch

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's 64 MB of a batch are held by the JVM in buffers of twice that, and by a worker as Arrow and as pandas.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> Scratch:
    # Rows hold whole documents or blocks of them: smaller batches keep the workers small.  A session's own setting stays.
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")
    return Scratch(spark, name)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), scratch(spark, "op1"))


def op2_token_ids(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return tokens.read_ids(tokens.write_ids(table(spark, sf_dir, "documents"), scratch(spark, "op2"), path or vocabulary(), 2))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch(spark, "op3"))


def toxicity_model(docs: DataFrame, labels: DataFrame, s: Scratch) -> toxicity.Model:
    """Learned from the labelled rows that are not held out."""
    seen = ~language.held_out()
    return toxicity.fit(s.save(toxicity.training_rows(docs.where(seen), labels.where(seen)), "train"), s)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scratch(spark, "op4")
    model = toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), s)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language.held_out().alias("held_out"))
    return toxicity.score(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "plain_hits", "quoted_hits")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scratch(spark, "op5"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), scratch(spark, "op6")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), scratch(spark, "op7"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), scratch(spark, "op8"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scratch(spark, "op9")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.fit(docs.where("not held_out"), s)
    return language.predict(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), scratch(spark, "op10"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch(spark, "op11")  # only for its batch size
    made = infill.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), scratch(spark, "op12"), path or vocabulary(), end_id=1, capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), scratch(spark, "op13"))


def queries() -> dict:
    found = [
        op1_ngram_jaccard, op2_token_ids, op3_decontamination, op4_toxicity, op5_embedding_dedup, op6_mixing, op7_suffix_dedup, op8_sharding, op9_language_id, op10_url_filter,
        op11_fill_in_middle, op12_best_fit_packing, op13_centroid_clustering,
    ]
    return {f.__name__: f for f in found}
