"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of the documents. ``run`` writes each stage's rows as Parquet
below the shared folder and reads them again as the next one's documents.

Null texts and texts without words fail the quality rules; rows without an id pass
the two duplicate stages unchanged; an empty table gives an empty result; further
columns are carried to the last stage, which gives ids and tokens only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe, lsh_forest, mixing, passages, quality_rules
from stratalog.llm.queries import trusted_documents
from stratalog.llm.words import small_text_batches
from stratalog.plans.registry import query
from stratalog.session import settle_table, table

#: Not to be said in SQL: hashed n-grams, min-hashes, compact windows and BPE merges.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_text_batches(spark)
    model = quality_rules.fit(docs, trusted_documents(table(spark, sf_dir, "labels")))
    return quality_rules.passing(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_text_batches(spark)
    return lsh_forest.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; n_chars, if there, follows the text."""
    small_text_batches(spark)
    cut = passages.without_passages(docs, passages.repeated_passages(docs))
    if "n_chars" in cut.columns:
        kind = cut.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return cut


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_text_batches(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, and decoded_sha256 of the bytes that the ids decode to."""
    small_text_batches(spark)
    decoded = bpe.decode(bpe.encode(docs, keep=["doc_id", "source"]))
    return decoded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", mixed_sources),
    ("byte_level_bpe", tokens),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
