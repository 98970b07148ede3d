"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last return the columns of
``documents``. The tables beside the documents are read from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinarm.llm import decontaminate, jaccard, packing, pii, toxicity
from twinarm.llm.common import importable, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    importable(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row of the least doc_id stays (one of them if it is repeated); rows without a doc_id are in no group."""
    importable(spark)
    known = docs.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        gone = jaccard.similar_components(docs).where(F.col("component_id") < F.col("doc_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids are repeated: the rows are numbered once and judged by their numbers.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = materialise(docs.select(whole, "doc_id", "text", F.monotonically_increasing_id().alias("_row")), "rows")
    found = jaccard.similar_components(rows.where(F.col("doc_id").isNotNull()).select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    found = materialise(found.join(rows.select("_row", "doc_id"), "_row"), "judged")
    stays = materialise(found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")), "stays")
    gone = found.join(stays, "component_id").where(F.col("first._row") != F.col("_row")).select("_row")
    return rows.join(gone, "_row", "left_anti").select("_doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), "documents")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows the text."""
    importable(spark)
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return redacted.select(*[F.when(F.col("text").isNull(), F.col(c)).otherwise(length).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
