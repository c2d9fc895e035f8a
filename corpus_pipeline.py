"""The corpus pipeline: five stages from raw documents to a mixed training corpus.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
stage's input.  Every stage takes an empty table and extra columns of any name.  All but the last return the columns of
``documents``; the last adds the output shard, its slice, the copy and the order inside the slice, and repeats documents as
the mix takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import materialize, table
from docengine.llm.decontaminate import drop_contaminated
from docengine.llm.mixing import mix
from docengine.llm.quality import keep_good
from docengine.llm.secrets import redact
from docengine.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts are scored as texts of no words; equal rows fare alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts without words are one group; equal rows are kept once; a null id stays only where its group has no other.
    """
    return drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.  Null and empty texts stay, and so does all if the benchmark is empty."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars follows; documents stay, null texts as they are."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to shards and shuffled inside them.

    A text moves once, to its shard and one of the shard's slices; its copies are made after that.  Columns that the documents
    have under the names of the four that are added are replaced.
    """
    drawn = mix(docs.drop("shard", "slice", "copy", "order")).where("_copies > 0")
    drawn = drawn.withColumn("shard", F.col("_shard")).withColumn("slice", F.substring("_order", 1, 1))
    drawn = drawn.repartition("shard", "slice").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    drawn = drawn.withColumn("order", F.md5(F.concat_ws("|", "_order", "copy").cast("binary")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slice", "copy", "order")]
    return drawn.sortWithinPartitions("shard", "slice", "order").select(*kept, "shard", "slice", "copy", "order")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]
#: Trained models, fingerprints and parsers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
