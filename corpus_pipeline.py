"""Corpus pipeline: quality, exact duplicates, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and
reread. All but the last return the columns of documents.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, an empty table and columns
besides those of documents, which go. Null texts count as empty, the null source is a source, and rows with a null doc_id
are documents like others; what each operator makes of them stands in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import dartminhash, exact, mixing, packing, quality
from marlstone.llm.common import scratch_path, scratch_scope, sized, written
from marlstone.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, verdicts: DataFrame, key) -> DataFrame:
    """The rows of ``docs`` that the kept verdicts (doc_id, key) name; a row that repeats another stays once."""
    chosen = written(verdicts.where("kept").select(F.col("doc_id").alias("id"), F.col("key").alias("k")), "kept")
    rows = docs.withColumn("key", key)
    kept = rows.join(sized(chosen.distinct()), rows.doc_id.eqNullSafe(F.col("id")) & (rows.key == F.col("k")), "left_semi")
    repeated = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    kept = kept.dropDuplicates(["doc_id", "key"]) if repeated else kept
    return kept.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; empty ones are scored by the model's offset, repeated rows alike."""
    scored = quality.quality_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep_text=True)
    return scored.where("predicted = 1").select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, one row of it; a null doc_id loses against any other."""
    rows = docs.select(*COLUMNS)
    verdicts = exact.exact_classes(rows).withColumnRenamed("text_sha256", "key")
    return _kept(rows, verdicts, F.sha2(F.coalesce("text", F.lit("")), 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id; texts without words link with nothing."""
    rows = docs.select(*COLUMNS)
    verdicts = dartminhash.near_texts(rows, keep_class=True).withColumnRenamed("cls", "key")
    return _kept(rows, verdicts, dartminhash.text_class())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, up to three times; documents without words are not taken."""
    rows = docs.select(*COLUMNS).withColumn("key", dartminhash.text_class())
    mix = mixing.mixture(rows, extra=("key",)).where("taken > 0").groupBy("doc_id", "source", "key")
    mix = mix.agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    times = F.floor(F.col("taken") / F.col("size")).cast("int")
    chosen = written(mix.select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("key").alias("k"), times.alias("times")), "taken")
    same = rows.doc_id.eqNullSafe(F.col("id")) & rows.source.eqNullSafe(F.col("s")) & (rows.key == F.col("k"))
    joined = rows.dropDuplicates(["doc_id", "source", "key"]) if _repeats(rows) else rows
    joined = joined.join(sized(chosen), same)
    return joined.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a document of no tokens is its end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


def _repeats(rows: DataFrame) -> bool:
    return rows.groupBy("doc_id", "source", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn a model and draw signatures, which SQL does not express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as keep:
            path = scratch_path(spark, f"stage-{name}")
            docs = written(stage(spark, docs, sf_dir), name, path)
            keep.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
