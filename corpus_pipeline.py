"""The corpus pipeline: each stage takes the documents that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import decontam, linededup, minhash, pieces, toxicity
from quarrylens.llm.queries import held_out
from quarrylens.llm.shared import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay. The model learns from the labelled ones among docs that aren't held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=~held_out())
    return toxicity.toxicity(docs, model, carry=("text", "lang", "source", "n_chars")).where("score < 0.7").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with a doc_id stays, without its repeated lines; n_chars is that of the text that is left."""
    kept = linededup.dedup_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Rows with one doc_id and one text are one, that of the smallest lang, source and n_chars; other texts of a doc_id stay
    or go by their own groups. Rows without a doc_id go.
    """
    key = ["doc_id", "text_hash"]
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select(*key).distinct()
    rest = F.min(F.struct("lang", "source", "n_chars", "text")).alias("x")
    one = docs.withColumn("text_hash", F.xxhash64("text")).groupBy(*key).agg(rest)
    return one.join(kept, key, "left_semi").select("doc_id", "x.*").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; of a doc_id with several texts those that hold one."""
    key = ["doc_id", "text_hash"]
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*key).distinct()
    return docs.withColumn("text_hash", F.xxhash64("text")).join(staged(found, "contaminated"), key, "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids; text is what the ids decode to."""
    rest = ("lang", "source", "n_chars")
    out = pieces.round_trip(docs, carry=rest)
    return out.select("doc_id", F.col("decoded").alias("text"), *rest, F.size("ids").alias("n_tokens"), "ids")


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("sentencepiece", tokenize)]
#: The first stage has no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir after all stages, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
