"""From raw documents to a training mix: each stage works on all that the one before it kept. A part of the subpackage wirelake.llm."""
import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wirelake.llm import decontamination, mixing, near_dedup, pii, toxicity  # noqa: E402
from wirelake.llm.common import table, written  # noqa: E402

#: documents with this score and more are rejected
TOXIC = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """The row as one column beside its text: columns of the table can't clash with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the scorer learns from the labelled ones."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_packed(docs), model).where(F.col("score") < TOXIC).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8): the one with the smallest doc_id, nulls last, then the smallest
    text checksum, so each group keeps one row whether its ids are missing, shared or not. Rows that repeat doc_id and text become one, the first by the JSON of all
    columns. Documents without words have no copies and stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.xxhash64("text").alias("print")).alias("_key")
    d = docs.select(row, name, "text")
    keep = near_dedup.groups(d.select("_key", "text"), key="_key").where("kept").groupBy("_key").agg(F.count("*").alias("_n"))
    d = d.drop("text").join(keep, "_key")
    several = d.where("_n > 1").groupBy("_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return d.where("_n = 1").select("_row.*").unionByName(several.select("_row.*"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    d = docs.withColumn("_print", F.xxhash64("text"))
    hit = decontamination.find(d, table(spark, sf_dir, "benchmark"), ["doc_id", "_print"]).select(F.col("doc_id").alias("_k"), F.col("_print").alias("_p")).distinct()
    return d.join(hit, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p")), "left_anti").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars follows the text."""
    d = pii.redact(pii.find(_packed(docs), pii.train(docs, "doc_id")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return d.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken: how often the mix takes each document."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark_copies), ("pii", redact_pii), ("mixing", mix_sources)]

#: scores and trees are learnt, which SQL can't express; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents, each written and read again."""
    return functools.reduce(lambda docs, stage: written(stage[1](spark, docs, sf_dir), stage[0]), STAGES, table(spark, sf_dir, "documents"))
