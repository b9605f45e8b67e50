"""Corpus pipeline: five stages, each one operator applied to all that the stage before kept.

Every stage takes and returns the columns of ``documents``; the last one adds the
epoch, the domain and the budget of the leaf to each selected copy of a document.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoping.llm import mixing
from geoping.llm.common import materialise
from geoping.llm.decontaminate import decontaminate
from geoping.llm.jaccard_join import jaccard_join
from geoping.llm.quality_rules import quality_rules
from geoping.llm.suffix_dedup import as_text, suffix_dedup


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__key``, the file and the number in it of each row: the same in every read, whatever executors there are."""
    try:
        return docs.withColumn("__key", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:  # not a file read as it is
        return materialise(docs, "pipeline-rows").withColumn("__key", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``keys`` names: operators carry keys, not rows, and the rows are met once, here."""
    return docs.join(keys.select("row.__key").hint("merge"), "__key", "left_semi").drop("__key")


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    docs = _keyed(docs)
    return _only(docs, quality_rules(docs, ["__key"]).where("kept"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    docs = _keyed(docs)
    return _only(docs, jaccard_join(docs, ["__key"]).where("leads"))


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings are cut out of the texts; a text that nothing is left of stays as the empty text."""
    found = as_text(suffix_dedup(docs, docs.columns))
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench, docs.columns).where("not contaminated").select("row.*")


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The leaves' token prefixes: a row per selected copy of a document."""
    out = mixing.mixed_documents(docs)
    return out.select("row.*", "epoch", "domain", "tokens", "budget")


STAGES = [
    ("quality_rules", _quality),
    ("jaccard_join", _near_duplicates),
    ("suffix_dedup", _substrings),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
]

#: Language-model perplexity bands cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
