"""From raw documents to token ids: five stages, each an operator of tidewatch.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each as Parquet
in the shared folder and reads it again for the next.  All but the last return the columns of
documents, n_chars counted anew where the text has changed.

Rows with nulls, empty or very long texts, repeated rows and further columns go through every
stage as its operator's docstring says; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, decontamination, line_templates, near_dedup, quality_rules
from tidewatch.llm.base import SPACES, bounded_batches, materialise, table


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Further columns ride along in one struct, so that none clashes with an operator's."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        further = [c for c in docs.columns if c not in COLUMNS]
        if not further:
            return fn(spark, docs, sf_dir)
        made = fn(spark, docs.select(*COLUMNS, F.struct(*[f"`{c}`" for c in further]).alias("__further")), sf_dir)
        own = {c.lower() for c in made.columns}
        back = [F.col(f"__further.`{c}`") for c in further if c.lower() not in own]
        return made.select(*[c for c in made.columns if c != "__further"], *back)

    run_stage.__doc__ = fn.__doc__
    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are among them."""
    return quality_rules.judge(docs).where("rules.kept").select(*docs.columns)


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; a document of which no word is left goes with them."""
    kept = line_templates.drop_templates(docs)
    had_words = (F.col("n_dropped") == 0) | F.col("text").rlike(f"[^{SPACES}]")
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return kept.where(had_words).withColumn("n_chars", chars).select(*docs.columns)


@stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return near_dedup.near_duplicates(docs).where("kept").select(*docs.columns)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an item of a few words is no reason to drop one."""
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), short=False)
    return found.where(F.size("matches") == 0).select(*docs.columns)


@stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, with a digest of what they decode to."""
    coded = byte_bpe.decode(byte_bpe.encode(docs).drop("text"))
    return coded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

# Near-duplicate components, edit distances and byte-pair merges can't be told in SQL; the
# stages are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
