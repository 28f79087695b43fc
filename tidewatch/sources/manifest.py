"""The lineage manifest: one JSON document of models and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = (
    "struct<resource_type:string,name:string,relation_name:string,"
    "config:struct<materialized:string>,depends_on:struct<nodes:array<string>>>"
)
SCHEMA = f"nodes map<string,{_ENTRY}>, sources map<string,struct<name:string,relation_name:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources and models as nodes; other resource types are left out."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True)
    models = (
        doc.select(F.explode("nodes").alias("unique_id", "n"))
        .where(F.col("n.resource_type") == "model")
        .select(
            "unique_id", "n.name", F.col("n.relation_name").alias("relation"),
            F.col("n.config.materialized").alias("materialized"),
            F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"),
            F.lit(False).alias("is_source"),
        )
    )
    sources = doc.select(F.explode("sources").alias("unique_id", "n")).select(
        "unique_id", "n.name", F.col("n.relation_name").alias("relation"),
        F.lit("source").alias("materialized"), F.array().cast("array<string>").alias("depends_on"),
        F.lit(True).alias("is_source"),
    )
    return sources.unionByName(models)


def listing(nodes: DataFrame) -> DataFrame:
    """Nodes with what they read, sources first, then by name."""
    parents = F.array_join(F.transform("depends_on", lambda d: F.element_at(F.split(d, r"\."), -1)), ", ")
    return nodes.select(
        "name", F.when(F.col("is_source"), "source").otherwise("model").alias("kind"), "materialized",
        F.when(parents == "", "-").otherwise(parents).alias("parents"),
    ).orderBy(F.col("kind").desc(), "name")
