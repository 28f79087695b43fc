"""Session defaults, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Only what the plans rely on.  Partition counts and memory belong to the cluster.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Per-day partial aggregates keep (days x runs) groups per task in memory.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}

# What holds while a derived table is written, whatever the session: these do not change results.
WRITE_CONF = {
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": PLAN_CONF["spark.sql.objectHashAggregate.sortBased.fallbackThreshold"],
    # The JVM never compiles a method of over 8,000 bytes; the default lets one of 65,535 be interpreted per row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Masks of sixty runs are long expressions: carried along as constraints they take the planner a minute per node.
    "spark.sql.constraintPropagation.enabled": "false",
}

_LOCAL_DIRS: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLAN_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by the cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder to run on a cluster")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="tidewatch-")
    return _LOCAL_DIRS[sc.applicationId]


@contextmanager
def write_conf(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in WRITE_CONF}
    try:
        for key, value in WRITE_CONF.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table once and read it back.

    Unlike a cache it survives lost executors, and unlike a checkpoint it keeps
    column pruning, filter pushdown and file sizes, so Catalyst picks broadcast
    joins from real sizes.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}/{label}"
    with write_conf(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
