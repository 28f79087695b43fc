"""The metric tables: append-only history of profiles, replaceable signals and incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profile as P
from ..operators import rca as R
from ..schemas import TABLES
from ..session import materialise
from ..settings import Settings


PROFILED = ("column_profiles", "partition_profiles", "skipped_nodes")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Rows in a table's current shape; columns added since they were written are null."""
    target = T.StructType.fromDDL(schema)
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


class MetricStore:
    """Parquet tables under one folder, each partitioned by run_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        """The Hadoop path and its file system, so any shared storage works."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, table: str, runs: Sequence[str] | None = None) -> DataFrame:
        """The table in its current schema, of the named runs only if any are named.

        Naming runs names their folders, so the others are not even listed.  An empty
        table if nothing was written yet.  Profiles of a run are seen once the run has its row in
        `profile_runs`, which is written last: a run that died half-way shows nothing.
        """
        schema = T.StructType.fromDDL(TABLES[table])
        root = self.path(table)
        if runs is not None and table in PROFILED:
            runs = [r for r in runs if self._exists(self._marker(r))]
        paths = [root] if runs is None else [f"{root}/run_id={run}" for run in dict.fromkeys(runs)]
        paths = [p for p in paths if self._exists(p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # An explicit schema is the merged one: older files lack later columns.
        df = self.spark.read.schema(schema).option("basePath", root).parquet(*paths)
        if runs is None and table in PROFILED:
            df = df.join(self.read("profile_runs").select("run_id").distinct(), "run_id", "left_semi")
        return df.select(*[f.name for f in schema.fields])

    def _marker(self, run: str) -> str:
        return f"{self.path('profile_runs')}/run_id={run}"

    def _exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def _remove(self, path: str) -> None:
        where, fs = self._fs(path)
        if fs.exists(where):
            fs.delete(where, True)

    def add_answers(self, fresh: DataFrame) -> None:
        """Keep new answers; a prompt that two jobs asked has two rows, and either serves."""
        conform(fresh, TABLES["answers"]).write.mode("append").parquet(self.path("answers"))

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows of new runs.  A retried write of the same run replaces itself."""
        (
            conform(df, TABLES[table])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(self.path(table))
        )

    def replace_runs(self, table: str, df: DataFrame, run_ids: Sequence[str]) -> None:
        """Make the rows of these runs exactly df; a run without rows loses its old ones.

        New rows replace old ones first, and only runs that have none are removed, so
        that a job that dies half-way leaves no run without its rows.
        """
        rows = materialise(conform(df.where(F.col("run_id").isin(*run_ids)), TABLES[table]), table)
        present = {r.run_id for r in rows.select("run_id").distinct().collect()}
        if present:
            self.append(table, rows)
        for run in set(run_ids) - present:
            self._remove(f"{self.path(table)}/run_id={run}")

    def run_profile(
        self, nodes: dict[str, DataFrame], run_id: str, started_at: datetime,
        settings: Settings | None = None, finished_at: datetime | None = None,
    ) -> None:
        """Profile nodes and add them to the history."""
        stored = materialise(P.profile_nodes(nodes, settings, [run_id]), "profiles")
        self.add_profiles(stored, {run_id: started_at}, settings, finished_at)

    def add_profiles(
        self, stored: DataFrame, started: Mapping[str, datetime], settings: Settings | None = None, finished_at: datetime | None = None
    ) -> None:
        """Add the profiles of some runs, all grains, to the history.

        The rows that make the runs visible go first, if they were written before, and come
        back last.
        """
        settings = settings or Settings()
        for run in started:
            self._remove(self._marker(run))
        starts = self.spark.createDataFrame(list(started.items()), "run_id string, profiled_at timestamp")
        dated = stored.join(starts, "run_id")
        if settings.max_partitions is not None:
            over = P.partition_guard(stored, settings).where(~F.col("kept"))
            self.append("skipped_nodes", over.withColumn("partition_limit", F.lit(settings.max_partitions)))
        self.append("partition_profiles", P.partition_profiles(dated, settings))
        self.append("column_profiles", P.column_profiles(dated))
        models = stored.groupBy("run_id").agg(F.count_distinct("model_name").cast("int").alias("models_count"))
        runs = starts.withColumnRenamed("profiled_at", "started_at").join(models, "run_id", "left")
        self.append("profile_runs", runs.withColumn("finished_at", F.lit(finished_at or datetime.now()).cast("timestamp")))

    def commit(self, run_id: str, started_at: datetime, finished_at: datetime, models: int) -> None:
        row = [(run_id, started_at, finished_at, models)]
        self.append("profile_runs", self.spark.createDataFrame(row, TABLES["profile_runs"]))

    def save_signals(self, signals: DataFrame, run_ids: Sequence[str], detected_at: datetime) -> None:
        at = F.lit(detected_at).cast("timestamp")
        self.replace_runs("drift_signals", signals.withColumn("detected_at", at), run_ids)

    def save_incidents(self, found: DataFrame, run_ids: Sequence[str], detected_at: datetime) -> None:
        at = F.lit(detected_at).cast("timestamp")
        self.replace_runs("incidents", R.flattened(found).withColumn("detected_at", at), run_ids)


    def save_report(self, parts: DataFrame) -> None:
        """Keep the rows of reports, by run and part; those of the same run and part are replaced."""
        rows = conform(parts, TABLES["report_parts"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("run_id", "part").parquet(self.path("report_parts"))


def history(columns: DataFrame, model: str, column: str) -> DataFrame:
    """One column's measurements across runs, oldest first."""
    return (
        columns.where((F.col("model_name") == model) & (F.col("column_name") == column))
        .select("run_id", "profiled_at", "row_count", "null_rate", "distinct_count", "min_value", "max_value")
        .orderBy("profiled_at", "run_id")
    )
