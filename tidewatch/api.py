"""One object for the daily routine: profile, compare, trace, explain, report."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alert as A
from .operators import drift as D
from .operators import explain as X
from .operators import lineage as L
from .operators import rca as R
from .operators import report as P
from .operators import rolling as W
from .session import materialise
from .settings import Settings
from .sources.store import MetricStore, history


class Observatory:
    """Observed tables, their lineage and the metric store that remembers them."""

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame], nodes: DataFrame, store: str,
        settings: Settings | None = None,
    ):
        self.spark, self.tables, self.nodes = spark, dict(tables), nodes
        self.settings = settings or Settings()
        self.store = MetricStore(spark, store)
        self.edges = L.edges(nodes)
        self._hops: L.Hops | None = None

    @property
    def hops(self) -> L.Hops:
        if self._hops is None:
            self._hops = L.hops(self.edges)
        return self._hops

    # ------------------------------------------------------------ profiling

    def selected(self, only: str | None = None) -> dict[str, DataFrame]:
        """Tables to profile; naming one beats the include and exclude rules."""
        if only is not None:
            if only not in self.tables:
                raise ValueError(f"no node named {only!r}")
            return {only: self.tables[only]}
        names = self.spark.createDataFrame([(n,) for n in self.tables], "name string")
        kept = {r.name for r in names.where(self.settings.selected(F.col("name"))).collect()}
        if not kept:
            raise ValueError("no node matches the include and exclude rules")
        return {n: df for n, df in self.tables.items() if n in kept}

    def profile(self, run_id: str | None = None, only: str | None = None, at: datetime | None = None) -> str:
        run_id = run_id or uuid.uuid4().hex[:12]
        self.store.run_profile(self.selected(only), run_id, at or datetime.now(), self.settings)
        return run_id

    def history(self, model: str, column: str) -> DataFrame:
        return history(self.store.read("column_profiles"), model, column)

    def latest_runs(self, n: int = 2) -> list[str]:
        return [r.run_id for r in P.latest_runs(self.store.read("profile_runs"), n).collect()]

    def _latest(self) -> str:
        latest = self.latest_runs(1)
        if not latest:
            raise ValueError("no profile runs yet")
        return latest[0]

    # ------------------------------------------------------------ drift

    def _runs(self, run_id: str | None, baseline: str | None) -> tuple[str, str | None]:
        """The runs to compare: those named, else the newest ones."""
        rolling = self.settings.baseline_mode == "rolling"
        latest = [] if run_id and (baseline or rolling) else self.latest_runs(2)
        if run_id is None:
            if not latest:
                raise ValueError("no profile runs yet")
            run_id = latest[0]
        if rolling:
            return run_id, None
        if baseline is None:
            if len(latest) < 2:
                raise ValueError("two profile runs are needed to compare")
            baseline = latest[1]
        return run_id, baseline

    def _pairs(self, run_id: str, baseline: str) -> DataFrame:
        return D.run_pairs(self.spark, [(baseline, run_id)])

    def skipped(self, run_id: str) -> DataFrame:
        """Nodes without a per-day profile in a run, because they have more days than the settings allow."""
        return self._of("skipped_nodes", run_id)

    def detect(self, run_id: str | None = None, baseline: str | None = None, at: datetime | None = None) -> DataFrame:
        """Signals of a run in the configured mode; stored, replacing those of an earlier detection."""
        run_id, baseline = self._runs(run_id, baseline)
        if baseline is None:
            found = W.rolling(self._of("partition_profiles", run_id), self.settings)
        else:
            columns, partitions = (self._of(t, run_id, baseline) for t in ("column_profiles", "partition_profiles"))
            found = D.previous_run(columns, partitions, self._pairs(run_id, baseline), self.settings)
            for r in self.volume_mismatch(run_id, baseline).collect():  # one row, of the pair
                warnings.warn(f"run {run_id} measured {r.current_rows} rows, {baseline} {r.baseline_rows}: compare with care", stacklevel=2)
        self.store.save_signals(found, [run_id], at or datetime.now())
        return self.signals(run_id)

    def _of(self, table: str, *runs: str) -> DataFrame:
        """Rows of the named runs only: their folders are all that is read of the history."""
        return self.store.read(table, runs)

    def signals(self, run_id: str) -> DataFrame:
        return self._of("drift_signals", run_id)

    def volume_mismatch(self, run_id: str, baseline: str) -> DataFrame:
        return D.volume_mismatch(self._of("column_profiles", run_id, baseline), self._pairs(run_id, baseline))

    def gate(self, run_id: str, level: str = "critical") -> None:
        D.assert_no_drift(self.signals(run_id), level)

    # ------------------------------------------------------------ causes

    def analyse(self, run_id: str | None = None, at: datetime | None = None) -> DataFrame:
        """Incidents of a run, ranked; stored, replacing those of an earlier analysis."""
        run_id = run_id or self._runs(None, "-")[0]
        found = self.incidents(run_id)
        self.store.save_incidents(found, [run_id], at or datetime.now())
        return found

    def feed(self, run_id: str | None = None) -> DataFrame:
        """The stored incidents of a run, by default of the latest one."""
        return self._of("incidents", run_id or self._latest())

    def incident(self, root: str, run_id: str | None = None) -> DataFrame:
        """The signals at one root of a run, worst first."""
        return D.ranked(self.signals(run_id or self._latest()).where(F.col("model_name") == root))

    def incidents(self, run_id: str) -> DataFrame:
        return R.ranked(R.incidents(self.signals(run_id), self.hops, self.nodes))

    def prompts(self, run_id: str) -> DataFrame:
        return X.prompts(self.incidents(run_id), self.edges)

    def explain(self, run_id: str, cache: DataFrame | None = None, call: Callable[[str], str] = X.mock_answer) -> DataFrame:
        """Answers per incident; prompts in the store's answers, or in a given cache, are not asked again."""
        known = self.store.read("answers")
        if cache is not None:
            known = known.unionByName(cache.select(*known.columns))
        answers, fresh = X.resolve(self.prompts(run_id), known, call)
        self.store.add_answers(fresh)
        return answers.withColumn("explanation", F.to_json(X.parse(F.col("response"))))

    def alert(self, run_id: str, threshold: str = "warning", report_url: str | None = None) -> DataFrame:
        signals = self.signals(run_id)
        return A.messages(
            signals, self.incidents(run_id), R.roots(signals, self.hops), self.settings.project,
            self.settings.baseline_mode, threshold, report_url,
        )

    # ------------------------------------------------------------ reports

    def series(self, run_id: str, baseline: str, how: str = "inner") -> DataFrame:
        return P.series(self._of("partition_profiles", run_id, baseline), self._pairs(run_id, baseline), how)

    def lineage_status(self, run_id: str) -> DataFrame:
        signals, depths = self.signals(run_id), L.depth(self.nodes, self.hops)
        root = materialise(R.roots(signals, self.hops), "roots")
        blast = R.blast_radius(signals, root, self.hops)
        return P.lineage_status(self.nodes, depths, self._of("column_profiles", run_id), signals, root, blast)

    def overview(self, run_id: str | None = None) -> DataFrame:
        """Nodes, rows, signals and incidents of a run, by default of the latest one."""
        run_id = run_id or self._latest()
        columns = self._of("column_profiles", run_id)
        return P.overview(columns, self.signals(run_id), self.incidents(run_id))

    def runs(self, n: int = 10) -> DataFrame:
        """The last runs with what each measured and found, newest first."""
        latest = self.latest_runs(n)
        of = {t: self._of(t, *latest) for t in ("profile_runs", "column_profiles", "drift_signals", "incidents")}
        return P.run_feed(of["profile_runs"], of["column_profiles"], of["drift_signals"], of["incidents"], n)

    def one_series(self, run_id: str, baseline: str, model: str, column: str, metric: str) -> DataFrame:
        return P.validated(self.series(run_id, baseline, "full_outer"), model, column, metric)

    def save_report(self, run_id: str, baseline: str, explanations: DataFrame | None = None) -> DataFrame:
        """Write the parts of a run's report to the store and give them back from there."""
        found, points = materialise(self.incidents(run_id), "incidents"), materialise(self.series(run_id, baseline), "series")
        picks = P.chart_picks(found, points)
        self.store.save_report(P.report_parts(
            self._of("column_profiles", run_id), self.signals(run_id), found, self.lineage_status(run_id), self.edges, picks, points, explanations
        ))
        return self.store.read("report_parts", [run_id])

    def report(self, run_id: str, baseline: str, explanations: DataFrame | None = None) -> DataFrame:
        """The whole report of a run as one JSON document."""
        found, points = self.incidents(run_id), self.series(run_id, baseline)
        columns = self._of("column_profiles", run_id)
        return P.payload_json(
            P.payload(
                self.settings.project, columns, self._pairs(run_id, baseline), self.signals(run_id), found,
                self.lineage_status(run_id), self.edges, P.charts(P.chart_picks(found, points), points), explanations,
            )
        )
