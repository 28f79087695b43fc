"""Fixed schemas of the lineage and metric tables."""

from __future__ import annotations

NODE = (
    "unique_id string, name string, relation string, materialized string, "
    "depends_on array<string>, is_source boolean"
)

PROFILE_RUNS = "run_id string, started_at timestamp, finished_at timestamp, models_count int"

COLUMN_PROFILES = (
    "run_id string, profiled_at timestamp, model_name string, column_name string, data_type string, "
    "row_count bigint, null_count bigint, null_rate double, distinct_count bigint, distinct_rate double, "
    "min_value string, max_value string, mean_value double, distinct_sketch binary"
)

PARTITION_PROFILES = (
    "run_id string, profiled_at timestamp, model_name string, partition_value date, column_name string, "
    "row_count bigint, null_count bigint, null_rate double, distinct_count bigint, "
    "min_value string, max_value string, mean_value double, grain string, distinct_sketch binary"
)

DRIFT_SIGNALS = (
    "detected_at timestamp, run_id string, baseline_run_id string, model_name string, column_name string, "
    "metric string, baseline_value double, current_value double, change double, severity string, "
    "partitions int, baseline_text string, current_text string, first_partition string"
)

INCIDENTS = (
    "detected_at timestamp, run_id string, root string, is_source boolean, severity string, "
    "columns string, blast_radius string, signal_count int"
)

SKIPPED_NODES = "run_id string, model_name string, partitions bigint, partition_limit int"

REPORT_PARTS = (
    "run_id string, part string, item bigint, root string, model_name string, column_name string, metric string, "
    "day string, baseline double, current double, change double, severity string, partitions int, "
    "baseline_text string, current_text string, detail string"
)

ANSWERS = "prompt_key string, prompt string, response string"

TABLES = {
    "skipped_nodes": SKIPPED_NODES,
    "answers": ANSWERS,
    "profile_runs": PROFILE_RUNS,
    "column_profiles": COLUMN_PROFILES,
    "partition_profiles": PARTITION_PROFILES,
    "drift_signals": DRIFT_SIGNALS,
    "incidents": INCIDENTS,
    "report_parts": REPORT_PARTS,
}
