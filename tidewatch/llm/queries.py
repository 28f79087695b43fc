"""Every query of this folder, registered by its module, and the pipeline."""

import corpus_pipeline

from . import (  # noqa: F401
    alignment,
    byte_bpe,
    decontamination,
    language_model,
    line_templates,
    near_dedup,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sanitisation,
    substring_dedup,
    token_counts,
    toxicity,
)
from .base import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
