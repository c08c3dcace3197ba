"""Score a stream of scoring records with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from rentlens.operators.score import score


def score_stream(model: PipelineModel, records: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row for each record; its prediction is null if a feature is no number
    (``validate_scoring_input`` of the same stream names the reason)."""
    return score(model, records, key)
