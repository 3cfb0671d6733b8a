"""Engine configuration, and the dimension of result codes."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

#: Result codes by number.
CODES = [
    "SUCCESS", "NOT_A_QUESTION", "NO_TOPIC", "UNRELATED", "NO_SEARCH_KEYWORDS", "NO_SEARCH_RESULT", "BAD_ANSWER", "SECURITY", "NOT_WORK_TIME", "PARAMETER_ERROR", "PARAMETER_MISS", "WORK_IN_PROGRESS", "FAILED",
    "BAD_PARAMETER", "INTERNAL_ERROR", "WEB_SEARCH_FAIL", "SG_SEARCH_FAIL", "LLM_NOT_RESPONSE_SG", "QUESTION_TOO_SHORT", "INIT",
]


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    """Knobs of retrieval and answering; reject_throttle is what calibration writes back."""

    reject_throttle: float = 0.3
    top_vectors: int = 30
    top_reranked: int = 4
    chunk_size: int = 832
    overlap: int = 32
    context_chars: int = 40_000
    graph_weight: float = 0.2
    work_start: str = "00:00:00"
    work_end: str = "23:59:59"

    def saved(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(json.dumps(dataclasses.asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    @classmethod
    def loaded(cls, spark: SparkSession, folder: str) -> EngineConfig:
        return cls(**json.loads(spark.read.text(folder).first().value))

    def calibrated(self, best: DataFrame) -> EngineConfig:
        """With the threshold of a one-row calibration result."""
        row = best.first()
        return dataclasses.replace(self, reject_throttle=max(0.0, row["threshold"])) if row else self


def result_codes(spark: SparkSession) -> DataFrame:
    """code, name: a dimension to join with results."""
    return spark.createDataFrame(list(enumerate(CODES)), "code int, name string")
