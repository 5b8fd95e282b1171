"""Evaluation of generations as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import evaluate


def evaluate_stream(gens: DataFrame, passages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch's evaluations under path, by batch, so that a batch that is run again replaces its own output."""
    def one(batch: DataFrame, number: int) -> None:
        evaluate.evaluated(batch, passages).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return gens.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
