"""Keeping the presence signatures of a stream: each micro-batch is a delivery of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from stratalens.operators.deliveries import SignatureState


def record_batches(stream: DataFrame, state: SignatureState, name: str = "batch") -> DataStreamWriter:
    """A writer that adds each micro-batch to the state.

    A batch that Spark runs again after a failure has the number that it had and replaces what it has left, so every row counts once.
    Rows that are late need no watermark: counts are kept by the values of their own columns and only add up.
    """

    def run(batch: DataFrame, number: int) -> None:
        state.record(f"{name}-{number}", batch)

    return stream.writeStream.foreachBatch(run)
