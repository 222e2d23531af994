"""Running a recipe on every micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from stratalens.operators.workflow import Recipe
from stratalens.result import Result


def on_each_batch(stream: DataFrame, recipe: Recipe, deliver: Callable[[int, Result], None], **overrides) -> DataStreamWriter:
    """A writer that treats each micro-batch as a delivery: its result goes to `deliver` with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # the recipe reads it several times and a batch must be the same each time
        try:
            deliver(number, recipe.run(kept, **overrides))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(run)
