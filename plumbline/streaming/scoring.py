"""Cleaning of streamed rows with constants learned on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import clean
from plumbline.spec import FittedSpec
from plumbline.streaming.messages import write_batch


def clean_stream(stream: DataFrame, fitted: FittedSpec, path: str, checkpoint: str) -> StreamingQuery:
    """No row is dropped and no order-based fill runs: every micro-batch is cleaned as scoring rows are."""
    return (stream.writeStream.foreachBatch(lambda b, n: write_batch(clean.apply(b, fitted), n, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
