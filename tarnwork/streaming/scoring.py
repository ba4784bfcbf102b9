"""Stream scoring: each micro-batch is matched against a gallery and decided.

The reference workload has no streams; this is Spark surface over the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes ``score(batch)`` of every micro-batch under ``path``/batch=<id>.

    A batch that is tried again overwrites its own folder, so results are exactly once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
