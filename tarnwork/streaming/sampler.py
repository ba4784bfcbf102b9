"""Batches without end: each request takes the next one, and a new epoch begins where one ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwork.operators.sampling import Quota, pk_batches

GIVEN = 65_536  # rows of a result that are made at once
_TAKEN = "consumer STRING, request LONG, epoch LONG, batch LONG"
_POSITION = "epoch LONG, batch LONG"


def _served(consumer: str, asked: np.ndarray, epoch: int, batch: int, n_batches: int, reseed: bool) -> Iterator[pd.DataFrame]:
    """The places of a consumer's requests from (epoch, batch) on, a piece at a time."""
    for lo in range(0, len(asked), GIVEN):
        some = asked[lo : lo + GIVEN]
        at = batch + lo + np.arange(len(some))
        yield pd.DataFrame({"consumer": consumer, "request": some, "epoch": (epoch + at // n_batches) if reseed else np.full(len(some), epoch), "batch": at % n_batches})


def positions(requests: DataFrame, n_batches: int, reseed: bool = True) -> DataFrame:
    """(consumer, request, epoch, batch) of a stream of (consumer, request): the place each consumer's request has in the endless order.

    The state of a consumer is the (epoch, batch) it takes next. It lives in the state store,
    so a stopped stream goes on where it was; after the last batch it starts over, in the
    next epoch or, without ``reseed``, in the same one. Requests of one micro-batch are
    served by number.
    """
    if n_batches < 1:
        raise ValueError("an endless order needs one batch at least")

    def take(key: tuple[str], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, batch = state.get if state.exists else (0, 0)
        asked = np.concatenate([some["request"].to_numpy() for some in rows])  # the numbers alone are held, 8 bytes each
        asked.sort()
        state.update((int(epoch + (batch + len(asked)) // n_batches), int((batch + len(asked)) % n_batches)))
        yield from _served(key[0], asked, epoch, batch, n_batches, reseed)

    keyed = requests.select(F.col("consumer").cast("string").alias("consumer"), F.col("request").cast("long").alias("request"))
    return keyed.groupBy("consumer").applyInPandasWithState(take, _TAKEN, _POSITION, "append", GroupStateTimeout.NoTimeout)


def taken_positions(requests: DataFrame, n_batches: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the positions of all requests there are below ``path``, a folder a micro-batch."""

    def sink(taken: DataFrame, number: int) -> None:
        taken.write.mode("overwrite").parquet(f"{path}/part={number}")

    return positions(requests, n_batches).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def endless_batches(requests: DataFrame, encoded: DataFrame, ident: str, quota: Quota, n_batches: int, path: str, checkpoint: str, seed: int = 42, reseed: bool = True) -> StreamingQuery:
    """Writes (consumer, request, epoch, batch, slot, pool, ident) of every request below ``path``, a folder a micro-batch.

    Batches are those of the static plan :func:`pk_batches` for their epoch. A micro-batch
    names few epochs; of each, the plan is joined to the batches that were asked for. One
    that is tried again overwrites its own folder.
    """

    def sink(taken: DataFrame, number: int) -> None:
        taken.persist()
        epochs = [r["epoch"] for r in taken.select("epoch").distinct().orderBy("epoch").collect()]
        for epoch in epochs:
            plan = pk_batches(encoded, ident, quota, n_batches, seed, epoch if reseed else 0)
            taken.where(F.col("epoch") == epoch).join(plan, "batch").write.mode("overwrite").parquet(f"{path}/part={number}/of_epoch={epoch}")
        taken.unpersist()

    return positions(requests, n_batches, reseed).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
