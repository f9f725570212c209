"""BFR over a stream: every micro-batch is one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.bfr import BFR


def run(stream: DataFrame, bfr: BFR, checkpoint: str) -> StreamingQuery:
    """Feeds a stream of (id, vec) to a clusterer until no data is left.

    The clusterer commits its state with the number of each batch.  After a
    failure pass ``BFR.resumed`` of the same folder and the same checkpoint: a
    batch that was committed is skipped, one that was not is fed again to the
    state before it.
    """

    def step(batch: DataFrame, number: int) -> None:
        if number > bfr.fed:
            bfr.feed(batch, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
