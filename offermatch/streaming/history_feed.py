"""History kept up by a stream of deal snapshots; the state is the history table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offermatch.sinks.history import BUCKET, ROW, history_rows, upsert_history, write_history


def feed_history(deals: DataFrame, folder: str, checkpoint: str, seen_date: str,
                 order: list[str], buckets: int = 512) -> StreamingQuery:
    """Merge each micro-batch of deals into the history table at ``folder``.

    A batch reads and writes the buckets of its own ids only, whatever the size of the history.  Its number is the
    run's, so repeating a batch after a lost executor or driver gives the same table.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        nothing = history_rows(batch.limit(0), seen_date).withColumn(ROW, F.lit(0).cast("long"))
        if batch_id == 0:
            write_history(nothing, folder, buckets)
        schema = nothing.withColumn(BUCKET, F.lit(0)).schema
        upsert_history(spark, folder, batch, seen_date, order, batch_id, buckets, schema)

    return (
        deals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
