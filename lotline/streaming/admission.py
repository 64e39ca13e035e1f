"""Entry decisions on a stream of attempts against the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lotline.operators.admission import admit, entry_log_rows
from lotline.sources.tables import Tables


def admit_stream(attempts: DataFrame, tables: Callable[[], Tables], path: str, state: str):
    """Decides each micro-batch against the tables as they are then.

    ``tables`` is called per batch. Decisions and logs of a batch go to a folder of
    its own that a repeated batch overwrites, so each attempt is decided once.
    """
    def decide_batch(batch: DataFrame, number: int) -> None:
        done = admit(tables(), batch).decisions
        folder = f"{path}/decisions/batch={number}"
        done.write.mode("overwrite").parquet(folder)
        stored = batch.sparkSession.read.schema(done.schema).parquet(folder)
        entry_log_rows(stored).write.mode("overwrite").parquet(f"{path}/entry_logs/batch={number}")

    return (attempts.writeStream.foreachBatch(decide_batch).option("checkpointLocation", state)
            .trigger(availableNow=True).start())
