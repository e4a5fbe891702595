"""Products of molecules as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.metabolize import metabolize


def expand_stream(arriving: DataFrame, out: str, checkpoint: str, catalog: str = "PhaseOne", smiles: str = "smiles", once: bool = False) -> StreamingQuery:
    """Append every batch's emissions, each under its batch number, so that a batch that runs twice replaces itself.
    Duplicates are dropped within a molecule, so batches are independent and no state is kept."""

    def each(batch: DataFrame, number: int) -> None:
        metabolize(batch, smiles, catalog).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
