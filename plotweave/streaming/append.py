"""Features that keep coming: each micro-batch is clustered by itself and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import bounds
from ..operators import layout
from ..sources import dataset


def append_clustered(features: DataFrame, path: str, checkpoint: str, extent: bounds.Box, partitions: int = 1, once: bool = True) -> StreamingQuery:
    """Writes a streaming DataFrame of features under `path`/features.

    The extent is fixed beforehand, so that places on the curve compare across
    batches; a batch that is run again writes to its own folder again, so rows don't double.
    The manifest is written anew after each batch, so the folder opens as a dataset.
    """

    def write(batch: DataFrame, number: int) -> None:
        layout.clustered(layout.with_hilbert(batch, extent), partitions).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/features/batch={number}")
        dataset.write_manifest(batch.sparkSession, path)

    stream = features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
