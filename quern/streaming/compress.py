"""The plan on a stream: each row is compressed on its own, so no state and no watermark are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.plans.engine import Compressor
from quern.plans.options import CompressOptions
from quern.sources.samples import conform


def compress_stream(compressor: Compressor, samples: DataFrame, options: CompressOptions | None = None) -> DataFrame:
    """A streaming DataFrame of results for a streaming DataFrame of samples."""
    return compressor.compress_df(conform(samples), options)


def to_files(compressor: Compressor, samples: DataFrame, path: str, checkpoint: str, options: CompressOptions | None = None, kind: str = "parquet", **trigger) -> StreamingQuery:
    """Starts a query that appends results to ``path``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = compress_stream(compressor, samples, options).writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def for_each_batch(compressor: Compressor, sink, options: CompressOptions | None = None):
    """A function for ``foreachBatch`` that hands ``sink(results, batch_id)`` each batch's results. Use it
    for providers that join tables or for reports, which use windows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(compressor.compress_df(conform(batch), options), batch_id)

    return run
