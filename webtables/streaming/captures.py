"""Page records of captures as they arrive.

Records depend on one page each, so the batch operator runs unchanged on a
stream and needs no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from webtables.operators.pages import page_records


def stream_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures from the Parquet files that are added to a folder."""
    return spark.readStream.schema("page_id bigint, url string, html string").parquet(path)


def write_records(captures: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the records of what has arrived to a Parquet table, then stop."""
    return (
        page_records(captures)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
