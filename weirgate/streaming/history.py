"""The history as a stream: each batch of results is upserted into a table by versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weirgate.operators.history import upsert


def upsert_stream(results: DataFrame, table: str, key: str, order: Sequence[str], first: Sequence[str], last: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Runs to the end of what is there. Each batch becomes a version of the table in a folder of its own, so a batch that is
    repeated after a failure writes the same version again; read_history reads the newest."""

    def merge(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        columns = [key, *order, *first, *last]
        log = batch.select(*dict.fromkeys(columns))
        log.write.mode("overwrite").parquet(f"{table}/log/version={version}")

    return results.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, table: str, key: str, order: Sequence[str], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """The history of all versions: one row a key."""
    return upsert(spark.read.parquet(f"{table}/log"), key, order, first, last)
