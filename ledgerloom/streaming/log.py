"""The run log as a stream: files arrive, each micro-batch is appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import PUBLISHED, publish


def stream_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """New JSON-line files under path; a line that doesn't parse stops the stream."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def append_stream(records: DataFrame, private: str, public: str, checkpoint: str, allowed=PUBLISHED, once: bool = True) -> StreamingQuery:
    """Every record to the private log, its publishable fields to the public one.

    A batch has a folder of its own, which a replay of that batch replaces: after a failure no record is lost or doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{private}/batch={number}")
            publish(batch, allowed).write.mode("overwrite").parquet(f"{public}/batch={number}")
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
