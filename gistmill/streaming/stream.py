"""A stateless stream of documents: files or rows as they come, compiled one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gistmill.plans.compile import Policy, compile_documents


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """A stream of files (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


def compile_stream(stream: DataFrame, id_col: str, content_col: str, policy: Policy = Policy()) -> DataFrame:
    """The stream with every document compiled; no state, watermark or shuffle, so any sink and trigger will do."""
    return compile_documents(stream, id_col, content_col, policy)


def write_stream(results: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Parquet sink, exactly once by its checkpoint."""
    writer = results.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
