"""Reading documents and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def write_results(results: DataFrame, folder: str) -> None:
    """Results as Parquet under ``results``; as JSON lines, in a few large files, the texts by document under ``texts`` and the manifests under ``manifests``."""
    results.write.mode("overwrite").parquet(f"{folder}/results")
    stored = results.sparkSession.read.parquet(f"{folder}/results")
    stored.select("document_id", "status", "text").write.mode("overwrite").json(f"{folder}/texts")
    stored.select("manifest").write.mode("overwrite").text(f"{folder}/manifests")
