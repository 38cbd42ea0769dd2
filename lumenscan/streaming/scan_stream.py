"""The line scanner and entropy checks over a stream of source files (stateless, append)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators import entropy, regex_rules


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive in a folder: path, basename, content."""
    rows = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), basename(path).alias("basename"), F.col("value").alias("content"))


def findings(files: DataFrame) -> DataFrame:
    """path, basename, line_no, rule_id, level, message of every file of the stream (or of a batch)."""
    lines = regex_rules.lines(files.select("path", "basename", "content"))
    columns = ["path", "basename", "line_no", "rule_id", "level", "message"]
    return regex_rules.scan_lines(lines).select(*columns).unionByName(entropy.secrets(lines).select(*columns))


def start(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Appends the findings of new files to Parquet in ``out``."""
    return findings(read_files(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
