"""Archives that grow while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.sources.archive_files import RECORDS


def record_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Records as they are committed to the archive at ``path``."""
    return spark.readStream.schema(RECORDS).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).json(path)


def best_by_generation(records: DataFrame) -> DataFrame:
    """Best accuracy and number of candidates of each generation so far: the state is a row per generation."""
    return records.filter("record_type = 'candidate'").groupBy("generation").agg(F.max("accuracy_500").alias("best"), F.count("*").alias("candidates"))
