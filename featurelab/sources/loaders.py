"""Labelled images by row number: a scan with its checks, the rows a search may see, and the final partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.operators import sampling

SIDE = 28


@dataclass(frozen=True)
class DataConfig:
    """Seed, validation rows, and how many rows are for training and for the final test."""

    seed: int = 42
    validation: int = 2_000
    train_rows: int = 60_000
    test_rows: int = 10_000

    def __post_init__(self) -> None:
        for name in ("seed", "validation", "train_rows", "test_rows"):
            if type(getattr(self, name)) is not int:
                raise ValueError(f"{name} must be an integer")
        if not 0 <= self.seed < 1 << 32:
            raise ValueError("seed must fit in 32 bits without a sign")
        if min(self.validation, self.train_rows, self.test_rows) < 1:
            raise ValueError("sizes must be positive")
        if self.validation >= self.train_rows:
            raise ValueError("validation must be smaller than the training rows")


def scan(raw: DataFrame, config: DataConfig) -> DataFrame:
    """(image_id, label, pixels between 0 and 1) of ``raw`` (image_id, the row number; label; pixels of 0 to 255).
    Another number of rows, a row number out of place, a label that isn't a whole number or a pixel out of range is an
    error."""
    rows, expected = raw.agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("ids"), F.min("image_id").alias("low"), F.max("image_id").alias("high")).first(), config.train_rows + config.test_rows
    if (rows.n, rows.ids, rows.low, rows.high) != (expected, expected, 0, expected - 1):
        raise ValueError(f"the images must be {expected} rows, numbered from 0")
    bad = F.exists("pixels", lambda x: x.isNull() | F.isnan(x.cast("double")) | (x < 0) | (x > 255))
    sound = F.coalesce((F.size("pixels") == SIDE * SIDE) & ~bad & (F.col("label") == F.floor("label")) & (F.col("label") >= 0), F.lit(False))
    pixels = F.transform("pixels", lambda x: x.cast("double") / 255)
    return raw.select("image_id", F.col("label").cast("int").alias("label"), F.when(sound, pixels).otherwise(F.raise_error(F.lit("an image has 784 values of 0 to 255 and a label"))).alias("pixels"))


def search_rows(images: DataFrame, config: DataConfig) -> DataFrame:
    """The training rows with ``split``: train or validation. Test rows are not in it."""
    rows = images.filter(F.col("image_id") < config.train_rows)
    chosen = sampling.stratified_sample(rows, config.validation, config.seed)
    return chosen.withColumn("split", F.when(F.col("chosen"), "validation").otherwise("train")).drop("chosen")


def final_rows(images: DataFrame, config: DataConfig) -> DataFrame:
    """All rows with ``split``: train or test, by row number."""
    return images.withColumn("split", F.when(F.col("image_id") < config.train_rows, "train").otherwise("test"))
