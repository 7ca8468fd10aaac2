"""Labelled 28 x 28 images derived from the ``embeddings`` table: a shifted seven-segment glyph per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 28
#: Each segment's rows, columns and the labels that light it.
SEGMENTS = {
    "top": ((4, 5), (9, 18), (0, 2, 3, 5, 6, 7, 8, 9)),
    "middle": ((13, 14), (9, 18), (2, 3, 4, 5, 6, 8, 9)),
    "bottom": ((22, 23), (9, 18), (0, 2, 3, 5, 6, 8, 9)),
    "upper_left": ((4, 14), (9, 10), (0, 4, 5, 6, 8, 9)),
    "upper_right": ((4, 14), (17, 18), (0, 1, 2, 3, 4, 7, 8, 9)),
    "lower_left": ((13, 23), (9, 10), (0, 2, 6, 8)),
    "lower_right": ((13, 23), (17, 18), (0, 1, 3, 4, 5, 6, 7, 8, 9)),
}


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, pixels): 784 doubles between 0 and 1 by row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label")

    def pixel(i):
        row, col = F.floor(i / SIDE).cast("int"), (i % SIDE).cast("int")
        r = row - (F.col("image_id") % 5 - 2)
        c = col - ((3 * F.col("image_id")) % 7 - 3)
        lit = F.lit(False)
        for (r0, r1), (c0, c1), labels in SEGMENTS.values():
            lit = lit | (F.col("label").isin(*labels) & r.between(r0, r1) & c.between(c0, c1))
        return F.when(lit, (200 + (7 * F.col("image_id") + 3 * row + col) % 56).cast("double") / 255).otherwise(0.0)

    return e.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel))


def glyph_sql() -> str:
    """The same view for the SQL side: ``px`` (image_id, label, r, c, v)."""
    lit = " OR ".join(
        f"(label IN ({', '.join(map(str, labels))}) AND r - (vec_id % 5 - 2) BETWEEN {r0} AND {r1} AND c - ((3 * vec_id) % 7 - 3) BETWEEN {c0} AND {c1})" for (r0, r1), (c0, c1), labels in SEGMENTS.values()
    )
    return f"""px AS (SELECT vec_id AS image_id, label, r, c,
  CASE WHEN {lit} THEN CAST(200 + (7 * vec_id + 3 * r + c) % 56 AS DOUBLE) / 255 ELSE 0.0::DOUBLE END AS v
  FROM embeddings, (SELECT unnest(range(28)) AS r), (SELECT unnest(range(28)) AS c))"""
