"""Data of reports: unique representations, learning curves, costs, ablations, summaries of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The name of a representation that was evaluated twice, and the controls beside the finalists.
TWICE = "raw pixels (candidate and baseline)"
CONTROLS = (("raw_pixels_baseline", "raw_pixels", 784), ("hog_9bin_4x4_baseline", "hog", 1296))


def unique(results: DataFrame) -> DataFrame:
    """The first (by ``ord``) of ``results`` with the same ``key``; one that stands for several has another name."""
    first = results.groupBy("key").agg(F.min_by(F.struct("ord", "name", "kind", "feature_dim"), "ord").alias("r"), F.count("*").alias("n"), F.max("feature_ms").alias("feature_ms"))
    return first.select("key", "r.ord", F.when(F.col("n") > 1, F.lit(TWICE)).otherwise(F.col("r.name")).alias("name"), "r.kind", "r.feature_dim", "feature_ms")


def size_summaries(runs: DataFrame) -> DataFrame:
    """By representation (``ord``) and size: mean and sample deviation (0 for one run) of accuracy, mean times."""
    return runs.groupBy("ord", "size").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("accuracy_std"), F.avg("training_ms").alias("training_ms"), F.avg("inference_ms").alias("inference_ms")
    )


def learning_curve(results: DataFrame, runs: DataFrame) -> DataFrame:
    return unique(results).join(size_summaries(runs), "ord").select("name", "kind", "size", "accuracy_mean", "accuracy_std")


def dimension_and_accuracy(results: DataFrame, runs: DataFrame, size: int = 500) -> DataFrame:
    return unique(results).join(size_summaries(runs).filter(F.col("size") == size), "ord").select("name", "kind", "feature_dim", "accuracy_mean", "accuracy_std")


def runtime_and_accuracy(results: DataFrame, runs: DataFrame, size: int = 500) -> DataFrame:
    """Seconds of a representation: the largest cost of its features, a fit and an inference on the average."""
    both = unique(results).join(size_summaries(runs).filter(F.col("size") == size), "ord")
    seconds = (F.col("feature_ms") + F.col("training_ms") + F.col("inference_ms")) / 1000
    return both.select("name", "kind", seconds.alias("seconds"), "accuracy_mean")


def ablation_contributions(deltas: DataFrame) -> DataFrame:
    """Points that a removed operator was worth, of (candidate_id, generation, removed_operator, delta), least first."""
    label = F.concat(F.lit("G"), F.col("generation").cast("string"), F.lit(" −"), F.col("removed_operator"), F.lit(" · "), F.substring("candidate_id", 1, 6))
    return deltas.select("candidate_id", label.alias("label"), F.round(F.col("delta") * 100, 4).alias("points"), (F.col("delta") > 0).alias("useful")).orderBy("points", "candidate_id")


def representations(finalists: DataFrame) -> DataFrame:
    """Finalists (candidate_id, roles, feature_dim) and the controls."""
    spark = finalists.sparkSession
    own = finalists.select(F.col("candidate_id").alias("name"), F.lit("finalist").alias("kind"), "candidate_id", "roles", F.col("feature_dim").cast("int").alias("feature_dim"))
    controls = spark.createDataFrame([(name, "baseline", None, "", dim) for name, _, dim in CONTROLS], own.schema)
    return own.unionByName(controls)


def conflicts(records: DataFrame) -> DataFrame:
    """Ids that stand for different contents, all fields but the place in the archive compared."""
    body = F.to_json(F.struct(*[c for c in sorted(records.columns) if c != "seq"]))
    return records.groupBy("candidate_id").agg(F.count_distinct(F.sha2(body, 256)).alias("versions")).filter("versions > 1")


def new_record_totals(records: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates in all, those not in ``known`` (candidate_id), and ablations not in it."""
    is_new = records.join(known.select("candidate_id").distinct().withColumn("_known", F.lit(True)), "candidate_id", "left").withColumn("_new", F.col("_known").isNull())
    candidate, ablation = F.col("record_type") == "candidate", F.col("record_type") == "ablation"
    return is_new.agg(F.count_if(candidate).alias("candidates"), F.count_if(candidate & F.col("_new")).alias("candidates_added"), F.count_if(ablation & F.col("_new")).alias("ablations_added"))


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` (candidate_id), each id with whether it is in the archive."""
    found = records.dropDuplicates(["candidate_id"]).withColumn("found", F.lit(True))
    return ids.select("candidate_id").distinct().join(found, "candidate_id", "left").withColumn("found", F.col("found").isNotNull())


def numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their place in ``order``, for short reports."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
