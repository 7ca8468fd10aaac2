"""Queries over an archive of search records: eligibility, ranking, selection, ablation, feedback, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY_SCORE = (F.desc, ("ranking_score", "accuracy_500", "accuracy_5000")), (F.asc, ("feature_dim", "candidate_id"))
BY_ACCURACY = (F.desc, ("accuracy_500", "accuracy_5000")), (F.asc, ("feature_dim", "runtime_ms", "candidate_id"))


def _order(spec: tuple) -> list:
    return [f(c) for f, columns in spec for c in columns]


def rankable(records: DataFrame) -> DataFrame:
    """Candidates, and ablations that are strictly more accurate than the record they come from. Only ablations are
    joined, by sort and merge: there is a base per record, too many for the driver to broadcast."""
    base = records.select(F.col("candidate_id").alias("_id"), F.col("accuracy_500").alias("_base"))
    candidate = F.coalesce(F.col("record_type") == "candidate", F.lit(False))
    better = records.filter(~candidate).join(base.hint("merge"), (F.col("base_candidate_id") == F.col("_id")) & (F.col("accuracy_500") > F.col("_base")))
    return records.filter(candidate).unionByName(better.drop("_id", "_base"))


def top(records: DataFrame, k: int, by: tuple = BY_SCORE) -> DataFrame:
    if type(k) is not int or k < 1:
        raise ValueError("k must be a positive integer")
    return rankable(records).orderBy(*_order(by)).limit(k)


def with_roles(records: DataFrame, forced_id: str | None = None) -> DataFrame:
    """Finalists with their roles: five best by accuracy, the smallest, the fastest and a forced one."""
    best = top(records, 5, BY_ACCURACY)
    rank = F.row_number().over(Window.orderBy(*_order(BY_ACCURACY)))
    chosen = best.select("candidate_id", F.concat(F.lit("top_5_low_data_accuracy_rank_"), rank.cast("string")).alias("role"), rank.alias("ord"))
    for at, (role, keys) in enumerate((("smallest_representation", ["feature_dim", "-accuracy_500", "runtime_ms", "candidate_id"]), ("fastest_representation", ["runtime_ms", "-accuracy_500", "feature_dim", "candidate_id"])), 6):
        order = [F.desc(x[1:]) if x[0] == "-" else F.asc(x) for x in keys]
        chosen = chosen.unionByName(rankable(records).orderBy(*order).limit(1).select("candidate_id", F.lit(role).alias("role"), F.lit(at).alias("ord")))
    if forced_id:
        chosen = chosen.unionByName(records.filter((F.col("candidate_id") == forced_id) & (F.col("record_type") == "candidate")).select("candidate_id", F.lit("original_stroke_flow_hypothesis").alias("role"), F.lit(8).alias("ord")))
    roles = chosen.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.min("ord").cast("bigint").alias("ord"))
    return F.broadcast(roles).join(records.select("candidate_id", "accuracy_500", "feature_dim"), "candidate_id")  # eight rows at most


def ablation_candidates(records: DataFrame, elites: int = 5) -> DataFrame:
    """Each elite without one of its distinct operators; nothing where none would be left."""
    e = top(records, elites).select(F.col("candidate_id").alias("parent_id"), "operators", F.posexplode("operators").alias("pos", "removed"))
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy("parent_id", "removed").orderBy("pos"))).filter("_n = 1 and size(operators) > 1")
    rest = F.filter("operators", lambda x, i: i != F.col("pos"))
    return first.select("parent_id", "removed", F.array_join(rest, ",").alias("remaining"), F.substring(F.sha2("removed", 256), 1, 8).alias("suffix"))


def ablation_deltas(records: DataFrame, *more: str) -> DataFrame:
    """Accuracy of each ablation's base, its own, what the operator was worth, and columns ``more`` of the ablation."""
    base = records.select(F.col("candidate_id").alias("base_candidate_id"), F.col("accuracy_500").alias("with_operator"))
    a = records.filter("record_type = 'ablation'").select("candidate_id", "base_candidate_id", "removed_operator", F.col("accuracy_500").alias("without_operator"), *more)
    return a.join(base.hint("merge"), "base_candidate_id").withColumn("delta", F.round(F.col("with_operator") - F.col("without_operator"), 6))


def dedupe_proposals(specs: DataFrame, history: DataFrame) -> DataFrame:
    """Proposals (ord, operators, category) whose operators, in any order, are neither in ``history`` nor earlier
    in the batch; categories are assigned before, so survivors keep their slots'."""
    key = F.array_join(F.array_sort("operators"), ",")
    first = specs.withColumn("key", key).withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).filter("_n = 1").drop("_n")
    return first.join(history.select(key.alias("key")).distinct(), "key", "left_anti")


def confusion_pairs(cells: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent confusions of (actual, predicted, n)."""
    return cells.filter("actual <> predicted and n > 0").orderBy(F.desc("n"), "actual", "predicted").limit(k)


def matrix_cells(records: DataFrame) -> DataFrame:
    """(candidate_id, actual, predicted, n): the cells of the records' own confusion matrices."""
    rows = records.select("candidate_id", F.posexplode("confusion_matrix").alias("actual", "_row"))
    return rows.select("candidate_id", "actual", F.posexplode("_row").alias("predicted", "n"))


def feedback(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts of each target pair before and after, and the improvement."""
    after = cells.withColumnRenamed("n", "candidate_count")
    out = targets.withColumnRenamed("n", "baseline_count").join(after, ["actual", "predicted"])
    return out.withColumn("improvement", F.col("baseline_count") - F.col("candidate_count"))


def best_so_far(records: DataFrame) -> DataFrame:
    """Best accuracy of each generation and of all up to it."""
    g = records.filter("record_type = 'candidate'").groupBy("generation").agg(F.max("accuracy_500").alias("best"), F.count("*").alias("candidates"))
    return g.withColumn("best_so_far", F.max("best").over(Window.orderBy("generation")))


def summaries(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation (0 for one run) by representation and size."""
    return runs.groupBy("representation", "size").agg(F.round(F.avg("accuracy"), 6).alias("mean_accuracy"), F.round(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 6).alias("std_accuracy"), F.count("*").alias("n"))


def conflicts(records: DataFrame) -> DataFrame:
    """Ids that stand for different contents."""
    body = F.concat_ws("|", "record_type", F.array_join("operators", ","), F.col("generation").cast("string"))
    return records.groupBy("candidate_id").agg(F.count_distinct(body).alias("versions")).filter("versions > 1")


def token_usage(turns: DataFrame) -> DataFrame:
    """Words of prompts and of the answers that follow; rows without an answer make the sums incomplete."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).cast("bigint")
    ask = turns.filter("role = 'user'").select("conv_id", "turn", words.alias("prompt_tokens"))
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), words.alias("response_tokens"))
    both = ask.join(answer, ["conv_id", "turn"], "left")
    known = F.col("response_tokens").isNotNull()
    return both.agg(F.coalesce(F.sum(F.when(known, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("response_tokens"), F.lit(0)).alias("response_tokens"), F.bool_and(known).alias("complete"), F.count("*").alias("requests"))
