"""Runs of representations over sizes and seeds: the final evaluation with its gates, sweeps, timed features."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.operators import reports, sampling
from featurelab.plans.compiler import FeaturePipeline, OperatorSpec, RepresentationSpec
from featurelab.plans.evaluation import Evaluator, accuracy_of, fit_and_apply
from featurelab.sources import archive_files, commits

SWEEP = "candidate_id string, name string, feature_dim int, accuracy_small double, accuracy_large double, confusion_matrix array<array<bigint>>, runtime_ms double, ranking_score double"
RUN = "representation string, kind string, feature_dim int, size int, seed int, accuracy double, training_ms double, inference_ms double, feature_ms double, confusion_matrix array<array<bigint>>"


def _same_place(a: str, b: str) -> bool:
    """Whether two paths name one folder, or one of them lies in the other."""
    x, y = (posixpath.normpath(re.sub("^file:/*", "/", p)) for p in (a, b))
    return x == y or x.startswith(y + "/") or y.startswith(x + "/")


def check_arguments(sizes: Sequence[int], seeds: Sequence[int], output: str | None = None, inputs: Sequence[str] = ()) -> None:
    """Sizes and seeds are whole, not empty and not repeated, sizes positive; the output is none of the inputs, however
    their paths are written, and lies in none."""
    for name, values, least in (("sizes", sizes, 1), ("seeds", seeds, 0)):
        if not values or len(set(values)) != len(values) or any(type(v) is not int or v < least for v in values):
            raise ValueError(f"{name} must be unique whole numbers from {least} on")
    if output is not None and any(_same_place(output, i) for i in inputs):
        raise ValueError("the output may not replace an input")


def timed_features(images: DataFrame, operators: Sequence[OperatorSpec], controls: bool = False) -> tuple[DataFrame, float]:
    """(image_id, label, features) of ``images``, held in memory, and the milliseconds that took."""
    began = perf_counter()
    features = FeaturePipeline(operators, controls).transform(images).select("image_id", "label", "features").persist()
    features.count()
    return features, (perf_counter() - began) * 1000


def runs_grid(train: DataFrame, test: DataFrame, representations: Sequence[tuple[str, str, Sequence[OperatorSpec]]], sizes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """A row per representation (name, kind, operators), size and seed: fitted on a stratified sample of ``train`` and
    applied to all of ``test``. Features of all representations are extracted in one scan, and all fits go over the rows
    together, so a run's times are its even share of the whole."""
    check_arguments(sizes, seeds)
    wanted = [(size, seed) for size in sizes for seed in seeds]
    chosen = sampling.stratified_samples(train.select("image_id", "label"), wanted)
    columns = [c for c in train.columns if c in test.columns]
    both = train.select(*columns, F.lit(False).alias("_test")).unionByName(test.select(*columns, F.lit(True).alias("_test")))
    lists = [operators for _, _, operators in representations]
    joint = fit_and_apply(both, lists, [~F.col("_test") & c for c in chosen], F.col("_test"), controls=any(kind == "baseline" for _, kind, _ in representations))
    fits, rows = len(lists) * len(wanted), []
    for k, (name, kind, _) in enumerate(representations):
        for s, (size, seed) in enumerate(wanted):
            matrix = joint.matrices[k, s]
            rows.append((name, kind, joint.dims[k], size, seed, accuracy_of(matrix), joint.training_ms / fits, joint.inference_ms / fits, joint.feature_ms / len(lists), matrix))
    return train.sparkSession.createDataFrame(rows, RUN)


def combined_matrix(runs: DataFrame) -> DataFrame:
    """(representation, size, actual, predicted, n): the runs' matrices added over seeds."""
    cells = runs.select("representation", "size", F.posexplode("confusion_matrix").alias("actual", "row")).select("representation", "size", "actual", F.posexplode("row").alias("predicted", "n"))
    return cells.groupBy("representation", "size", "actual", "predicted").agg(F.sum("n").alias("n"))


def final_evaluation(train: DataFrame, test: DataFrame, finalists: str, specs: Sequence[RepresentationSpec], sizes: Sequence[int] = (250, 500, 1_000, 5_000, 60_000), seeds: Sequence[int] = (11, 23, 47), output: str | None = None) -> DataFrame:
    """Runs of the frozen ``finalists`` (a folder; ``specs`` gives their specifications) and of the controls. Arguments,
    the archive's checksum, the identities of the specifications, the number of training rows and the output, which may
    be neither there already nor an input, are checked before ``test`` is read."""
    check_arguments(sizes, seeds, output, [finalists])
    spark = train.sparkSession
    frozen = archive_files.frozen_finalists(spark, finalists).select("candidate_id", "operators", "test_set_accessed", "search_archive").collect()  # eight at most
    check_arguments(sizes, seeds, output, [r.search_archive for r in frozen])
    if output is not None and commits.exists(spark, output):
        raise ValueError(f"{output} is there already")
    if max(sizes) > (rows := train.count()):
        raise ValueError(f"there are {rows} training rows, too few for a sample of {max(sizes)}")
    known = {s.spec_hash(): s for s in specs}
    if len({r.candidate_id for r in frozen}) != len(frozen) or any(r.test_set_accessed for r in frozen):
        raise ValueError("finalists must be unique and chosen without the test rows")
    if missing := [r.candidate_id for r in frozen if r.candidate_id not in known]:
        raise ValueError(f"no specification has the identity {missing[0]}")
    if wrong := [r.candidate_id for r in frozen if [o.name for o in known[r.candidate_id].operators] != list(r.operators)]:
        raise ValueError(f"the operators of {wrong[0]} differ from its specification's")
    grid = [(known[r.candidate_id].name, "finalist", known[r.candidate_id].operators) for r in frozen]
    grid += [(name, "baseline", (OperatorSpec(operator),)) for name, operator, _ in reports.CONTROLS]
    runs = runs_grid(train, test, grid, sizes, seeds)
    if output is not None:
        runs.write.json(output)
    return runs


def check_provenance(spark, finalists: str, accessed: bool, checksum: str) -> None:
    """Reports are of test rows that were read after the choice was frozen, and of the archive it was made from."""
    if accessed is not True:
        raise ValueError("the report doesn't say that the test rows were read")
    frozen = archive_files.frozen_finalists(spark, finalists).select("search_archive_sha256").distinct().collect()  # one
    if [r[0] for r in frozen] != [checksum]:
        raise ValueError("the report isn't of this choice's archive")


def seed_sweep(images: DataFrame, specs: Sequence[RepresentationSpec], validation: int, sizes: Sequence[int], seed: int = 42) -> DataFrame:
    """Evaluation of each specification: identity, name, and the columns of the evaluator's result for the largest size
    with the accuracies of both."""
    evaluator = Evaluator(images, validation, sizes, seed)
    by_spec: list[list[tuple]] = [[] for _ in specs]
    for k, row in enumerate(evaluator.rows([s.operators for s in specs])):
        by_spec[k // len(sizes)].append(row)
    rows = []
    for spec, own in zip(specs, by_spec):
        small, large = (f(own, key=lambda r: r[1]) for f in (min, max))
        rows.append((spec.spec_hash(), spec.name, large[2], small[3], large[3], large[4], large[9], large[10]))
    return images.sparkSession.createDataFrame(rows, SWEEP)
