"""Evaluation of representations: fixed validation rows, one fit per representation and training size, all of them together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log1p
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.operators import many_fits, sampling
from featurelab.plans.compiler import OperatorSpec, SharedPlan

RESULT = (
    "representation string, train_size int, feature_dim int, accuracy double, confusion_matrix array<array<bigint>>, train_feature_runtime_ms double, "
    "validation_feature_runtime_ms double, training_time_ms double, inference_time_ms double, runtime_ms double, ranking_score double"
)


#: Values of the samples' features that a task of a fit's pass has about: of samples of bounded size it takes few tasks,
#: and so few states that are merged, however many partitions the images have.
TASK_VALUES = 2_000_000


def ranking_score(small: float, large: float, feature_dim: int, runtime_ms: float) -> float:
    """As ``records.ranking_score`` has it, of numbers."""
    return 0.6 * small + 0.4 * large - 0.001 * log1p(feature_dim) - 0.0001 * log1p(runtime_ms)


@dataclass(frozen=True)
class Joint:
    """What fits of all representations and samples gave: matrices by (representation, sample), and milliseconds that
    each part took for all of them."""

    matrices: dict[tuple[int, int], list[list[int]]]
    dims: list[int]
    fit_rows: int
    held_out_rows: int
    feature_ms: float
    training_ms: float
    inference_ms: float


def fit_and_apply(images: DataFrame, lists: Sequence[Sequence[OperatorSpec]], samples: Sequence[Column], held_out: Column, controls: bool = False) -> Joint:
    """Fit every list of operators on every sample of ``images`` (conditions on its rows) and apply each fit to the rows
    of ``held_out``. Rows of neither aren't looked at. Features are extracted in one scan, fitted in joint passes and
    applied in one."""
    plan = SharedPlan(lists, controls)
    numbers = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(samples)]), lambda k: k.isNotNull())
    chosen = images.withColumns({"samples": numbers, "held_out": F.coalesce(held_out, F.lit(False))}).filter((F.size("samples") > 0) | F.col("held_out"))
    began = perf_counter()
    rows = plan.transform(chosen).select("label", "features", "samples", "held_out").persist()
    try:
        fit_rows, held_out_rows = rows.agg(F.count(F.when(F.size("samples") > 0, 1)), F.count(F.when(F.col("held_out"), 1))).first()
        extracted = perf_counter()
        models = [many_fits.Model(s, places) for places in plan.places for s in range(len(samples))]
        width = 1 + max(p for places in plan.places for p in places)
        fitted = many_fits.fit_many(rows.filter(F.size("samples") > 0).coalesce(max(1, fit_rows * width // TASK_VALUES)), models)
        trained = perf_counter()
        found = many_fits.confusion_many(rows.filter("held_out"), fitted)
        ended = perf_counter()
    finally:
        rows.unpersist()
    matrices = {(k // len(samples), k % len(samples)): m for k, m in enumerate(found)}
    return Joint(matrices, [len(p) for p in plan.places], fit_rows, held_out_rows, (extracted - began) * 1000, (trained - extracted) * 1000, (ended - trained) * 1000)


def accuracy_of(matrix: list[list[int]]) -> float:
    return sum(matrix[k][k] for k in range(len(matrix))) / sum(map(sum, matrix))


class Evaluator:
    """Holds images with labels; the split depends on the seed alone. Features are extracted of the rows that are
    needed only."""

    def __init__(self, images: DataFrame, validation: int = 2000, sizes: Sequence[int] = (500, 5000), seed: int = 42):
        self._images, self._validation, self._sizes, self._seed = images, validation, tuple(sizes), seed

    def evaluate(self, operators: Sequence[OperatorSpec], controls: bool = False) -> DataFrame:
        """One list of operators; see :meth:`evaluate_many`."""
        return self.evaluate_many([operators], controls)

    def evaluate_many(self, lists: Sequence[Sequence[OperatorSpec]], controls: bool = False) -> DataFrame:
        """A row per list and size with its accuracy, its confusion matrix (actual, then predicted) and its times. Work is
        done for all lists and sizes together, so a row's times are its even share of the whole; ``runtime_ms`` and
        ``ranking_score`` are those of the list over all sizes, the score of the first and the last size's accuracy."""
        rows = self._images.sparkSession.createDataFrame(self.rows(lists, controls), RESULT)
        return rows

    def rows(self, lists: Sequence[Sequence[OperatorSpec]], controls: bool = False) -> list[tuple]:
        """What :meth:`evaluate_many` gives, as tuples in its order."""
        SharedPlan(lists, controls)  # fails before any data is read
        labelled = self._images.select("image_id", "label")
        (out,) = sampling.stratified_samples(labelled, [(self._validation, self._seed)])
        samples = sampling.stratified_samples(labelled.filter(~out), [(size, self._seed) for size in self._sizes])
        joint = fit_and_apply(self._images, lists, [~out & s for s in samples], out, controls)
        each, fits = 1 / len(lists), len(lists) * len(self._sizes)
        per_row = joint.feature_ms * each / (joint.fit_rows + joint.held_out_rows)
        times = [per_row * size for size in self._sizes], per_row * joint.held_out_rows, joint.training_ms / fits, joint.inference_ms / fits
        rows = []
        for k, operators in enumerate(lists):
            runtime = times[1] + sum(times[0]) + (times[2] + times[3]) * len(self._sizes)
            right = [accuracy_of(joint.matrices[k, s]) for s in range(len(self._sizes))]
            score = ranking_score(right[0], right[-1], joint.dims[k], runtime)
            name = "+".join(o.name for o in operators)
            rows += [(name, size, joint.dims[k], right[s], joint.matrices[k, s], times[0][s], times[1], times[2], times[3], runtime, score) for s, size in enumerate(self._sizes)]
        return rows
