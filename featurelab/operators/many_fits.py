"""Many multinomial models fitted together: every pass over the rows serves all of them.

Rows carry the numbers of the samples they belong to; a model is a sample and the places of its features. One pass sums
loss and gradient of every model that isn't done, each at the point that its own optimiser asks for; the optimisers
(limited-memory BFGS, one a model) run on the driver over coefficients only, which are models x classes x features.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.operators import merging

Point = Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, int]]


@dataclass(frozen=True)
class Model:
    """One fit: rows of ``sample``, features at ``places`` of the wide vector."""

    sample: int
    places: tuple[int, ...] = field(repr=False)


@dataclass(frozen=True)
class Fitted:
    labels: list
    places: np.ndarray = field(repr=False)
    mean: np.ndarray = field(repr=False)
    std: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)  # classes x (features + 1), the last is the intercept
    steps: int
    gradient_norm: float

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """Places among ``labels`` for rows of the wide vector; ties go to the first."""
        z = (x[:, self.places] - self.mean) / self.std
        return np.argmax(z @ self.weights[:, :-1].T + self.weights[:, -1], axis=1)


def minimised(start: np.ndarray, most: int, tolerance: float, memory: int = 12) -> Point:
    """Yields points, is sent (value, gradient) of each, and returns the last point and the number of steps. Steps are
    shortened until the value falls enough, or, where its digits don't tell any more, the gradient does."""
    x = start
    f, g = yield x
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(most):
        norm = np.abs(g).max()
        if norm <= tolerance:
            return x, step
        d, alphas = -g, []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            d = d + (a - r * (y @ d)) * s
        slope, length = g @ d, 1.0 if pairs else min(1.0, 1.0 / np.abs(g).sum())
        if slope >= 0:
            d, slope, pairs = -g, -(g @ g), []
        for _ in range(30):
            new = x + length * d
            f2, g2 = yield new
            if f2 <= f + 1e-4 * length * slope or (f2 - f <= 1e-13 * abs(f) and np.abs(g2).max() < norm):
                break
            length /= 2
        else:
            return x, step
        s, y = new - x, g2 - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        x, f, g = new, f2, g2
    return x, most


def _members(column: pa.Array, samples: int) -> list[np.ndarray]:
    """Of each sample the rows of the batch that belong to it."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    of = column.flatten().to_numpy()
    order = np.argsort(of, kind="stable")
    return np.split(row[order], np.searchsorted(of[order], np.arange(samples + 1)))[1:-1]  # without numbers that no model has


def fit_many(rows: DataFrame, models: Sequence[Model], c: float = 1.0, most_steps: int = 1000, tolerance: float = 1e-8) -> list[Fitted]:
    """The fits of ``models`` on ``rows`` (label, features, samples array<int>): standardised features, mean log loss plus
    |weights|^2 / (2 c n), intercepts free. ``rows`` should be held: they are read once a step of the slowest model."""
    if not models:
        return []
    samples = max(m.sample for m in models) + 1
    sizes = rows.select("label", F.size("features").alias("width"), F.explode("samples").alias("sample"))
    counts = sizes.groupBy("sample", "label").agg(F.max("width").alias("width")).collect()  # samples x classes
    width = max((r.width for r in counts), default=0)
    labels: list[list] = [sorted(r.label for r in counts if r["sample"] == k) for k in range(samples)]
    for m in models:
        if not labels[m.sample]:
            raise ValueError("features must not be empty")
        if len(labels[m.sample]) < 2:
            raise ValueError("training needs two classes at least")
    data, tasks = rows.select("label", "features", "samples"), rows.rdd.getNumPartitions()

    def scales(batch: pa.RecordBatch) -> list[merging.Moments]:
        x = merging.matrix(batch.column(1), width)
        if not np.isfinite(x).all():
            raise ValueError("features must be finite")
        return [merging.moments(x[at]) for at in _members(batch.column(2), samples)]

    found = merging.merged(data, scales, lambda a, b: [merging.merge_moments(p, q) for p, q in zip(a, b)], tasks=tasks)
    scale = [(mean, np.where(squares > 0, np.sqrt(squares / max(n, 1)), 1.0)) for n, mean, squares in found]
    sizes = [f[0] for f in found]
    places = [np.array(m.places) for m in models]
    shapes = [(len(labels[m.sample]), len(m.places) + 1) for m in models]

    def losses(points: dict[int, np.ndarray]) -> dict[int, list]:
        def of_batch(batch: pa.RecordBatch) -> dict[int, list]:
            x, members = merging.matrix(batch.column(1), width), _members(batch.column(2), samples)
            label, out = batch.column(0).to_numpy(), {}
            for k, w in points.items():
                s = models[k].sample
                at, (mean, std) = members[s], scale[s]
                z = (x[np.ix_(at, places[k])] - mean[places[k]]) / std[places[k]]
                scores = z @ w[:, :-1].T + w[:, -1]
                scores -= scores.max(axis=1, keepdims=True)
                p = np.exp(scores)
                total = p.sum(axis=1)
                true, each = np.searchsorted(labels[s], label[at]), np.arange(len(at))
                loss = float((np.log(total) - scores[each, true]).sum())
                p /= total[:, None]
                p[each, true] -= 1
                out[k] = [loss, np.column_stack([p.T @ z, p.sum(axis=0)])]
            return out

        return merging.merged(data, of_batch, lambda a, b: {k: [u + v for u, v in zip(a[k], b[k])] for k in a}, tasks=tasks)

    optimisers = [minimised(np.zeros(a * b), most_steps, tolerance) for a, b in shapes]
    asked = {k: next(o) for k, o in enumerate(optimisers)}
    ended: dict[int, tuple[np.ndarray, int, float]] = {}
    while asked:
        got, following = losses({k: x.reshape(shapes[k]) for k, x in asked.items()}), {}
        for k, x in asked.items():
            n, w = sizes[models[k].sample], x.reshape(shapes[k])
            pull = w / (c * n)
            pull[:, -1] = 0
            value, gradient = got[k][0] / n + 0.5 * float((pull * w).sum()), got[k][1] / n + pull
            try:
                following[k] = optimisers[k].send((value, gradient.ravel()))
            except StopIteration as end:
                ended[k] = (end.value[0].reshape(shapes[k]), end.value[1], float(np.abs(gradient).max()))
        asked = following
    return [Fitted(labels[m.sample], places[k], scale[m.sample][0][places[k]], scale[m.sample][1][places[k]], *ended[k]) for k, m in enumerate(models)]


def predict_many(rows: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """(label, predicted) of ``rows`` (label, features), with an element of ``predicted`` for each model."""

    def predict(batches):
        for batch in batches:
            x = merging.matrix(batch.column(1), None)
            found = [np.array(m.labels, dtype=np.int64)[m.predicted(x)] for m in fitted] if batch.num_rows else []
            lists = pa.array(list(np.column_stack(found)) if found else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["label", "predicted"])

    return rows.select("label", "features").mapInArrow(predict, "label bigint, predicted array<bigint>")


def confusion_many(rows: DataFrame, fitted: Sequence[Fitted]) -> list[list[list[int]]]:
    """Each model's matrix (actual, then predicted), over classes from 0 to the largest of any label: one pass and one
    aggregate for all."""
    each = predict_many(rows, fitted).select("label", F.posexplode("predicted").alias("model", "predicted"))
    cells = each.groupBy("model", "label", "predicted").count().collect()  # models x classes x classes
    classes = 1 + max([int(r[k]) for r in cells for k in ("label", "predicted")] + [int(x) for m in fitted for x in m.labels], default=-1)
    out = [[[0] * classes for _ in range(classes)] for _ in fitted]
    for r in cells:
        out[r.model][r.label][r.predicted] = r["count"]
    return out


def gradients(rows: DataFrame, model: Fitted, c: float = 1.0) -> DataFrame:
    """(label, dim, gradient) of the regularised loss of ``rows`` (label, features) at the model's weights; the last dim is
    the intercept. By columns only, apart from the code that fits: where all are 0, the model is the fit, as the loss is
    convex."""
    array = lambda values: F.array(*[F.lit(float(v)) for v in values])
    mean, std = array(model.mean), array(model.std)
    x = F.transform(F.array(*map(F.lit, map(int, model.places))), lambda p: F.get("features", p))
    z = F.concat(F.transform(x, lambda v, i: (v - F.get(mean, i)) / F.get(std, i)), F.array(F.lit(1.0)))
    df = rows.select("label", z.alias("z"))
    dot = lambda w: F.aggregate(F.zip_with("z", array(w), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    df = df.select("label", "z", F.array(*map(dot, model.weights)).alias("s"))
    df = df.select("label", "z", F.transform("s", lambda v: F.exp(v - F.array_max("s"))).alias("e"))
    df = df.select("label", "z", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda t, u: t + u)).alias("p"))
    labels = F.array(*map(F.lit, model.labels))
    each = df.select("z", F.posexplode(F.zip_with("p", labels, lambda p, k: p - (F.col("label") == k).cast("double"))).alias("class", "r"))
    cells = each.select("class", "r", F.posexplode("z").alias("dim", "v"))
    sums = cells.groupBy("class", "dim").agg(F.sum(F.col("r") * F.col("v")).alias("g"), F.count("*").alias("n"))
    weights = F.array(*[array([*w[:-1], 0.0]) for w in model.weights])  # intercepts are free
    return sums.select(F.get(labels, F.col("class")).alias("label"), "dim", ((F.col("g") + F.get(F.get(weights, F.col("class")), F.col("dim")) / c) / F.col("n")).alias("gradient"))
