"""Fits of many models in joint passes, plans shared by representations, samples by thresholds, mergeable moments."""

import hashlib
import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators import learning, many_fits, merging, sampling
from featurelab.plans import evaluation, runs
from featurelab.plans.compiler import CompilationError, OperatorSpec, SharedPlan, compile_spec, seed_specs
from featurelab.plans.search import Search, evaluated_together
from featurelab.sources import glyphs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    """Five features of 240 rows of three classes, one constant; samples: all, the even ones, every third with one class less."""
    random = np.random.default_rng(4)
    x = np.column_stack([random.standard_normal((240, 4)), np.ones(240)])
    label = (x[:, 0] + 0.5 * random.standard_normal(240) > 0).astype(int) + (x[:, 1] > 0.7)
    rows = [(7 * int(k), v.tolist(), [s for s, c in enumerate((True, i % 2 == 0, i % 3 == 0 and k < 2)) if c]) for i, (k, v) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, "label int, features array<double>, samples array<int>").repartition(5).persist()


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_fits_agree_with_single_ones(spark, features):
    models = [many_fits.Model(s, places) for s in range(3) for places in (tuple(range(5)), (3, 0), (1,))]
    fitted = many_fits.fit_many(features, models, tolerance=1e-10)
    for m, f in zip(models, fitted):
        rows = features.filter(F.array_contains("samples", m.sample)).withColumn("features", F.array(*[F.get("features", F.lit(p)) for p in m.places]))
        single = learning.Learner(tol=1e-14).fit(rows)
        assert f.labels == single._labels and f.gradient_norm <= 1e-10
        assert np.abs(f.weights[:, :-1] - single._model.coefficientMatrix.toArray()).max() < 1e-6 if len(f.labels) > 2 else True
        assert np.allclose(f.mean, single._mean) and np.allclose(f.std, single._std)
        one = many_fits.confusion_many(rows.withColumn("features", F.col("features")), [many_fits.Fitted(f.labels, np.arange(len(m.places)), f.mean, f.std, f.weights, 0, 0.0)])[0]
        cells = {(r.actual, r.predicted): r.n for r in learning.confusion(single.predict(rows), classes=len(one)).collect()}
        assert one == [[cells[a, b] for b in range(len(one))] for a in range(len(one))]
    assert many_fits.fit_many(features, []) == []


def test_gradients_tell_a_fit_from_a_perturbed_one(spark, features):
    (f,) = many_fits.fit_many(features, [many_fits.Model(1, (0, 1, 4))], tolerance=1e-10)
    rows = features.filter(F.array_contains("samples", 1))
    good = many_fits.gradients(rows, f).collect()
    assert {(r.label, r.dim) for r in good} == {(k, d) for k in f.labels for d in range(4)} and max(abs(r.gradient) for r in good) < 1e-9
    for k in range(f.weights.size):
        w = f.weights.copy()
        w.ravel()[k] += 1e-4  # of the constant feature, only the penalty tells: 1e-4 over 120 rows
        assert max(abs(r.gradient) for r in many_fits.gradients(rows, many_fits.Fitted(f.labels, f.places, f.mean, f.std, w, 0, 0.0)).collect()) > 1e-7


def test_many_fits_take_the_passes_of_one(spark, features, monkeypatch):
    real, passes = merging.merged, []
    monkeypatch.setattr(merging, "merged", lambda *a, **b: passes.append(1) or real(*a, **b))
    alone = []
    models = [many_fits.Model(s, places) for s in range(3) for places in ((0, 1, 2, 3, 4), (0, 1), (2, 3), (1,))]
    for m in models:
        passes.clear()
        many_fits.fit_many(features, [m])
        alone.append(len(passes))
    passes.clear()
    many_fits.fit_many(features, models)
    assert len(passes) == max(alone) and sum(alone) > 6 * len(passes)


def test_fits_refuse_what_cannot_be_fitted(spark, features):
    with pytest.raises(ValueError, match="empty"):
        many_fits.fit_many(features, [many_fits.Model(5, (0,))])
    with pytest.raises(ValueError, match="two classes"):
        many_fits.fit_many(features.filter("label = 0"), [many_fits.Model(0, (0,))])
    for bad in ([1.0, float("nan"), 1.0, 1.0, 1.0], [1.0, None, 1.0, 1.0, 1.0], [1.0]):
        with pytest.raises(Exception, match="features must"):
            many_fits.fit_many(features.union(spark.createDataFrame([(0, bad, [0])], features.schema)), [many_fits.Model(0, (0,))])


@pytest.mark.parametrize("seed", range(3))
def test_minimised_finds_the_least_point(seed):
    random = np.random.default_rng(seed)
    a = random.standard_normal((8, 8))
    a = a @ a.T + np.diag(10.0 ** np.arange(-2, 6))
    b = random.standard_normal(8)
    points = many_fits.minimised(np.zeros(8), 500, 1e-9)
    x = next(points)
    try:
        while True:
            x = points.send((0.5 * x @ a @ x - b @ x, a @ x - b))
    except StopIteration as end:
        found, steps = end.value
    assert np.abs(a @ found - b).max() <= 1e-8 and 0 < steps < 500


def test_moments_merge_at_large_means():
    random = np.random.default_rng(1)
    x = 1e9 + random.standard_normal((1000, 3))
    parts = [merging.moments(p) for p in np.split(x, [0, 1, 10, 400])]
    total = parts[0]
    for p in parts[1:]:
        total = merging.merge_moments(total, p)
    exact = x - 1e9
    assert total[0] == 1000 and np.allclose(total[1] - 1e9, exact.mean(axis=0), atol=1e-6) and np.allclose(total[2], ((exact - exact.mean(axis=0)) ** 2).sum(axis=0), rtol=1e-6)


def test_statistics_make_no_row_of_a_feature(spark, features):
    got = learning.scale_statistics(features)
    assert "Generate" not in explained(got)
    x = np.array([r.features for r in features.collect()])
    rows = {r.dim: r for r in got.collect()}
    assert np.allclose([rows[k].mean for k in range(5)], x.mean(axis=0)) and np.allclose([rows[k].std for k in range(4)], x.std(axis=0)[:4]) and rows[4].std == 1
    assert learning.scale_statistics(features.limit(0)).count() == 0


# ---------------------------------------------------------------- samples


def brute_sample(rows, size, seed):
    by = {}
    for i, label in rows:
        by.setdefault(label, []).append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    exact = {k: len(v) * size / len(rows) for k, v in by.items()}
    quota = {k: int(x) for k, x in exact.items()}
    for k in sorted(quota, key=lambda k: (quota[k] - exact[k], k))[: size - sum(quota.values())]:
        quota[k] += 1
    return {i for k, v in by.items() for _, i in sorted(v)[: quota[k]]}


def test_samples_are_exact_and_shuffle_no_rows(spark):
    rows = [(i, (i * i) % 7 if i % 3 else 9) for i in range(3000)]
    df = spark.createDataFrame(rows, "image_id bigint, label bigint").repartition(6)
    wanted = [(size, seed) for size in (10, 333, 2990, 3000) for seed in (1, 42)]
    conditions = sampling.stratified_samples(df, wanted)
    got = df.select("image_id", *[c.alias(f"c{k}") for k, c in enumerate(conditions)])
    assert explained(got).count("Exchange") == 1  # the test's own
    found = got.collect()
    for k, (size, seed) in enumerate(wanted):
        mine = {r.image_id for r in found if r[f"c{k}"]}
        assert len(mine) == size and mine == brute_sample(rows, size, seed)
    for bad in ((0, 1), (3001, 1), (3, 1), (2998, 1)):
        with pytest.raises(ValueError):
            sampling.stratified_samples(df, [bad])
    with pytest.raises(ValueError, match="label"):
        sampling.stratified_samples(df.union(spark.createDataFrame([(-1, None)], df.schema)), [(100, 1)])
    names = spark.createDataFrame([(f"id{i}", "even" if i % 2 == 0 else "odd") for i in range(40)], "image_id string, label string")
    assert names.filter(sampling.stratified_samples(names, [(10, 3)])[0]).groupBy("label").count().orderBy("label").collect() == [("even", 5), ("odd", 5)]


# ---------------------------------------------------------------- shared plans


def test_five_specifications_share_one_scan_and_one_pass(spark, tmp_path):
    glyphs.images(spark, SMALL).limit(40).write.parquet(f"{tmp_path}/i")
    images = spark.read.parquet(f"{tmp_path}/i")
    specs = seed_specs()
    plan = SharedPlan([s.operators for s in specs])
    wide = plan.transform(images)
    text = explained(wide)
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    rows = {r.image_id: r for r in wide.select("image_id", *[plan.sliced(k).alias(f"s{k}") for k in range(5)]).collect()}
    for k, s in enumerate(specs):
        for r in compile_spec(s).transform(images).collect():
            assert rows[r.image_id][f"s{k}"] == r.features
    assert [len(p) for p in plan.places] == [compile_spec(s).feature_dim for s in specs]
    apart = SharedPlan([[OperatorSpec("topology")], [OperatorSpec("topology", {"threshold": 0.5})], [OperatorSpec("topology", {"threshold": 0.3})]])
    assert apart.places[0] == apart.places[1] == (0, 1, 2, 3) and apart.places[2] == (4, 5, 6, 7)
    with pytest.raises(CompilationError):
        SharedPlan([[OperatorSpec("spatial")], [OperatorSpec("hog")]])


def test_evaluations_together_are_those_apart(spark):
    images = glyphs.images(spark, SMALL).filter("image_id < 160")
    evaluator = evaluation.Evaluator(images, validation=40, sizes=(30, 60))
    lists = [[OperatorSpec("spatial"), OperatorSpec("symmetry")], [OperatorSpec("symmetry")]]
    columns = ["representation", "train_size", "feature_dim", "accuracy", "confusion_matrix"]
    together = evaluator.evaluate_many(lists).select(columns).collect()
    apart = [r for operators in lists for r in evaluator.evaluate(operators).select(columns).collect()]
    assert together == apart and [(r.train_size, r.feature_dim) for r in together] == [(30, 5), (60, 5), (30, 2), (60, 2)]
    row = evaluator.evaluate(lists[1]).first()
    assert abs(row.runtime_ms - (row.validation_feature_runtime_ms + 3 * row.train_feature_runtime_ms + 2 * (row.training_time_ms + row.inference_time_ms))) < 1e-6 * row.runtime_ms


def test_search_of_joint_evaluations_keeps_feedback(spark, tmp_path):
    images = glyphs.images(spark, SMALL).filter("image_id < 160")
    seeds = [s for s in seed_specs() if s.name == "topology"]
    spec = lambda name, *o: type(seeds[0])(name, "h", tuple(map(OperatorSpec, o)), "p", "f")
    told = []

    def propose(evidence, want):
        told.append(evidence)
        return [spec("a", "spatial"), spec("b", "symmetry"), spec("c", "symmetry", "spatial"), spec("d", "topology", "symmetry")]

    got = {r.name: r for r in Search(spark, f"file://{tmp_path}/a", seeds, evaluated_together(images, 40, (30, 60)), propose, together=True).run(1, 4).collect()}
    assert set(got) == {"topology", "a", "b", "c", "d"} and got["d"].proposal_category == "failure-driven"
    matrix = got["topology"].confusion_matrix
    pairs = sorted(((-n, a, p) for a, row in enumerate(matrix) for p, n in enumerate(row) if a != p and n))[:5]
    assert [(-c["n"], c["actual"], c["predicted"]) for c in told[0]["confusions"]] == pairs and pairs
    assert [(f.actual, f.predicted, f.baseline_count, f.candidate_count) for f in got["d"].failure_feedback] == [(a, p, -n, got["d"].confusion_matrix[a][p]) for n, a, p in pairs]
    assert got["d"].parent_ids == [seeds[0].spec_hash()] and got["a"].failure_feedback is None and told[0]["elites"][0]["hypothesis"] == seeds[0].hypothesis


def test_outputs_are_told_apart_by_place():
    for bad in ("/a/in", "file:///a/in", "/a/x/../in/", "/a/in/part", "/a"):
        with pytest.raises(ValueError, match="replace"):
            runs.check_arguments((5,), (1,), bad, ["file:/a/in"])
    runs.check_arguments((5,), (1,), "/a/in2", ["/a/in"])
