"""Every query with SQL against DuckDB on the smallest tables, and operators' guards."""

import math

import duckdb
import pytest

from featurelab.operators import archive, learning, sampling
from featurelab.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    r = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x[columns.index(c)]) for c in sorted(columns)) for x in r.fetchall()), key=str)
    assert sorted((tuple(plain(x[c]) for c in sorted(columns)) for x in df.collect()), key=str) == want


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.queries()) <= set(e.queries())


def test_samples(spark):
    rows = spark.range(200).selectExpr("id as image_id", "cast(id % 10 as int) as label")
    one = sampling.stratified_sample(rows, 50, 3).filter("chosen")
    assert one.count() == 50 and {r["count"] for r in one.groupBy("label").count().collect()} == {5}
    assert sorted(one.collect()) == sorted(sampling.stratified_sample(rows.repartition(7), 50, 3).filter("chosen").collect())
    assert sampling.stratified_sample(rows, 200, 3).filter("chosen").count() == 200
    for size in (0, 201, 199, 5):
        with pytest.raises(ValueError):
            sampling.stratified_sample(rows, size, 3)


def test_learner(spark):
    rows = spark.range(180).selectExpr("id as image_id", "cast(id % 3 * 2 as int) as label", "array(cast(id % 3 as double), cast(id % 7 as double), 1d) as features")
    learner = learning.Learner()
    with pytest.raises(ValueError):
        learner.predict(rows)
    out = learner.fit(rows).predict(rows)
    assert learning.accuracy(out).first()[0] == 1.0
    cells = learning.confusion(out).collect()
    assert len(cells) == 100 and sum(c.n for c in cells) == 180
    with pytest.raises(ValueError):
        learning.Learner().fit(rows.filter("label = 0"))


def test_archive_rules(spark):
    columns = "seq bigint, candidate_id string, record_type string, base_candidate_id string, accuracy_500 double, accuracy_5000 double, feature_dim int, runtime_ms double, ranking_score double"
    rows = [(0, "a", "candidate", None, 0.8, 0.9, 4, 1.0, 0.8), (1, "b", "ablation", "a", 0.99, 0.9, 4, 1.0, 0.99), (2, "c", "candidate", None, 0.7, 0.9, 4, 1.0, 0.7), (3, "d", "ablation", "c", 0.6, 0.9, 4, 1.0, 0.6), (4, "e", "ablation", "zz", 0.9, 0.9, 4, 1.0, 0.9)]
    df = spark.createDataFrame(rows, columns)
    assert [r.candidate_id for r in archive.top(df, 5).collect()] == ["b", "a", "c"]
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            archive.top(df, bad)


def test_baselines_have_all_measures(spark):
    rows = registry.queries()["baseline_sweep"](spark, SMALL).collect()
    assert [(r.representation, r.train_size, r.feature_dim) for r in rows] == [(k, n, d) for k, d in (("raw_pixels", 784), ("downsampled", 196), ("hog", 1296)) for n in (100, 300)]
    for r in rows:
        cells = r.confusion_matrix
        assert len(cells) == 10 and {len(c) for c in cells} == {10} and sum(map(sum, cells)) == 100
        assert abs(sum(cells[k][k] for k in range(10)) / 100 - r.accuracy) < 1e-12
        assert min(r.train_feature_runtime_ms, r.validation_feature_runtime_ms, r.training_time_ms, r.inference_time_ms) > 0
    for a, b in zip(rows[::2], rows[1::2]):
        runtime = a.validation_feature_runtime_ms + sum(r.train_feature_runtime_ms + r.training_time_ms + r.inference_time_ms for r in (a, b))
        score = 0.6 * a.accuracy + 0.4 * b.accuracy - 0.001 * math.log1p(a.feature_dim) - 0.0001 * math.log1p(runtime)
        assert all(abs(r.runtime_ms - runtime) < 1e-6 and abs(r.ranking_score - score) < 1e-9 for r in (a, b))


def test_learner_goes_on_to_the_optimum(spark):
    # features of quite different scales after standardising: a row in fifty has the value that tells classes apart
    rows = spark.range(400).selectExpr("id as image_id", "cast(id % 4 as int) as label", "transform(sequence(0, 59), k -> cast(pmod(xxhash64(id, k), 1000) as double) / 1000 + if(k = 0, 1, 0) * (id % 4) + if(k > 0 and pmod(xxhash64(id), 50) = k, 40 * (id % 4), 0)) as features")
    model = learning.Learner(c=1e6).fit(rows)._model
    assert 100 < model.summary.totalIterations < 1000
