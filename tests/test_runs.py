"""Loaders by row number, answers, runs and their gates."""

import pytest
from pyspark.sql import functions as F

from featurelab.operators import reports, responses
from featurelab.plans import runs
from featurelab.plans.compiler import OperatorSpec, seed_specs
from featurelab.sources import archive_files, glyphs, loaders

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bad", [{"seed": -1}, {"seed": 1 << 32}, {"seed": 1.0}, {"seed": True}, {"validation": 0}, {"validation": 60_000}, {"train_rows": 0}, {"test_rows": 0}])
def test_data_config(bad):
    with pytest.raises(ValueError):
        loaders.DataConfig(**bad)
    assert loaders.DataConfig(seed=(1 << 32) - 1).validation == 2000


def raw(spark, n=12, pixel=128.0, **changes):
    rows = [(i, i % 3, [changes.get("value", pixel) if (i, k) == (5, 7) else pixel for k in range(784)]) for i in range(n)]
    return spark.createDataFrame(rows, "image_id bigint, label int, pixels array<double>")


def test_scan_and_partitions(spark):
    config = loaders.DataConfig(validation=3, train_rows=9, test_rows=3)
    images = loaders.scan(raw(spark), config)
    assert images.filter(F.get("pixels", F.lit(0)) == 128 / 255).count() == 12
    for wrong in (raw(spark, 11), raw(spark).withColumn("image_id", F.col("image_id") + 1), raw(spark).withColumn("image_id", F.lit(0).cast("bigint"))):
        with pytest.raises(ValueError, match="12 rows"):
            loaders.scan(wrong, config)
    for value in (-1.0, 256.0, float("nan"), None):
        with pytest.raises(Exception, match="784 values"):
            loaders.scan(raw(spark, value=value), config).collect()
    seen = loaders.search_rows(images, config)
    assert {r.image_id for r in seen.collect()} == set(range(9)) and seen.filter("split = 'validation'").count() == 3
    assert {r.image_id for r in loaders.final_rows(images, config).filter("split = 'test'").collect()} == {9, 10, 11}


def test_answers(spark):
    texts = ['{"proposals":[{"a":1}]}', '{"proposals":[]}', '{"proposals":{}}', '{"proposals":[1],"x":1}', "[]", "", None, "no", '```json\n{"proposals":[1]}\n```']
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(responses.accepted(F.col("t"))).collect()]
    assert got == [True] + [False] * 8
    (row,) = responses.usage(spark.createDataFrame([("b", True, 5, 7), ("a", False, None, 9), ("b", True, 1, None)], "model string, accepted boolean, prompt_tokens bigint, response_tokens bigint")).collect()
    assert tuple(row) == (5, 7, False, 3, 2, "a,b")
    (none,) = responses.usage(spark.createDataFrame([], "model string, accepted boolean, prompt_tokens bigint, response_tokens bigint")).collect()
    assert tuple(none) == (0, 0, True, 0, 0, "")


@pytest.mark.parametrize(("sizes", "seeds"), [((), (1,)), ((5,), ()), ((5, 5), (1,)), ((5,), (1, 1)), ((0,), (1,)), ((5.0,), (1,)), ((True,), (1,)), ((5,), (-1,))])
def test_arguments(sizes, seeds):
    with pytest.raises(ValueError):
        runs.check_arguments(sizes, seeds)


def test_output_is_no_input():
    runs.check_arguments((5,), (1,), "/a/out", ["/a/in"])
    with pytest.raises(ValueError, match="replace"):
        runs.check_arguments((5,), (1,), "/a/in/", ["/a/in"])


def frozen(spark, place):
    specs = seed_specs()[1:3]
    rows = [(k, s.spec_hash(), 0, "candidate", None, None, None, 0.5 + k / 10, 0.6, 4, 1.0 + k, 0.5 + k / 10, [o.name for o in s.operators]) for k, s in enumerate(specs)]
    archive_files.append_records(spark.createDataFrame(rows, archive_files.RECORDS), f"{place}/archive")
    archive_files.freeze_finalists(spark, f"{place}/archive", f"{place}/finalists", specs[0].spec_hash())
    return specs, f"{place}/archive", f"{place}/finalists"


def test_final_evaluation_and_provenance(spark, tmp_path):
    specs, archive, finalists = frozen(spark, tmp_path)
    images = glyphs.images(spark, SMALL)
    train, test = images.filter("image_id < 100"), images.filter("image_id between 100 and 139")
    for bad, what in ((specs[:1], "identity"), ((), "identity")):
        with pytest.raises(ValueError, match=what):
            runs.final_evaluation(train, None, finalists, bad, (20,), (1,))  # fails before the test rows are touched
    (tmp_path / "there").mkdir()
    for sizes, output, what in (((20, 101), None, "training rows"), ((20,), archive, "replace"), ((20,), f"file://{archive}/x", "replace"), ((20,), finalists, "replace"), ((20,), f"{tmp_path}/there", "already")):
        with pytest.raises(ValueError, match=what):
            runs.final_evaluation(train, None, finalists, specs, sizes, (1,), output)
    out = runs.final_evaluation(train, test, finalists, specs, (20,), (1,), f"{tmp_path}/runs")
    rows = {r.representation: r for r in out.collect()}
    assert set(rows) == {s.name for s in specs} | {name for name, _, _ in reports.CONTROLS} and spark.read.json(f"{tmp_path}/runs").count() == 4
    assert {n: rows[n].feature_dim for n, _, _ in reports.CONTROLS} == {n: d for n, _, d in reports.CONTROLS}
    for r in rows.values():
        assert sum(map(sum, r.confusion_matrix)) == 40 and abs(sum(r.confusion_matrix[k][k] for k in range(10)) / 40 - r.accuracy) < 1e-9
        assert min(r.training_ms, r.inference_ms, r.feature_ms) > 0
    assert runs.combined_matrix(out.unionByName(out)).agg(F.sum("n")).first()[0] == 2 * 4 * 40
    checksum = archive_files.checksum(spark, archive)
    runs.check_provenance(spark, finalists, True, checksum)
    for accessed, digest in ((False, checksum), (True, "0" * 64)):
        with pytest.raises(ValueError):
            runs.check_provenance(spark, finalists, accessed, digest)
    archive_files.append_records(spark.createDataFrame([(9, "f" * 64, 1, "candidate", None, None, None, 0.1, 0.1, 4, 1.0, 0.1, ["spatial"])], archive_files.RECORDS), archive)
    with pytest.raises(ValueError, match="changed"):
        runs.final_evaluation(train, test, finalists, specs, (20,), (1,))


def test_runs_grid_is_repeatable(spark):
    images = glyphs.images(spark, SMALL)
    train, test = images.filter("image_id < 100"), images.filter("image_id between 100 and 139")
    grid = [("layout", "finalist", [OperatorSpec("spatial"), OperatorSpec("symmetry")])]
    one, two = (runs.runs_grid(train, test, grid, (20, 40), (1, 2)).select("representation", "size", "seed", "accuracy", "confusion_matrix").collect() for _ in range(2))
    assert one == two and [(r["size"], r.seed) for r in one] == [(20, 1), (20, 2), (40, 1), (40, 2)]


def test_lookup(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "candidate_id string, seq int")
    ids = spark.createDataFrame([("a",), ("x",), ("a",)], "candidate_id string")
    assert sorted(tuple(r) for r in reports.lookup(records, ids).collect()) == [("a", 1, True), ("x", None, False)]


def test_proposals_are_decoded_and_judged(spark):
    import json

    good = {"name": "n", "hypothesis": "h", "prediction": "p", "falsification": "f", "operators": [{"name": "topology", "params": {"threshold": 0.25}}, {"name": "spatial", "params": {}}]}
    sound = [good, good | {"operators": [{"name": "topology", "params": {}}]}]
    faults = [
        ({k: v for k, v in good.items() if k != "name"}, "a proposal has"), (good | {"more": 1}, "a proposal has"), ([good], "a proposal has"), (None, "a proposal has"),
        (good | {"name": " "}, "blank"), (good | {"name": 5}, "blank"), (good | {"prediction": None}, "blank"), (good | {"operators": []}, "list"), (good | {"operators": {}}, "list"), (good | {"operators": "x"}, "list"),
        *[(good | {"operators": [good["operators"][0], o]}, what) for o, what in (
            ({"name": "hog", "params": {}}, "unknown"), ({"name": 3, "params": {}}, "unknown"), ({"name": "topology"}, "name and params"), ({"name": "topology", "params": {}, "x": 1}, "name and params"), ("topology", "name and params"),
            ({"name": "spatial", "params": {"threshold": 0.5}}, "doesn't take"), ({"name": "topology", "params": {"x": 0.5}}, "doesn't take"), ({"name": "topology", "params": [1]}, "map"), ({"name": "topology", "params": None}, "map"),
            *(({"name": "topology", "params": {"threshold": t}}, "threshold") for t in (0, 1, -0.5, 1.5, "0.5", True, None, [0.5])),
        )],
    ]
    texts = [json.dumps({"proposals": sound + [f for f, _ in faults]}), json.dumps({"proposals": sound}), json.dumps({"proposals": sound, "x": 1}), json.dumps({"proposals": []}), json.dumps({"proposals": good}), "no", "", None]
    answers = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    allowed = ("topology", "spatial")
    rows = responses.proposals(answers.filter("k = 0"), allowed).orderBy("pos").collect()
    assert len(rows) == 2 + len(faults) and rows[0].fault is None and rows[1].fault is None
    for r, (f, what) in zip(rows[2:], faults):
        assert r.fault and what in r.fault, (f, r.fault)
    assert rows[0].proposal.name == "n" and json.loads(rows[0].proposal.operators[0]) == good["operators"][0]
    got = {r.k: (r.proposals, r.sound, r.accepted) for r in responses.verdicts(answers, allowed, "k").collect()}
    assert got == {0: (2 + len(faults), 2, False), 1: (2, 2, True)} | {k: (0, 0, False) for k in range(2, 8)}
