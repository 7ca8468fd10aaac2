import hashlib

import pytest
from pyspark.sql import functions as F

from featurelab.plans.compiler import CompilationError, OperatorSpec
from featurelab.sources import archive_files as files
from featurelab.streaming import archive_stream

KEY = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(9)]


def rows(spark, *some):
    base = dict(generation=0, record_type="candidate", base_candidate_id=None, removed_operator=None, proposal_category=None, accuracy_500=0.5, accuracy_5000=0.6, feature_dim=4, runtime_ms=1.0, ranking_score=0.5, operators=["topology"])
    names = [c.split()[0] for c in files.RECORDS.split(", ")]
    return spark.createDataFrame([tuple((base | {"seq": k} | r)[n] for n in names) for k, r in enumerate(some)], files.RECORDS)


def test_archive_is_idempotent_and_strict(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    first = rows(spark, {"candidate_id": KEY[0]}, {"candidate_id": KEY[1], "accuracy_500": 0.7}, {"candidate_id": KEY[0]})
    files.append_records(first, path)
    files.append_records(first, path)
    files.append_records(rows(spark, {"candidate_id": KEY[2], "seq": 5}, {"candidate_id": KEY[1], "accuracy_500": 0.7}), path)
    assert sorted((r.seq, r.candidate_id) for r in files.read_records(spark, path).collect()) == [(0, KEY[0]), (1, KEY[1]), (5, KEY[2])]
    assert [r.candidate_id for r in files.appended_since(spark, path, 1).collect()] == [KEY[2]]
    for bad in (
        {"candidate_id": KEY[1]}, {"candidate_id": "x"}, {"candidate_id": KEY[3], "accuracy_500": float("nan")}, {"candidate_id": KEY[3], "generation": None},
        {"candidate_id": KEY[3], "record_type": "ablation"}, {"candidate_id": KEY[3], "removed_operator": "topology"}, {"candidate_id": KEY[3], "operators": []},
    ):
        with pytest.raises(Exception, match="candidate|record"):
            files.append_records(rows(spark, bad), path)
    assert files.read_records(spark, path).count() == 3
    for k, line in enumerate(('{"seq": 1, "other": 2}', '{"seq": ', "[]")):
        (tmp_path / f"b{k}").write_text(f"\n  \n{line}\n")
        with pytest.raises(Exception):
            files.read_records(spark, f"file://{tmp_path}/b{k}").collect()


def test_finalists_freeze_once(spark, tmp_path):
    path, out = f"file://{tmp_path}/a", f"file://{tmp_path}/f"
    some = [{"candidate_id": KEY[k], "accuracy_500": 0.1 * k, "feature_dim": 10 - k, "runtime_ms": 5.0 + k} for k in range(8)]
    files.append_records(rows(spark, *some), path)
    with pytest.raises(ValueError):
        files.freeze_finalists(spark, path, out, KEY[8])
    got = {r.candidate_id: r.selection_roles for r in files.freeze_finalists(spark, path, out, KEY[1]).collect()}
    best = {KEY[7 - k]: [f"top_5_low_data_accuracy_rank_{k + 1}"] for k in range(5)}
    best[KEY[7]] = ["smallest_representation", *best[KEY[7]]]
    assert got == best | {KEY[0]: ["fastest_representation"], KEY[1]: ["original_stroke_flow_hypothesis"]}
    with pytest.raises(ValueError):
        files.freeze_finalists(spark, path, out, KEY[1])
    files.append_records(rows(spark, {"candidate_id": KEY[8], "seq": 9}), path)
    with pytest.raises(ValueError):
        files.frozen_finalists(spark, out)


def test_feature_cache(spark, tmp_path):
    images = spark.range(6).select(F.col("id").alias("image_id"), F.col("id").cast("int").alias("label"), F.array_repeat(F.col("id") / 10, 784).alias("pixels"))
    cache, spec = files.FeatureCache(f"file://{tmp_path}/c"), [OperatorSpec("spatial"), OperatorSpec("symmetry")]
    first = sorted(cache.features(images, spec, "k").collect())
    assert len(first) == 6 and all(len(r.features) == 5 for r in first)
    assert sorted(cache.features(images.limit(0), spec, "k").collect()) == first  # from the cache
    assert cache.features(images.limit(2), spec, "other").count() == 2
    assert cache.path(spec, "k") != cache.path(spec[::-1], "k")
    with pytest.raises(CompilationError):
        cache.features(images, [OperatorSpec("hog")], "k")
    with pytest.raises(ValueError):
        cache.path(spec, " ")


def test_responses_and_stream(spark, tmp_path):
    log, path = f"file://{tmp_path}/r", f"file://{tmp_path}/a"
    said = spark.createDataFrame([("p", "{}", "m", 1, False, "bad", 3, None, None)], files.RESPONSES)
    files.append_responses(said, log)
    files.append_responses(said, log)
    assert files.read_lines(spark, log, files.RESPONSES).count() == 2
    files.append_records(rows(spark, {"candidate_id": KEY[0]}, {"candidate_id": KEY[1], "accuracy_500": 0.7}), path)
    for extra in (None, {"candidate_id": KEY[2], "seq": 4, "generation": 1}):
        if extra:
            files.append_records(rows(spark, extra), path)
        q = archive_stream.best_by_generation(archive_stream.record_stream(spark, path)).writeStream.outputMode("complete").format("memory").queryName("best").option("checkpointLocation", f"file://{tmp_path}/s").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("best").collect())) == [(0, 0.7, 2), (1, 0.5, 1)]
