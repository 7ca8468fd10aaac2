"""Whole records: identities recomputed from their prose, commits by several writers, faults by line."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from featurelab.functions import canonical
from featurelab.plans.compiler import OperatorSpec, RepresentationSpec
from featurelab.sources import archive_files as files
from featurelab.sources import commits

ODD = ["plain", 'quotes " and \\ and /', "line\nend\ttab\r\x08\x0c\x00\x1f\x7f", "é ü 漢字 😀  ", " spaces ", "퟿"]


def specs():
    operators = [OperatorSpec("topology", {"threshold": t}) for t in (0.5, 0.25, 0.1, 0.0001, 2.5e-05, 1e-10, 0.30000000000000004)] + [OperatorSpec("raw_pixels"), OperatorSpec("spatial")]
    return [RepresentationSpec(text, ODD[k - 1], tuple(operators[: 1 + k]), ODD[k - 2], ODD[k - 3]) for k, text in enumerate(ODD)] + [RepresentationSpec("all", "h", tuple(operators), "p", "f")]


def whole(spec, **changes):
    """A record of ``spec`` as a map."""
    body = {"seq": 0, "candidate_id": spec.spec_hash(), "generation": 0, "record_type": "candidate", "accuracy_500": 0.5, "accuracy_5000": 0.6, "feature_dim": 4, "runtime_ms": 1.0, "ranking_score": 0.5, "operators": [o.to_json() for o in spec.operators]}
    return body | {k: getattr(spec, k) for k in files.PROSE} | changes


def frame(spark, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "v string").select(F.inline(F.array(F.from_json("v", files.WHOLE))))


def test_identities_are_those_of_the_specifications(spark):
    rows = spark.createDataFrame([(k, s.name, s.hypothesis, s.prediction, s.falsification, [o.to_json() for o in s.operators]) for k, s in enumerate(specs())], "k int, name string, hypothesis string, prediction string, falsification string, operators array<string>")
    columns = [F.col(c) for c in ("name", "hypothesis", "prediction", "falsification", "operators")]
    got = {r.k: r for r in rows.select("k", canonical.spec_json(*columns).alias("text"), canonical.spec_id(*columns).alias("id")).collect()}
    for k, s in enumerate(specs()):
        assert got[k].text == s.to_json() and got[k].id == s.spec_hash()


@pytest.mark.parametrize("text", ['{"name":"topology","params":{"threshold":0.50}}', '{"name":"topology","params":{"threshold":1}}', '{"name":"topology","params":{"threshold":0.0}}', '{"params":{},"name":"topology"}', '{"name": "topology","params":{}}', '{"name":"Topology","params":{}}', "topology", '{"name":"topology","params":{"threshold":5e-1}}', '{"name":"topology","params":{"threshold":0.00001}}'])
def test_what_is_no_canonical_operator(spark, text):
    assert spark.range(1).select(canonical.is_operator(F.lit(text))).first()[0] is False


def test_whole_records_are_archived_and_verified(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    some = specs()
    pair = {"actual": 3, "predicted": 5, "baseline_count": 9, "candidate_count": 4}
    more = {"parent_ids": [some[1].spec_hash()], "prompt": "p", "model": "m", "proposal_category": "failure-driven", "failure_feedback": [pair], "confusion_matrix": [[1, 2], [3, 4]]}
    files.append_records(frame(spark, whole(some[0], **more), *[whole(s, seq=k) for k, s in enumerate(some[1:], 1)]), path)
    got = {r.candidate_id: r for r in files.read_records(spark, path).collect()}
    assert set(got) == {s.spec_hash() for s in some} and files.check_archive(spark, path) == len(some)
    first = got[some[0].spec_hash()]
    assert first.parent_ids == more["parent_ids"] and first.failure_feedback[0].asDict() == pair and first.confusion_matrix == [[1, 2], [3, 4]]
    one = RepresentationSpec("one", "h", (OperatorSpec("spatial"),), "p", "f")
    other = some[2].spec_hash()
    for change, what in (
        ({"hypothesis": "another"}, "isn't that"), ({"operators": ["spatial"]}, "isn't that"), ({"prediction": None}, "has a name"), ({"parent_ids": [other, other]}, "parents"), ({"parent_ids": [one.spec_hash()]}, "parents"), ({"parent_ids": ["x"]}, "parents"),
        ({"prompt": "p"}, "prompt"), ({"model": "m"}, "prompt"), ({"prompt": " ", "model": "m"}, "prompt"), ({"failure_feedback": [pair]}, "feedback"), ({"confusion_matrix": [[1, 2]]}, "square"), ({"confusion_matrix": [[-1]]}, "square"),
        ({"record_type": "ablation", "base_candidate_id": other, "removed_operator": "x", "parent_ids": []}, "base of an ablation"),
        ({"record_type": "ablation", "base_candidate_id": other, "removed_operator": "x", "parent_ids": [other], "prompt": "p", "model": "m"}, "no prompt"),
    ):
        with pytest.raises(Exception, match=what):
            files.append_records(frame(spark, whole(one, seq=99, **change)), path)
    assert files.check_archive(spark, path) == len(some) and commits.version(spark, path) == 1


def test_two_writers_of_one_id(spark, tmp_path, monkeypatch):
    """The second writer has read the archive before the first one commits, and looks again."""
    path, spec = f"file://{tmp_path}/a", specs()[0]
    real, seen = commits.publish, []

    def late(session, written, target):
        if not seen:
            seen.append(target)
            files.append_records(frame(spark, whole(spec, accuracy_500=0.9)), path)  # meanwhile
        return real(session, written, target)

    monkeypatch.setattr(commits, "publish", late)
    with pytest.raises(Exception, match="other contents"):
        files.append_records(frame(spark, whole(spec)), path)
    monkeypatch.setattr(commits, "publish", real)
    assert [r.accuracy_500 for r in files.read_records(spark, path).collect()] == [0.9] and commits.version(spark, path) == 1


def test_writers_at_the_same_time_all_commit(spark, tmp_path):
    path, some, errors = f"file://{tmp_path}/a", specs(), []

    def write(k):
        try:
            files.append_records(frame(spark, whole(some[k], seq=k), whole(some[-1], seq=99)), path)
        except Exception as e:  # shown by the assertion
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and commits.version(spark, path) == 4
    assert {r.candidate_id for r in files.read_records(spark, path).collect()} == {s.spec_hash() for s in [*some[:4], some[-1]]}


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    path, some = f"file://{tmp_path}/a", specs()
    files.append_records(frame(spark, whole(some[0])), path)

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "publish", dies)
    monkeypatch.setattr(commits, "_dropped", lambda *_: None)  # not even cleaning up
    with pytest.raises(KeyboardInterrupt):
        files.append_records(frame(spark, whole(some[1])), path)
    with pytest.raises(KeyboardInterrupt):
        files.FeatureCache(f"file://{tmp_path}/c").features(spark.range(2).select(F.col("id").alias("image_id"), F.lit(0).alias("label"), F.array_repeat(F.lit(0.5), 784).alias("pixels")), [OperatorSpec("spatial")], "k")
    assert any(p.name.startswith("_staged") for p in (tmp_path / "a").iterdir())
    assert [r.candidate_id for r in files.read_records(spark, path).collect()] == [some[0].spec_hash()] and files.check_archive(spark, path) == 1


def test_faults_are_named_by_file_and_line(spark, tmp_path):
    lines = [json.dumps(whole(s, seq=k)) for k, s in enumerate(specs()[:4])]
    many = [lines[k % 4] for k in range(400)]
    many[17] = ""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(sum(map(len, many)) // 4 + 200))
    try:
        for at, fault, what in ((250, '{"seq": 1, "other": 2}', "known keys"), (251, '{"seq": ', "known keys"), (299, lines[0].replace('"generation": 0', '"generation": -1'), "generation")):
            some = list(many)
            some[at] = fault
            some[at + 60] = "[]"
            (tmp_path / "b.json").write_text("\n".join(some) + "\n")
            assert spark.read.text(f"file://{tmp_path}/b.json").rdd.getNumPartitions() >= 4
            with pytest.raises(ValueError, match=rf"b\.json:{at + 1}: .*{what}"):
                files.check_archive(spark, f"file://{tmp_path}/b.json")
        (tmp_path / "b.json").write_text("\n".join(many))
        assert files.check_archive(spark, f"file://{tmp_path}/b.json") == 399
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_strings_of_long_texts_take_time_by_their_length(spark):
    from time import perf_counter

    texts = ["", 'q"\\b\n\t\r\f\b', "\x00\x1f\x7f~ é", "\U0001f600 x\\u $1", "$0\\1", "\uffff", 'ä"\n\\ ' * 6000, 'a"\n\\ ' * 6000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    began = perf_counter()
    got = {r.k: r.j for r in rows.select("k", canonical.json_string(F.col("t")).alias("j")).collect()}
    assert perf_counter() - began < 15
    assert got == {k: json.dumps(t) for k, t in enumerate(texts)}
