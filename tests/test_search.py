import pytest
from pyspark.sql import functions as F

from featurelab.plans.compiler import CompilationError, OperatorSpec, RepresentationSpec, compile_spec, seed_specs
from featurelab.plans.search import Search


def spec(name, *operators):
    return RepresentationSpec(name, "h", tuple(map(OperatorSpec, operators)), "p", "f")


def test_search(spark, tmp_path):
    worth = {"raw_pixels": 0.5, "topology": 0.2, "spatial": 0.1, "symmetry": 0.05, "stroke_direction": 0.15, "curvature": -0.1}
    evaluated, seen = [], []

    def evaluate(s):
        evaluated.append(s.spec_hash())
        total = round(sum(worth[o.name] for o in s.operators), 6)
        return {"accuracy_500": total, "accuracy_5000": total, "feature_dim": compile_spec(s).feature_dim, "runtime_ms": 1.0}

    def propose(evidence, want):
        seen.append(evidence)
        return [spec("again", "spatial", "topology"), spec("new", "raw_pixels", "topology"), spec("same", "topology", "raw_pixels")][: want + 2]

    path = f"file://{tmp_path}/a"
    got = Search(spark, path, seed_specs()[:3], evaluate, propose).run(1, 2).persist()
    candidates = {r.candidate_id: r for r in got.filter("record_type = 'candidate'").collect()}
    new = spec("new", "raw_pixels", "topology").spec_hash()
    assert set(candidates) == {s.spec_hash() for s in seed_specs()[:3]} | {new}
    assert candidates[new].generation == 1 and candidates[new].proposal_category == "exploitation"  # its slot, though the first one is known
    layout = seed_specs()[2].spec_hash()
    assert got.filter(F.col("base_candidate_id") == layout).count() == 2
    assert len(seen) == 2 and any(a["base_candidate_id"] == layout and a["delta"] == 0.2 for a in seen[0]["ablations"])
    assert len(evaluated) == len(set(evaluated)) == got.count()
    with pytest.raises(ValueError):
        Search(spark, path, [], evaluate, propose)
    with pytest.raises(ValueError):
        Search(spark, path, seed_specs(), evaluate, propose).run(1, True)
    with pytest.raises(CompilationError):
        Search(spark, path, [spec("bad", "hog")], evaluate, propose).run(0, 1)


def test_specifications_cannot_be_changed():
    given = {"threshold": 0.25, "more": [1, {"x": [2]}]}
    operator = OperatorSpec("topology", given)
    text = operator.to_json()
    given["threshold"] = 0.5
    given["more"][1]["x"].append(3)
    operator.as_dict()["params"]["more"][1]["x"].append(4)
    assert operator.to_json() == text == '{"name":"topology","params":{"more":[1,{"x":[2]}],"threshold":0.25}}'
    for change in (lambda: operator.params.update(threshold=1), lambda: operator.params.__setitem__("x", 1), lambda: operator.params["more"].append(1), lambda: operator.params["more"][1].clear()):
        with pytest.raises((TypeError, AttributeError)):
            change()
    again = RepresentationSpec("n", "h", (operator,), "p", "f")
    assert RepresentationSpec.from_json(again.to_json()) == again and OperatorSpec("topology", {"threshold": 0.25}) != operator
