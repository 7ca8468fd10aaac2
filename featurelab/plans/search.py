"""Search over representations: evaluate, archive, take operators away, ask for more.

The archive on disk is the only state, so a search that was stopped goes on where it was. Specifications come from
``propose``, any function of the evidence; what it gives is checked, named by slot and freed of what is known."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.operators import archive
from featurelab.plans.compiler import OperatorSpec, RepresentationSpec, compile_spec
from featurelab.plans.evaluation import Evaluator, ranking_score
from featurelab.sources import archive_files
from featurelab.sources.records import CATEGORIES

#: Elites that proposals start from, and calls of ``propose`` a generation at most.
ELITES, ROUNDS = 5, 5


class Search:
    """``evaluate`` gives accuracy_500, accuracy_5000, feature_dim, runtime_ms and, if it has one, confusion_matrix of a
    specification; with ``together`` it is given all that are new at once (see :func:`evaluated_together`). ``propose``
    gives specifications for (evidence, how many)."""

    def __init__(self, spark: SparkSession, path: str, seeds: Sequence[RepresentationSpec], evaluate: Callable, propose: Callable[[dict, int], Sequence[RepresentationSpec]], together: bool = False):
        if not seeds:
            raise ValueError("a search needs a seed")
        self._spark, self._path, self._seeds, self._propose = spark, path, list(seeds), propose
        self._evaluate = evaluate if together else lambda specs: [evaluate(s) for s in specs]

    def records(self) -> DataFrame:
        found = archive_files._found(lambda: archive_files.read_records(self._spark, self._path))
        return self._spark.createDataFrame([], archive_files.RECORDS) if found is None else found

    def run(self, generations: int, per_generation: int) -> DataFrame:
        """The archive's records after ``generations``, each of ``per_generation`` candidates or as many as come."""
        if type(generations) is not int or generations < 0 or type(per_generation) is not int or per_generation < 1:
            raise ValueError("generations must not be negative, candidates of a generation must be positive integers")
        self._add([(s, 0, {}) for s in self._seeds])
        for generation in range(1, generations + 1):
            for _ in range(ROUNDS):
                mine = self.records().filter((F.col("generation") == generation) & (F.col("record_type") == "candidate")).count()
                if mine >= per_generation or not self._round(generation, per_generation - mine):
                    break
        return self.records()

    def _add(self, specs: list[tuple[RepresentationSpec, int, dict]], targets: Sequence[dict] = ()) -> int:
        """Evaluate what isn't archived, all of it together, and archive it; how many. Failure-driven candidates get
        their counts of the ``targets``."""
        fresh = {s.spec_hash(): (s, g, more) for s, g, more in reversed(specs)}
        wanted = [k for k in dict.fromkeys(s.spec_hash() for s, _, _ in specs)]
        known = {r[0] for r in self.records().select("candidate_id").filter(F.col("candidate_id").isin(wanted)).collect()}  # at most a round's
        new = [k for k in wanted if k not in known]
        if not new:
            return 0
        seq, rows = self.records().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0], []
        for k in new:
            compile_spec(fresh[k][0])
        for k, got in zip(new, self._evaluate([fresh[k][0] for k in new])):
            (spec, generation, more), seq = fresh[k], seq + 1
            row = {"seq": seq, "candidate_id": k, "generation": generation, "record_type": "candidate", "operators": [o.to_json() for o in spec.operators]}
            row |= {p: getattr(spec, p) for p in archive_files.PROSE} | got | more
            row["ranking_score"] = ranking_score(row["accuracy_500"], row["accuracy_5000"], row["feature_dim"], row["runtime_ms"])
            if targets and more.get("proposal_category") == "failure-driven" and got.get("confusion_matrix"):
                row["failure_feedback"] = [{"actual": t["actual"], "predicted": t["predicted"], "baseline_count": t["n"], "candidate_count": got["confusion_matrix"][t["actual"]][t["predicted"]]} for t in targets]
            rows.append(json.dumps(row))
        added = self._spark.createDataFrame([(r,) for r in rows], "value string").select(F.inline(F.array(F.from_json("value", archive_files.WHOLE))))
        archive_files.append_records(added, self._path)
        return len(rows)

    def _round(self, generation: int, want: int) -> int:
        parents = archive.top(self.records(), ELITES).select("candidate_id", "operators").collect()  # five
        if not parents:
            return 0
        self._add([x for p in parents for x in self._without_one(p, generation)])
        history = self.records()
        evidence = self.evidence(history)
        specs = list(self._propose(evidence, want))
        if not specs:
            return 0
        slots = [(k, [o.to_json() for o in s.operators], CATEGORIES[k % len(CATEGORIES)]) for k, s in enumerate(specs)]
        proposed = self._spark.createDataFrame(slots, "ord int, operators array<string>, category string")
        left = archive.dedupe_proposals(proposed, history.select("operators")).orderBy("ord").limit(want).collect()
        elites = [e["candidate_id"] for e in evidence["elites"]]
        return self._add([(specs[r.ord], generation, {"proposal_category": r.category, "parent_ids": [i for i in elites if i != specs[r.ord].spec_hash()]}) for r in left], evidence["confusions"])

    @staticmethod
    def _without_one(parent, generation: int) -> list[tuple[RepresentationSpec, int, dict]]:
        """An elite without each of its distinct operators in turn, if another is left."""
        operators, out = list(parent.operators), []
        for gone in dict.fromkeys(operators):
            at = operators.index(gone)
            rest = [OperatorSpec(**json.loads(o)) for k, o in enumerate(operators) if k != at]
            if rest:
                name = f"{parent.candidate_id[:12]}_without_{json.loads(gone)['name']}_{hashlib.sha256(gone.encode()).hexdigest()[:8]}"
                spec = RepresentationSpec(name, "the operator matters", tuple(rest), "accuracy falls without it", "accuracy doesn't fall")
                out.append((spec, generation, {"record_type": "ablation", "base_candidate_id": parent.candidate_id, "removed_operator": gone, "parent_ids": [parent.candidate_id]}))
        return out

    @staticmethod
    def evidence(records: DataFrame) -> dict:
        """What a proposer sees, of bounded size: elites with their prose, the first one's most frequent confusions, the
        ten ablations of most effect, the last 20 explored."""
        best = archive.top(records, ELITES)
        deltas = archive.ablation_deltas(records).join(best.select(F.col("candidate_id").alias("base_candidate_id")), "base_candidate_id")
        last = records.orderBy(F.desc("seq")).limit(20).groupBy(F.array_sort("operators").alias("operators")).agg(F.min("seq").alias("seq")).orderBy("seq")
        pairs = archive.confusion_pairs(archive.matrix_cells(best.limit(1)))
        return {
            "elites": [r.asDict() for r in best.select("candidate_id", "name", "hypothesis", "operators", "accuracy_500", "accuracy_5000", "feature_dim").collect()],
            "confusions": [r.asDict() for r in pairs.select("actual", "predicted", "n").collect()],
            "ablations": [r.asDict() for r in deltas.orderBy(F.desc(F.abs("delta")), "candidate_id").limit(10).collect()],
            "explored": [r.operators for r in last.collect()],
        }


def evaluated_together(images: DataFrame, validation: int = 2000, sizes: tuple[int, int] = (500, 5000), seed: int = 42) -> Callable[[Sequence[RepresentationSpec]], list[dict]]:
    """An ``evaluate`` for searches with ``together``: one scan extracts the operators of all specifications, and all
    fits go over the rows at once."""
    evaluator = Evaluator(images, validation, sizes, seed)

    def evaluate(specs: Sequence[RepresentationSpec]) -> list[dict]:
        rows = evaluator.rows([s.operators for s in specs])
        pairs = [rows[k : k + len(sizes)] for k in range(0, len(rows), len(sizes))]
        return [{"accuracy_500": own[0][3], "accuracy_5000": own[-1][3], "feature_dim": own[0][2], "runtime_ms": own[0][9], "confusion_matrix": own[-1][4]} for own in pairs]

    return evaluate
