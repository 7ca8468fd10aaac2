"""Joins of records with records: none is sent to the driver to be broadcast, whatever its size is taken for."""

import pytest

from featurelab.operators import archive
from featurelab.plans import registry
from featurelab.sources import archive_files
from featurelab.sources import records as rec
from tests.conftest import SMALL


def broadcasts(df) -> list[str]:
    """What the plan that has run broadcasts."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "BroadcastExchange" in line]


@pytest.mark.parametrize("query", ["finalists_with_roles", "representations_list", "candidate_summary"])
def test_roles_are_broadcast_and_records_are_not(spark, query):
    found = registry.queries()[query](spark, SMALL)
    assert len(broadcasts(found)) == (2 if query == "candidate_summary" else 1)


def test_records_and_their_bases_are_merged(spark):
    r = rec.search_records(spark, SMALL)
    assert not broadcasts(archive.rankable(r)) and not broadcasts(archive.ablation_deltas(r))
    assert not broadcasts(registry.queries()["ablation_contributions"](spark, SMALL))
    told = [("candidate", None, 0.5), ("ablation", "0", 0.6), ("ablation", "0", 0.5), ("candidate", "0", 0.1), (None, "0", 0.7), ("ablation", "9", 0.9), ("ablation", None, 0.9)]
    odd = spark.createDataFrame([(k, f"{k}", 0, kind, base, None, None, a, a, 1, 1.0, 1.0, ["x"]) for k, (kind, base, a) in enumerate(told)], archive_files.RECORDS)
    assert sorted(x.seq for x in archive.rankable(odd).collect()) == [0, 1, 3, 4]
