"""Answers of a language model as columns: which are accepted, token counts, errors, usage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted(text: Column) -> Column:
    """Whether an answer is a JSON object of the key ``proposals`` alone, a list that isn't empty."""
    n = F.json_array_length(F.get_json_object(text, "$.proposals"))
    return F.coalesce((F.json_object_keys(text) == F.array(F.lit("proposals"))) & (n > 0), F.lit(False))


def token_count(value: Column) -> Column:
    """A count that isn't negative, or null."""
    return F.when(value >= 0, value)


def error_text(message: Column, most: int = 500) -> Column:
    """A message of ``most`` characters at most."""
    return F.substring(message, 1, most)


def usage(answers: DataFrame) -> DataFrame:
    """One row over ``answers`` (model, accepted, prompt_tokens, response_tokens): sums where both counts are known,
    whether all are, answers, accepted ones and the models in order."""
    known = F.col("prompt_tokens").isNotNull() & F.col("response_tokens").isNotNull()
    sums = [F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(c) for c in ("prompt_tokens", "response_tokens")]
    models = F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models")
    return answers.agg(*sums, F.coalesce(F.bool_and(known), F.lit(True)).alias("complete"), F.count("*").alias("answers"), F.count_if("accepted").alias("accepted"), models)


#: The keys of a proposal.
PROPOSAL = ("falsification", "hypothesis", "name", "operators", "prediction")


def _kind(value: Column) -> Column:
    """What a JSON value is: STRING, BIGINT, ARRAY<...>, ..."""
    return F.schema_of_variant(value)


def _keys(value: Column) -> Column:
    return F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _operator_fault(o: Column, allowed: Sequence[str]) -> Column:
    name, params = F.try_variant_get(o, "$.name", "string"), _field(o, "params")
    threshold = F.try_variant_get(o, "$.params.threshold", "double")
    number = _kind(_field(params, "threshold")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    keys = _keys(params)
    return (
        F.when(~F.coalesce(_keys(o) == F.array(F.lit("name"), F.lit("params")), F.lit(False)), "an operator has name and params")
        .when(~F.coalesce((_kind(_field(o, "name")) == "STRING") & name.isin(*allowed), F.lit(False)), "unknown operator")
        .when(~F.coalesce(_kind(params).startswith("OBJECT"), F.lit(False)), "parameters are a map")
        .when(F.size(F.array_except(keys, F.when(name == "topology", F.array(F.lit("threshold"))).otherwise(F.array().cast("array<string>")))) > 0, "a parameter that the operator doesn't take")
        .when((F.size(keys) > 0) & ~F.coalesce(number & (threshold > 0) & (threshold < 1), F.lit(False)), "threshold must be between 0 and 1")
    )


def proposals(answers: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """A row for each proposal in ``text`` of ``answers``: their columns, its place ``pos``, the decoded ``proposal`` and
    ``fault``, the first rule that it breaks (null for a sound one). ``allowed`` are the operators there are. Answers that
    aren't an object of ``proposals`` alone have no rows."""
    value = F.try_parse_json("text")
    listed = F.when(_keys(value) == F.array(F.lit("proposals")), F.try_variant_get(value, "$.proposals", "array<variant>"))
    each = answers.select(*answers.columns, F.posexplode(listed).alias("pos", "_p"))
    p = F.col("_p")
    operators = F.try_variant_get(p, "$.operators", "array<variant>")
    prose = [n for n in PROPOSAL if n != "operators"]
    told = lambda n: F.coalesce((_kind(_field(p, n)) == "STRING") & (F.trim(F.try_variant_get(p, f"$.{n}", "string")) != ""), F.lit(False))
    faults = F.filter(F.transform(operators, lambda o: _operator_fault(o, allowed)), lambda f: f.isNotNull())
    fault = (
        F.when(~F.coalesce(_keys(p) == F.array(*map(F.lit, PROPOSAL)), F.lit(False)), "a proposal has name, hypothesis, operators, prediction and falsification")
        .when(~reduce(lambda a, b: a & b, map(told, prose)), "name, hypothesis, prediction and falsification are texts that aren't blank")
        .when(~F.coalesce(F.size(operators) > 0, F.lit(False)), "operators must be a list that isn't empty")
        .otherwise(F.get(faults, 0))
    )
    decoded = F.struct(*[F.try_variant_get(p, f"$.{n}", "string").alias(n) for n in prose], F.transform(operators, lambda o: F.to_json(o)).alias("operators"))
    return each.select(*answers.columns, "pos", decoded.alias("proposal"), fault.alias("fault"))


def verdicts(answers: DataFrame, allowed: Sequence[str], key: str) -> DataFrame:
    """(``key``, proposals, sound, accepted) of each answer: it is accepted if it has proposals and all of them are sound."""
    n = proposals(answers.select(key, "text"), allowed).groupBy(key).agg(F.count("*").alias("proposals"), F.count_if(F.col("fault").isNull()).alias("sound"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = answers.select(key).join(n, key, "left").select(key, zero("proposals"), zero("sound"))
    return both.select("*", ((F.col("proposals") > 0) & (F.col("proposals") == F.col("sound"))).alias("accepted"))
