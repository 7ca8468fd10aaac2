"""Search records and runs derived from the star-schema tables, for queries over an archive of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The allowed operators in registry order and the proposal categories in slot order.
OPERATORS = ("raw_pixels", "topology", "spatial", "symmetry", "stroke_direction", "direction_transition", "curvature")
CATEGORIES = ("exploration", "exploitation", "simplification", "failure-driven")


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _id(k: Column) -> Column:
    return F.sha2(k.cast("string"), 256)


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per part: candidates, and ablations of the record before."""
    k = F.col("p_partkey")
    ablation = k % 4 == 0
    runtime = F.col("p_retailprice") + (k % 97) + (k % 13)
    a500, a5000 = ((7919 * k) % 1000).cast("double") / F.lit(1000.0), ((104729 * k) % 1000).cast("double") / F.lit(1000.0)
    score = 0.6 * a500 + 0.4 * a5000 - 0.001 * F.log1p(F.col("p_size").cast("double")) - 0.0001 * F.log1p(runtime)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("seq"),
        _id(k).alias("candidate_id"),
        (k % 11).alias("generation"),
        F.when(ablation, "ablation").otherwise("candidate").alias("record_type"),
        F.when(ablation, _id(k - 1)).alias("base_candidate_id"),
        F.when(ablation, _pick(OPERATORS, k % 7)).alias("removed_operator"),
        F.when(~ablation, _pick(CATEGORIES, k % 4)).alias("proposal_category"),
        a500.alias("accuracy_500"),
        a5000.alias("accuracy_5000"),
        F.col("p_size").cast("int").alias("feature_dim"),
        runtime.alias("runtime_ms"),
        score.alias("ranking_score"),
        F.array(_pick(OPERATORS, k % 7), _pick(OPERATORS, F.floor(k / 7) % 7)).alias("operators"),
    )


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RECORDS_SQL = f"""k AS (SELECT p_partkey AS k, p_size, p_retailprice + p_partkey % 97 + p_partkey % 13 AS runtime_ms FROM part),
records AS (SELECT k AS seq, sha256(CAST(k AS VARCHAR)) AS candidate_id, k % 11 AS generation,
  CASE WHEN k % 4 = 0 THEN 'ablation' ELSE 'candidate' END AS record_type,
  CASE WHEN k % 4 = 0 THEN sha256(CAST(k - 1 AS VARCHAR)) END AS base_candidate_id,
  CASE WHEN k % 4 = 0 THEN {_sql_list(OPERATORS)}[k % 7 + 1] END AS removed_operator,
  CASE WHEN k % 4 <> 0 THEN {_sql_list(CATEGORIES)}[k % 4 + 1] END AS proposal_category,
  CAST((7919 * k) % 1000 AS DOUBLE) / 1000 AS accuracy_500, CAST((104729 * k) % 1000 AS DOUBLE) / 1000 AS accuracy_5000,
  CAST(p_size AS INTEGER) AS feature_dim, runtime_ms,
  0.6::DOUBLE * ((7919 * k) % 1000)::DOUBLE / 1000 + 0.4::DOUBLE * ((104729 * k) % 1000)::DOUBLE / 1000 - 0.001::DOUBLE * ln(1 + p_size::DOUBLE) - 0.0001::DOUBLE * ln(1 + runtime_ms) AS ranking_score,
  [{_sql_list(OPERATORS)}[k % 7 + 1], {_sql_list(OPERATORS)}[(k // 7) % 7 + 1]] AS operators
  FROM k),
rankable AS (SELECT r.* FROM records r LEFT JOIN records b ON r.base_candidate_id = b.candidate_id WHERE r.record_type = 'candidate' OR r.accuracy_500 > b.accuracy_500)"""


def seed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(representation, size, seed, accuracy): nine runs per nation, three for every fifth."""
    n = F.col("n_nationkey")
    runs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("representation"), F.explode(F.array(F.lit(250), F.lit(500), F.lit(1000))).alias("size"))
    runs = runs.withColumn("seed", F.explode(F.array(F.lit(11), F.lit(23), F.lit(47)))).filter("representation % 5 <> 0 or seed = 11")
    return runs.withColumn("accuracy", ((37 * F.col("representation") + 7 * F.col("size") + 11 * F.col("seed")) % 1000).cast("double") / F.lit(1000.0))


RUNS_SQL = """runs AS (SELECT n_nationkey AS representation, size, seed, CAST((37 * n_nationkey + 7 * size + 11 * seed) % 1000 AS DOUBLE) / 1000 AS accuracy
  FROM nation, (SELECT unnest([250, 500, 1000]) AS size), (SELECT unnest([11, 23, 47]) AS seed) WHERE n_nationkey % 5 <> 0 OR seed = 11)"""


def predictions(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    """(image_id, label, predicted): the place of the largest of ten coordinates from ``first``."""
    e = F.slice("embedding", first, 10)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label", (F.array_position(e, F.array_max(e)) - 1).cast("int").alias("predicted"))


def predictions_sql(name: str, first: int) -> str:
    e = f"embedding[{first}:{first + 9}]"
    return f"{name} AS (SELECT vec_id AS image_id, label, CAST(list_position({e}, list_max({e})) - 1 AS INTEGER) AS predicted FROM embeddings)"


def report_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, key, name, kind, feature_dim, feature_ms): a result per nation, some with the same operators (``key``)."""
    n = F.col("n_nationkey")
    kind = F.when(n >= 23, "baseline").otherwise("finalist")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n.alias("ord"), F.concat(F.lit("k"), (n % 20).cast("string")).alias("key"), F.col("n_name").alias("name"), kind.alias("kind"), (13 * n + 1).alias("feature_dim"), (7 * n % 11).cast("double").alias("feature_ms")
    )


def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed runs with their times."""
    runs = seed_runs(spark, sf_dir).withColumnRenamed("representation", "ord")
    return runs.withColumns({"training_ms": ((F.col("ord") * F.col("size") + F.col("seed")) % 97).cast("double"), "inference_ms": ((F.col("ord") + F.col("seed")) % 13).cast("double")})


REPORT_SQL = (
    RUNS_SQL
    + """, results AS (SELECT n_nationkey AS ord, 'k' || n_nationkey % 20 AS key, n_name AS name, CASE WHEN n_nationkey >= 23 THEN 'baseline' ELSE 'finalist' END AS kind,
  13 * n_nationkey + 1 AS feature_dim, CAST(7 * n_nationkey % 11 AS DOUBLE) AS feature_ms FROM nation),
u AS (SELECT key, min(ord) AS ord, CASE WHEN count(*) > 1 THEN 'raw pixels (candidate and baseline)' ELSE arg_min(name, ord) END AS name, arg_min(kind, ord) AS kind,
  CAST(arg_min(feature_dim, ord) AS INTEGER) AS feature_dim, max(feature_ms) AS feature_ms FROM results GROUP BY key),
z AS (SELECT representation AS ord, CAST(size AS INTEGER) AS size, round(avg(accuracy), 6) AS accuracy_mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS accuracy_std,
  avg(CAST((representation * size + seed) % 97 AS DOUBLE)) AS training_ms, avg(CAST((representation + seed) % 13 AS DOUBLE)) AS inference_ms FROM runs GROUP BY 1, 2)"""
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, model, accepted, prompt_tokens, response_tokens, text): an answer per event, some counts unknown."""
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.concat(F.lit('{"proposals":[{"name":"n'), i.cast("string"), F.lit('"}]}'))
    text = F.when(i % 5 == 0, name).when(i % 5 == 1, '{"proposals":[]}').when(i % 5 == 2, '{"proposals":[{"name":"n"}],"more":1}').when(i % 5 == 3, "no JSON at all").otherwise(F.concat(F.lit("```json\n"), name, F.lit("\n```")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("model"), (i % 5 == 0).alias("accepted"), F.when(i % 7 != 0, k - 3).alias("prompt_tokens"), F.when(i % 11 != 0, i % 100).alias("response_tokens"), text.alias("text"))


ANSWERS_SQL = """answers AS (SELECT event_id, event_type AS model, event_id % 5 = 0 AS accepted, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) - 3 END AS prompt_tokens,
  CASE WHEN event_id % 11 <> 0 THEN event_id % 100 END AS response_tokens,
  CASE event_id % 5 WHEN 0 THEN '{"proposals":[{"name":"n' || event_id || '"}]}' WHEN 1 THEN '{"proposals":[]}' WHEN 2 THEN '{"proposals":[{"name":"n"}],"more":1}' WHEN 3 THEN 'no JSON at all'
    ELSE '```json' || chr(10) || '{"proposals":[{"name":"n' || event_id || '"}]}' || chr(10) || '```' END AS text FROM events)"""


#: Operators of proposed specifications, as JSON: sound ones, and ones with a fault each.
PROPOSED = (
    '{"name":"topology","params":{}}', '{"name":"topology","params":{"threshold":0.25}}', '{"params":{},"name":"raw_pixels"}', '{"name":"spatial","params":{}}', '{"name":"hog","params":{}}', '{"name":"spatial","params":{"threshold":0.5}}',
    '{"name":"topology","params":{"threshold":1}}', '{"name":"topology","params":{"threshold":"0.5"}}', '{"name":"topology","params":{"threshold":true}}', '{"name":"topology"}', '{"name":"topology","params":{},"more":1}', '{"name":"topology","params":[]}', '{"name":7,"params":{}}',
)


def proposing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text): an answer of two proposals per event, with operators of PROPOSED; some lack or have more."""
    i = F.col("event_id")
    one = lambda k, name: F.concat(F.lit('{"name":'), name, F.lit(',"hypothesis":"h","prediction":"p","falsification":'), F.when(i % 23 == 0, '" "').otherwise('"f"'), F.when(i % 29 == 0, ',"more":1').otherwise(""), F.lit(',"operators":['), F.when(i % 31 == 0, "").otherwise(_pick(PROPOSED, k % len(PROPOSED))), F.lit("]}"))
    named = F.concat(F.lit('"n'), i.cast("string"), F.lit('"'))
    both = F.concat(F.lit('{"proposals":['), one(i, named), F.lit(","), one(F.floor(i / 13), F.when(i % 37 == 0, "5").otherwise(named)), F.lit("]"), F.when(i % 41 == 0, ',"x":1').otherwise(""), F.lit("}"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(i % 43 == 0, F.substring(both, 3, 40)).otherwise(both).alias("text"))


def _proposal_sql(k: str, name: str) -> str:
    listed = "[" + ", ".join(f"'{o}'" for o in PROPOSED) + "]"
    return f"""'{{"name":' || {name} || ',"hypothesis":"h","prediction":"p","falsification":' || CASE WHEN event_id % 23 = 0 THEN '" "' ELSE '"f"' END || CASE WHEN event_id % 29 = 0 THEN ',"more":1' ELSE '' END || ',"operators":[' || CASE WHEN event_id % 31 = 0 THEN '' ELSE {listed}[{k} % {len(PROPOSED)} + 1] END || ']}}'"""


_NAMED = """'"n' || event_id || '"'"""
PROPOSING_SQL = f"""texts AS (SELECT event_id, '{{"proposals":[' || {_proposal_sql('event_id', _NAMED)} || ',' || {_proposal_sql('(event_id // 13)', f"CASE WHEN event_id % 37 = 0 THEN '5' ELSE {_NAMED} END")} || ']' || CASE WHEN event_id % 41 = 0 THEN ',"x":1' ELSE '' END || '}}' AS text FROM events),
answers AS (SELECT event_id, CASE WHEN event_id % 43 = 0 THEN substr(text, 3, 40) ELSE text END AS text FROM texts),
valid AS (SELECT event_id, CAST(text AS JSON) AS j FROM answers WHERE json_valid(text)),
listed AS (SELECT event_id, unnest(from_json(j -> 'proposals', '["JSON"]')) AS p FROM valid WHERE json_keys(j) = ['proposals'] AND json_type(j, '$.proposals') = 'ARRAY'),
told AS (SELECT event_id, p, row_number() OVER () AS k, list_sort(json_keys(p)) = ['falsification', 'hypothesis', 'name', 'operators', 'prediction']
  AND json_type(p, '$.name') = 'VARCHAR' AND json_type(p, '$.hypothesis') = 'VARCHAR' AND json_type(p, '$.prediction') = 'VARCHAR' AND json_type(p, '$.falsification') = 'VARCHAR'
  AND trim(p ->> 'name') <> '' AND trim(p ->> 'hypothesis') <> '' AND trim(p ->> 'prediction') <> '' AND trim(p ->> 'falsification') <> '' AND json_array_length(p, '$.operators') > 0 AS sound FROM listed),
operators AS (SELECT k, unnest(from_json(p -> 'operators', '["JSON"]')) AS o FROM told WHERE sound),
faulty AS (SELECT k, count(*) AS n FROM operators WHERE NOT coalesce(list_sort(json_keys(o)) = ['name', 'params'] AND json_type(o, '$.name') = 'VARCHAR' AND (o ->> 'name') IN ({', '.join(f"'{x}'" for x in OPERATORS)}) AND json_type(o, '$.params') = 'OBJECT'
  AND (json_keys(o, '$.params') = [] OR (json_keys(o, '$.params') = ['threshold'] AND (o ->> 'name') = 'topology' AND json_type(o, '$.params.threshold') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND TRY_CAST(o ->> '$.params.threshold' AS DOUBLE) > 0 AND TRY_CAST(o ->> '$.params.threshold' AS DOUBLE) < 1)), false) GROUP BY k),
verdicts AS (SELECT event_id, count(*) AS proposals, count(*) FILTER (sound AND n IS NULL) AS sound FROM told LEFT JOIN faulty USING (k) GROUP BY event_id)"""
