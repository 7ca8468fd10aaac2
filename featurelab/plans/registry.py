"""Registered queries and their SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions import canonical
from featurelab.operators import archive, learning, many_fits, pixels, reports, responses, sampling, shape
from featurelab.plans import shape_sql
from featurelab.sources import archive_files, glyphs, loaders, records as rec

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PX = "WITH " + glyphs.glyph_sql()
_R = "WITH " + rec.RECORDS_SQL


# ---------------------------------------------------------------- images


@_query(_PX + " SELECT image_id, true AS valid, count(*) AS n FROM px GROUP BY image_id")
def image_guard(spark, sf_dir):
    px = glyphs.images(spark, sf_dir)
    return px.select("image_id", pixels.is_image(F.col("pixels")).alias("valid"), F.size("pixels").cast("bigint").alias("n"))


@_query(_PX + " SELECT image_id, CAST(28 * r + c AS INTEGER) AS pos, round(v, 6) AS v FROM px")
def raw_pixels_long(spark, sf_dir):
    px = glyphs.images(spark, sf_dir).select("image_id", F.posexplode(pixels.raw_pixels(pixels.checked(F.col("pixels")))).alias("pos", "v"))
    return px.select("image_id", "pos", F.round("v", 6).alias("v"))


@_query(_PX + " SELECT image_id, CAST(14 * (r // 2) + c // 2 AS INTEGER) AS pos, round(avg(v), 6) AS v FROM px GROUP BY image_id, r // 2, c // 2")
def downsampled_14x14(spark, sf_dir):
    px = glyphs.images(spark, sf_dir).select("image_id", F.posexplode(pixels.downsampled(F.col("pixels"))).alias("pos", "v"))
    return px.select("image_id", "pos", F.round("v", 6).alias("v"))


_SPATIAL_SQL = _PX + """ SELECT image_id, round(sum(v) FILTER (r < 9) / sum(v), 6) AS top, round(sum(v) FILTER (r BETWEEN 9 AND 18) / sum(v), 6) AS middle,
  round(sum(v) FILTER (r > 18) / sum(v), 6) AS bottom FROM px GROUP BY image_id"""


@_query(_SPATIAL_SQL)
def spatial_bands(spark, sf_dir):
    s = glyphs.images(spark, sf_dir).select("image_id", pixels.spatial(pixels.checked(F.col("pixels"))).alias("s"))
    return s.select("image_id", *[F.round(F.get("s", F.lit(i)), 6).alias(n) for i, n in enumerate(("top", "middle", "bottom"))])


_SYMMETRY_SQL = _PX + """ SELECT a.image_id, round(1 - sum(abs(a.v - l.v)) / (2 * sum(a.v)), 6) AS left_right, round(1 - sum(abs(a.v - t.v)) / (2 * sum(a.v)), 6) AS top_bottom
  FROM px a JOIN px l ON a.image_id = l.image_id AND a.r = l.r AND a.c = 27 - l.c JOIN px t ON a.image_id = t.image_id AND a.c = t.c AND a.r = 27 - t.r GROUP BY a.image_id"""


@_query(_SYMMETRY_SQL)
def symmetry_scores(spark, sf_dir):
    s = glyphs.images(spark, sf_dir).select("image_id", pixels.symmetry(F.col("pixels")).alias("s"))
    return s.select("image_id", *[F.round(F.get("s", F.lit(i)), 6).alias(n) for i, n in enumerate(("left_right", "top_bottom"))])


@_query(f"SELECT s.image_id, s.top, s.middle, s.bottom, y.left_right, y.top_bottom, CAST(5 AS INTEGER) AS feature_dim FROM ({_SPATIAL_SQL}) s JOIN ({_SYMMETRY_SQL}) y USING (image_id)")
def pipeline_concat_spatial_symmetry(spark, sf_dir):
    from featurelab.plans.compiler import FeaturePipeline, OperatorSpec

    f = FeaturePipeline([OperatorSpec("spatial"), OperatorSpec("symmetry")]).transform(glyphs.images(spark, sf_dir))
    names = ("top", "middle", "bottom", "left_right", "top_bottom")
    return f.select("image_id", *[F.round(F.get("features", F.lit(i)), 6).alias(n) for i, n in enumerate(names)], F.size("features").alias("feature_dim"))


@_query(shape_sql.regions_sql())
def topology_components_holes(spark, sf_dir):
    return shape.shapes(glyphs.images(spark, sf_dir)).select("image_id", "components", "holes")


@_query(shape_sql.regions_sql(inverted=True))
def topology_of_complements(spark, sf_dir):
    """Images with light and dark exchanged: several components, with holes that hold components."""
    images = glyphs.images(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: 1 - v))
    return shape.shapes(images).select("image_id", "components", "holes")


def _rounded(long: DataFrame) -> DataFrame:
    return long.select("image_id", "bin", F.round("share", 6).alias("share"))


@_query(shape_sql.ends_sql())
def topology_endpoints_junctions(spark, sf_dir):
    return shape.shapes(glyphs.images(spark, sf_dir)).select("image_id", "endpoints", "junctions")


@_query(shape_sql.directions_sql())
def stroke_direction(spark, sf_dir):
    return _rounded(shape.stroke_direction(shape.shapes(glyphs.images(spark, sf_dir))))


@_query(shape_sql.transitions_sql())
def direction_transition(spark, sf_dir):
    return _rounded(shape.direction_transition(shape.shapes(glyphs.images(spark, sf_dir))))


@_query(shape_sql.turns_sql())
def curvature(spark, sf_dir):
    return _rounded(shape.curvature(shape.shapes(glyphs.images(spark, sf_dir))))


_HOG_SQL = _PX + """, d AS (SELECT image_id, r, c, CASE WHEN r BETWEEN 1 AND 26 THEN lead(v) OVER down - lag(v) OVER down ELSE 0 END AS gr, CASE WHEN c BETWEEN 1 AND 26 THEN lead(v) OVER along - lag(v) OVER along ELSE 0 END AS gc
  FROM px WINDOW down AS (PARTITION BY image_id, c ORDER BY r), along AS (PARTITION BY image_id, r ORDER BY c)),
a AS (SELECT *, sqrt(gr * gr + gc * gc) AS size, degrees(atan2(gr, gc)) AS w FROM d),
b AS (SELECT image_id, r // 4 AS y, c // 4 AS x, size, least(8, CAST(floor(CASE WHEN w < 0 THEN w + 180 WHEN w >= 180 THEN w - 180 ELSE w END / 20) AS INTEGER)) AS o FROM a),
grid AS (SELECT vec_id AS image_id, y, x, o FROM embeddings, (SELECT unnest(range(7)) AS y), (SELECT unnest(range(7)) AS x), (SELECT unnest(range(9)) AS o)),
cells AS (SELECT g.image_id, g.y, g.x, g.o, coalesce(s.v, 0) AS v FROM grid g LEFT JOIN (SELECT image_id, y, x, o, sum(size) / 16 AS v FROM b GROUP BY ALL) s USING (image_id, y, x, o)),
blocks AS (SELECT image_id, p, q, (y - p) * 18 + (x - q) * 9 + o AS e, v FROM cells, (SELECT unnest(range(6)) AS p), (SELECT unnest(range(6)) AS q) WHERE y - p IN (0, 1) AND x - q IN (0, 1)),
once AS (SELECT *, least(v / sqrt(sum(v * v) OVER (PARTITION BY image_id, p, q) + 1e-10), 0.2) AS w FROM blocks)
SELECT image_id, CAST((p * 6 + q) * 36 + e AS INTEGER) AS pos, round(w / sqrt(sum(w * w) OVER (PARTITION BY image_id, p, q) + 1e-10), 5) AS v FROM once"""


@_query(_HOG_SQL)
def hog_descriptor(spark, sf_dir):
    return shape.hog(glyphs.images(spark, sf_dir)).select("image_id", F.posexplode("features").alias("pos", "v")).select("image_id", "pos", F.round("v", 5).alias("v"))


@_query(_PX + " SELECT image_id, CAST(label AS INTEGER) AS label, round(sum(v), 5) AS ink FROM px GROUP BY image_id, label")
def raw_scan(spark, sf_dir):
    n = _table(spark, sf_dir, "embeddings").count()
    raw = glyphs.images(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda v: F.round(v * 255).cast("int")))
    images = loaders.scan(raw, loaders.DataConfig(validation=50, train_rows=n * 6 // 7, test_rows=n - n * 6 // 7))
    return images.select("image_id", "label", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 5).alias("ink"))


# ---------------------------------------------------------------- samples and learning

_QUOTA_SQL = """q AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY exact - base DESC, label) <= {size} - sum(base) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT label, n, CAST(n AS DOUBLE) * {size} / sum(n) OVER () AS exact, floor(CAST(n AS DOUBLE) * {size} / sum(n) OVER ()) AS base FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)))"""


@_query("WITH " + _QUOTA_SQL.format(size=100) + " SELECT label, n, CAST(quota AS BIGINT) AS quota FROM q")
def class_quotas(spark, sf_dir):
    return sampling.quotas(_table(spark, sf_dir, "embeddings"), 100)


def _split_sql(size: int, seed: int, column: str) -> str:
    return f"WITH {_QUOTA_SQL.format(size=size)} SELECT vec_id AS image_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || vec_id), vec_id) <= quota AS {column} FROM embeddings JOIN q USING (label)"


@_query(_split_sql(100, 42, "validation"))
def stratified_split(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return sampling.stratified_sample(rows, 100, 42).withColumnRenamed("chosen", "validation")


def _rows_and_config(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    n = rows.count()
    return rows, loaders.DataConfig(validation=50, train_rows=n * 6 // 7, test_rows=n - n * 6 // 7)


@_query("WITH seen AS (SELECT * FROM embeddings WHERE vec_id < (SELECT count(*) * 6 // 7 FROM embeddings)), " + _split_sql(50, 42, "v").replace("FROM embeddings", "FROM seen").replace("WITH q", "q", 1).replace(f"SELECT vec_id AS image_id, label, row_number()", "SELECT vec_id AS image_id, label, CASE WHEN row_number()", 1).replace("<= quota AS v", "<= quota THEN 'validation' ELSE 'train' END AS split"))
def search_rows(spark, sf_dir):
    return loaders.search_rows(*_rows_and_config(spark, sf_dir))


@_query("SELECT vec_id AS image_id, label, CASE WHEN vec_id < (SELECT count(*) * 6 // 7 FROM embeddings) THEN 'train' ELSE 'test' END AS split FROM embeddings")
def final_rows(spark, sf_dir):
    return loaders.final_rows(*_rows_and_config(spark, sf_dir))


@_query(f"SELECT image_id, label FROM ({_split_sql(300, 11, 'chosen')}) WHERE chosen")
def stratified_subset(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    return sampling.stratified_sample(rows, 300, 11).filter("chosen").select("image_id", "label")


_LONG = "l AS (SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, CAST(embedding[d] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS d))"
_STATS = f"{_LONG}, s AS (SELECT dim, avg(v) AS mean, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS std FROM l GROUP BY dim)"


def _features(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("features"))


@_query(f"WITH {_STATS} SELECT dim, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def standardize_stats(spark, sf_dir):
    return learning.scale_statistics(_features(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@_query(f"WITH {_STATS} SELECT vec_id AS image_id, dim, round((v - mean) / std, 5) AS v FROM l JOIN s USING (dim)")
def standardized_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    long = f.select("image_id", F.posexplode("features").alias("dim", "v")).join(F.broadcast(learning.scale_statistics(f)), "dim")  # a row per feature
    return long.select("image_id", "dim", F.round((F.col("v") - F.col("mean")) / F.col("std"), 5).alias("v"))


@_query()
def logreg_predictions(spark, sf_dir):
    rows = sampling.stratified_sample(_features(spark, sf_dir), 100, 42)
    return learning.Learner().fit(rows.filter(~F.col("chosen"))).predict(rows.filter("chosen")).select("image_id", "label", "predicted")


@_query(f"WITH {_STATS} SELECT label, dim, true AS stationary FROM (SELECT DISTINCT label FROM embeddings), (SELECT DISTINCT dim FROM l UNION ALL SELECT max(dim) + 1 FROM l)")
def fit_certificate(spark, sf_dir):
    """The gradient at the fitted weights, class by class and dimension by dimension, is below the tolerance."""
    rows = _features(spark, sf_dir).withColumn("samples", F.array(F.lit(0)))
    dim = rows.select(F.size("features")).first()[0]
    (model,) = many_fits.fit_many(rows, [many_fits.Model(0, tuple(range(dim)))])
    return many_fits.gradients(rows, model).select("label", "dim", (F.abs("gradient") < 1e-7).alias("stationary"))


@_query()
def evaluate_spec(spark, sf_dir):
    from featurelab.plans.evaluation import Evaluator
    from featurelab.plans.compiler import OperatorSpec

    return Evaluator(glyphs.images(spark, sf_dir), validation=100, sizes=(100, 300)).evaluate([OperatorSpec("spatial"), OperatorSpec("symmetry")])


@_query()
def baseline_sweep(spark, sf_dir):
    from featurelab.plans.evaluation import Evaluator
    from featurelab.plans.compiler import OperatorSpec

    e = Evaluator(glyphs.images(spark, sf_dir), validation=100, sizes=(100, 300))
    return e.evaluate_many([[OperatorSpec(k)] for k in ("raw_pixels", "downsampled", "hog")], controls=True)


@_query()
def seed_sweep(spark, sf_dir):
    from featurelab.plans.compiler import seed_specs
    from featurelab.plans.runs import seed_sweep as sweep

    return sweep(glyphs.images(spark, sf_dir), seed_specs()[1:], validation=100, sizes=(50, 100))


@_query()
def runs_grid(spark, sf_dir):
    from featurelab.plans import runs
    from featurelab.plans.compiler import OperatorSpec

    images = glyphs.images(spark, sf_dir)
    split = loaders.final_rows(images, _rows_and_config(spark, sf_dir)[1])
    train, test = (split.filter(F.col("split") == k).drop("split") for k in ("train", "test"))
    return runs.runs_grid(train, test, [("layout", "finalist", [OperatorSpec("spatial"), OperatorSpec("symmetry")])], (50, 100), (11, 23))


_P1 = rec.predictions_sql("p", 1)
_CELLS = """cells AS (SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS a), (SELECT unnest(range(10)) AS b)
  LEFT JOIN (SELECT label, predicted AS pr, count(*) AS n FROM {p} GROUP BY ALL) ON a = label AND b = pr)"""


@_query(f"WITH {_P1} SELECT round(avg(CASE WHEN label = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM p")
def accuracy_metric(spark, sf_dir):
    return learning.accuracy(rec.predictions(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@_query(f"WITH {_P1}, {_CELLS.format(p='p')} SELECT * FROM cells")
def confusion_matrix(spark, sf_dir):
    return learning.confusion(rec.predictions(spark, sf_dir))


@_query(f"WITH {_P1}, {_CELLS.format(p='p')} SELECT * FROM cells WHERE actual <> predicted AND n > 0 ORDER BY n DESC, actual, predicted LIMIT 5")
def confusion_pairs_top5(spark, sf_dir):
    return archive.confusion_pairs(learning.confusion(rec.predictions(spark, sf_dir)))


@_query(f"WITH {_P1}, {_CELLS.format(p='p')} SELECT actual, predicted, round(CASE WHEN sum(n) OVER (PARTITION BY actual) > 0 THEN n / sum(n) OVER (PARTITION BY actual) ELSE 0 END, 6)::DOUBLE AS share FROM cells")
def confusion_row_normalized(spark, sf_dir):
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("actual"))
    return learning.confusion(rec.predictions(spark, sf_dir)).select("actual", "predicted", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6).alias("share"))


_FEEDBACK = f"""WITH {_P1}, {rec.predictions_sql("p2", 11)}, {_CELLS.format(p="p")}, {_CELLS.format(p="p2").replace("cells AS", "after AS", 1)}
SELECT c.actual, c.predicted, c.n AS baseline_count, a.n AS candidate_count, c.n - a.n AS improvement
FROM (SELECT * FROM cells WHERE actual <> predicted AND n > 0 ORDER BY n DESC, actual, predicted LIMIT 5) c JOIN after a USING (actual, predicted)"""


@_query(_FEEDBACK)
def failure_feedback_improvement(spark, sf_dir):
    before, after = (learning.confusion(rec.predictions(spark, sf_dir, k)) for k in (1, 11))
    return archive.feedback(archive.confusion_pairs(before), after)


# ---------------------------------------------------------------- archive

_SHOWN = ["candidate_id", "accuracy_500", "accuracy_5000", "feature_dim"]
_SCORE_ORDER = "round(ranking_score, 9) DESC, accuracy_500 DESC, accuracy_5000 DESC, feature_dim, candidate_id"


@_query(_R + " SELECT candidate_id, round(ranking_score, 6) AS ranking_score FROM records")
def ranking_score(spark, sf_dir):
    return rec.search_records(spark, sf_dir).select("candidate_id", F.round("ranking_score", 6).alias("ranking_score"))


@_query(_R + " SELECT candidate_id, record_type FROM rankable")
def rankable_records(spark, sf_dir):
    return archive.rankable(rec.search_records(spark, sf_dir)).select("candidate_id", "record_type")


@_query(_R + f" SELECT {', '.join(_SHOWN)} FROM rankable ORDER BY {_SCORE_ORDER} LIMIT 10")
def archive_top_k(spark, sf_dir):
    return archive.top(rec.search_records(spark, sf_dir).withColumn("ranking_score", F.round("ranking_score", 9)), 10).select(*_SHOWN)


@_query(_R + f" SELECT {', '.join(_SHOWN)} FROM rankable ORDER BY accuracy_500 DESC, accuracy_5000 DESC, feature_dim, runtime_ms, candidate_id LIMIT 10")
def archive_top_by_accuracy(spark, sf_dir):
    return archive.top(rec.search_records(spark, sf_dir), 10, archive.BY_ACCURACY).select(*_SHOWN)


@_query(_R + f" SELECT candidate_id, generation, accuracy_500, accuracy_5000, feature_dim, round(ranking_score, 6) AS ranking_score FROM rankable ORDER BY {_SCORE_ORDER} LIMIT 5")
def best_candidates(spark, sf_dir):
    best = archive.top(rec.search_records(spark, sf_dir).withColumn("ranking_score", F.round("ranking_score", 9)), 5)
    return best.select("candidate_id", "generation", "accuracy_500", "accuracy_5000", "feature_dim", F.round("ranking_score", 6).alias("ranking_score"))


_FORCED = hashlib.sha256(b"5").hexdigest()
_ROLES = f"""{_R}, c AS (
  SELECT candidate_id, 'top_5_low_data_accuracy_rank_' || n AS role, n AS ord FROM (SELECT candidate_id, row_number() OVER (ORDER BY accuracy_500 DESC, accuracy_5000 DESC, feature_dim, runtime_ms, candidate_id) AS n FROM rankable) WHERE n <= 5
  UNION ALL (SELECT candidate_id, 'smallest_representation', 6 FROM rankable ORDER BY feature_dim, accuracy_500 DESC, runtime_ms, candidate_id LIMIT 1)
  UNION ALL (SELECT candidate_id, 'fastest_representation', 7 FROM rankable ORDER BY runtime_ms, accuracy_500 DESC, feature_dim, candidate_id LIMIT 1)
  UNION ALL SELECT candidate_id, 'original_stroke_flow_hypothesis', 8 FROM records WHERE candidate_id = '{_FORCED}' AND record_type = 'candidate')
SELECT candidate_id, string_agg(role, ',' ORDER BY role) AS roles, CAST(min(ord) AS BIGINT) AS ord, any_value(accuracy_500) AS accuracy_500, any_value(feature_dim) AS feature_dim FROM c JOIN records USING (candidate_id) GROUP BY candidate_id"""


@_query(_ROLES)
def finalists_with_roles(spark, sf_dir):
    return archive.with_roles(rec.search_records(spark, sf_dir), _FORCED)


@_query(_R + " SELECT candidate_id, feature_dim FROM rankable ORDER BY feature_dim, accuracy_500 DESC, runtime_ms, candidate_id LIMIT 1")
def smallest_representation(spark, sf_dir):
    return archive.rankable(rec.search_records(spark, sf_dir)).orderBy("feature_dim", F.desc("accuracy_500"), "runtime_ms", "candidate_id").limit(1).select("candidate_id", "feature_dim")


@_query(_R + " SELECT candidate_id, round(runtime_ms, 6) AS runtime_ms FROM rankable ORDER BY rankable.runtime_ms, accuracy_500 DESC, feature_dim, candidate_id LIMIT 1")
def fastest_representation(spark, sf_dir):
    return archive.rankable(rec.search_records(spark, sf_dir)).orderBy("runtime_ms", F.desc("accuracy_500"), "feature_dim", "candidate_id").limit(1).select("candidate_id", F.round("runtime_ms", 6).alias("runtime_ms"))


@_query(_R + f""", e AS (SELECT * FROM rankable ORDER BY {_SCORE_ORDER} LIMIT 5), x AS (SELECT candidate_id AS parent_id, operators, unnest(range(1, 3)) AS pos FROM e)
SELECT parent_id, operators[pos] AS removed, operators[3 - pos] AS remaining, substr(sha256(operators[pos]), 1, 8) AS suffix FROM x WHERE pos = list_position(operators, operators[pos])""")
def ablation_candidates(spark, sf_dir):
    return archive.ablation_candidates(rec.search_records(spark, sf_dir).withColumn("ranking_score", F.round("ranking_score", 9)))


_DELTA = _R + " , d AS (SELECT r.candidate_id, r.base_candidate_id, r.removed_operator, r.accuracy_500 AS without_operator, b.accuracy_500 AS with_operator, round(b.accuracy_500 - r.accuracy_500, 6) AS delta FROM records r JOIN records b ON r.base_candidate_id = b.candidate_id WHERE r.record_type = 'ablation')"


@_query(_DELTA + " SELECT * FROM d")
def ablation_delta(spark, sf_dir):
    return archive.ablation_deltas(rec.search_records(spark, sf_dir))


@_query(_DELTA + " SELECT * FROM d ORDER BY abs(delta) DESC, candidate_id LIMIT 10")
def ablation_evidence_top10(spark, sf_dir):
    return archive.ablation_deltas(rec.search_records(spark, sf_dir)).orderBy(F.abs("delta").desc(), "candidate_id").limit(10)


@_query(_R + """, s AS (SELECT seq, operators, proposal_category AS category, list_aggregate(list_sort(operators), 'string_agg', ',') AS key FROM records)
SELECT key, seq AS ord, category FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM s WHERE seq >= 20) WHERE n = 1 AND key NOT IN (SELECT key FROM s WHERE seq < 20)""")
def proposal_dedupe(spark, sf_dir):
    r = rec.search_records(spark, sf_dir).withColumnRenamed("proposal_category", "category").withColumnRenamed("seq", "ord")
    return archive.dedupe_proposals(r.filter("ord >= 20"), r.filter("ord < 20")).select("key", "ord", "category")


@_query(f"SELECT p_partkey AS slot, {rec._sql_list(rec.CATEGORIES)}[p_partkey % 4 + 1] AS category FROM part")
def category_cycle(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot"), rec._pick(rec.CATEGORIES, F.col("p_partkey") % 4).alias("category"))


@_query(_R + """, s AS (SELECT seq, list_aggregate(list_sort(operators), 'string_agg', ',') AS key FROM records ORDER BY seq DESC LIMIT 20)
SELECT key, min(seq) AS first_seq FROM s GROUP BY key ORDER BY first_seq DESC LIMIT 20""")
def explored_last20(spark, sf_dir):
    r = rec.search_records(spark, sf_dir).orderBy(F.desc("seq")).limit(20).select("seq", F.array_join(F.array_sort("operators"), ",").alias("key"))
    return r.groupBy("key").agg(F.min("seq").alias("first_seq")).orderBy(F.desc("first_seq")).limit(20)


_TWICE = _R + ", t AS (SELECT candidate_id, record_type || '|' || list_aggregate(operators, 'string_agg', ',') || '|' || generation AS body FROM records UNION ALL SELECT candidate_id, record_type || '|' || list_aggregate(operators, 'string_agg', ',') || '|' || (generation + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END) FROM records WHERE seq % 5 = 0)"


@_query(_TWICE + " SELECT candidate_id, count(DISTINCT body) AS versions FROM t GROUP BY candidate_id HAVING count(DISTINCT body) > 1")
def archive_conflicts(spark, sf_dir):
    r = rec.search_records(spark, sf_dir)
    again = r.filter("seq % 5 = 0").withColumn("generation", F.col("generation") + F.when(F.col("seq") % 10 == 0, 1).otherwise(0))
    return archive.conflicts(r.unionByName(again))


@_query(_R + " SELECT record_type, count(*) AS added FROM records WHERE candidate_id NOT IN (SELECT candidate_id FROM records WHERE generation < 5) GROUP BY record_type")
def archive_new_records(spark, sf_dir):
    r = rec.search_records(spark, sf_dir)
    return r.join(r.filter("generation < 5").select("candidate_id"), "candidate_id", "left_anti").groupBy("record_type").agg(F.count("*").alias("added"))


@_query(_R + " SELECT generation, record_type, count(*) AS n FROM records GROUP BY ALL")
def generation_counts(spark, sf_dir):
    return rec.search_records(spark, sf_dir).groupBy("generation", "record_type").agg(F.count("*").alias("n"))


@_query(_R + ", g AS (SELECT generation, max(accuracy_500) AS best, count(*) AS candidates FROM records WHERE record_type = 'candidate' GROUP BY 1) SELECT *, max(best) OVER (ORDER BY generation) AS best_so_far FROM g")
def generation_best_so_far(spark, sf_dir):
    return archive.best_so_far(rec.search_records(spark, sf_dir))


# ---------------------------------------------------------------- reports


@_query("WITH " + rec.RUNS_SQL + " SELECT representation, CAST(size AS INTEGER) AS size, round(avg(accuracy), 6) AS mean_accuracy, round(coalesce(stddev_samp(accuracy), 0), 6) AS std_accuracy, count(*) AS n FROM runs GROUP BY 1, 2")
def seed_summary_mean_std(spark, sf_dir):
    return archive.summaries(rec.seed_runs(spark, sf_dir))


@_query(f"WITH {_P1}, {rec.predictions_sql('p2', 11)}, {_CELLS.format(p='(SELECT * FROM p UNION ALL SELECT * FROM p2)')} SELECT * FROM cells")
def confusion_matrix_sum(spark, sf_dir):
    cells = [learning.confusion(rec.predictions(spark, sf_dir, k)) for k in (1, 11)]
    return cells[0].unionByName(cells[1]).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


@_query(_R + ", s AS (SELECT list_aggregate(operators, 'string_agg', ',') AS key, seq, candidate_id FROM records) SELECT key, arg_min(candidate_id, seq) AS first_id, count(*) AS n FROM s GROUP BY key")
def unique_representations(spark, sf_dir):
    r = rec.search_records(spark, sf_dir).withColumn("key", F.array_join("operators", ","))
    return r.groupBy("key").agg(F.min_by("candidate_id", "seq").alias("first_id"), F.count("*").alias("n"))


@_query(_R + ", s AS (SELECT list_aggregate(operators, 'string_agg', ',') AS key, runtime_ms, accuracy_500 FROM records) SELECT key, round(max(runtime_ms), 6) AS feature_cost, round(avg(accuracy_500), 6) AS accuracy FROM s GROUP BY key")
def runtime_vs_accuracy(spark, sf_dir):
    r = rec.search_records(spark, sf_dir).withColumn("key", F.array_join("operators", ","))
    return r.groupBy("key").agg(F.round(F.max("runtime_ms"), 6).alias("feature_cost"), F.round(F.avg("accuracy_500"), 6).alias("accuracy"))


_WORDS = "CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS BIGINT)"


@_query(f"""WITH a AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS turn, {_WORDS} AS w FROM conversations WHERE role = 'assistant')
SELECT CAST(coalesce(sum(CASE WHEN b.w IS NOT NULL THEN a.w END), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(b.w), 0) AS BIGINT) AS response_tokens, bool_and(b.w IS NOT NULL) AS complete, count(*) AS requests FROM a LEFT JOIN b USING (conv_id, turn)""")
def token_usage_summary(spark, sf_dir):
    return archive.token_usage(_table(spark, sf_dir, "conversations"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_keys(props) = ['k'] AS strict FROM events")
def response_json_guard(spark, sf_dir):
    keys = F.json_object_keys("props")
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (keys == F.array(F.lit("k"))).alias("strict"))


_REPORT = "WITH " + rec.REPORT_SQL


def _report(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return rec.report_results(spark, sf_dir), rec.report_runs(spark, sf_dir)


def _round_means(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy_mean", "accuracy_std") if c in df.columns})


@_query(_REPORT + " SELECT key, CAST(ord AS INTEGER) AS ord, name, kind, feature_dim, feature_ms FROM u")
def unique_results(spark, sf_dir):
    return reports.unique(rec.report_results(spark, sf_dir))


@_query(_REPORT + " SELECT name, kind, size, accuracy_mean, accuracy_std FROM u JOIN z USING (ord)")
def learning_curve(spark, sf_dir):
    return _round_means(reports.learning_curve(*_report(spark, sf_dir)))


@_query(_REPORT + " SELECT name, kind, feature_dim, accuracy_mean, accuracy_std FROM u JOIN z USING (ord) WHERE size = 500")
def dimension_vs_accuracy(spark, sf_dir):
    return _round_means(reports.dimension_and_accuracy(*_report(spark, sf_dir)))


@_query(_REPORT + " SELECT name, kind, round((feature_ms + training_ms + inference_ms) / 1000, 6) AS seconds, accuracy_mean FROM u JOIN z USING (ord) WHERE size = 500")
def seconds_vs_accuracy(spark, sf_dir):
    return _round_means(reports.runtime_and_accuracy(*_report(spark, sf_dir))).withColumn("seconds", F.round("seconds", 6))


@_query(_DELTA + """ , x AS (SELECT d.candidate_id, 'G' || r.generation || ' −' || d.removed_operator || ' · ' || substr(d.candidate_id, 1, 6) AS label, round(d.delta * 100, 4) AS points, d.delta > 0 AS useful FROM d JOIN records r USING (candidate_id))
SELECT *, row_number() OVER (ORDER BY points, candidate_id) AS place FROM x""")
def ablation_contributions(spark, sf_dir):
    deltas = archive.ablation_deltas(rec.search_records(spark, sf_dir), "generation")
    return reports.numbered(reports.ablation_contributions(deltas), "points", "candidate_id")


@_query(f"SELECT candidate_id AS name, 'finalist' AS kind, candidate_id, roles, feature_dim FROM ({_ROLES}) UNION ALL VALUES ('raw_pixels_baseline', 'baseline', NULL, '', 784), ('hog_9bin_4x4_baseline', 'baseline', NULL, '', 1296)")
def representations_list(spark, sf_dir):
    return reports.representations(archive.with_roles(rec.search_records(spark, sf_dir), _FORCED))


@_query(f"SELECT f.candidate_id, f.roles, r.accuracy_500, r.accuracy_5000, r.feature_dim, round(r.runtime_ms, 6) AS runtime_ms, round(r.ranking_score, 6) AS ranking_score, list_aggregate(r.operators, 'string_agg', ',') AS operators FROM ({_ROLES}) f JOIN ({_R} SELECT * FROM records) r USING (candidate_id)")
def candidate_summary(spark, sf_dir):
    r = rec.search_records(spark, sf_dir)
    roles = archive.with_roles(r, _FORCED).select("candidate_id", "roles")
    columns = ["accuracy_500", "accuracy_5000", "feature_dim", F.round("runtime_ms", 6).alias("runtime_ms"), F.round("ranking_score", 6).alias("ranking_score"), F.array_join("operators", ",").alias("operators")]
    return F.broadcast(roles).join(r, "candidate_id").select("candidate_id", "roles", *columns)  # eight roles at most


@_query(_R + f" SELECT 'part ' || seq AS name, 'more of ' || operators[1] || ' tells classes apart' AS hypothesis, list_aggregate(operators, 'string_agg', ',') AS operators, accuracy_500, accuracy_5000, feature_dim FROM rankable ORDER BY {_SCORE_ORDER} LIMIT 5")
def candidate_evidence(spark, sf_dir):
    best = archive.top(rec.search_records(spark, sf_dir).withColumn("ranking_score", F.round("ranking_score", 9)), 5)
    texts = [F.concat(F.lit("part "), F.col("seq").cast("string")).alias("name"), F.concat(F.lit("more of "), F.get("operators", F.lit(0)), F.lit(" tells classes apart")).alias("hypothesis")]
    return best.select(*texts, F.array_join("operators", ",").alias("operators"), "accuracy_500", "accuracy_5000", "feature_dim")


_ALL = "record_type, base_candidate_id, removed_operator, proposal_category, accuracy_500, accuracy_5000, feature_dim, runtime_ms, ranking_score, operators"


@_query(_R + f", t AS (SELECT candidate_id, generation, {_ALL} FROM records UNION ALL SELECT candidate_id, generation, {_ALL.replace('runtime_ms', 'runtime_ms + CASE WHEN seq % 10 = 0 THEN 1 ELSE 0 END')} FROM records WHERE seq % 5 = 0) SELECT candidate_id, count(DISTINCT (generation, {_ALL})) AS versions FROM t GROUP BY candidate_id HAVING count(DISTINCT (generation, {_ALL})) > 1")
def archive_conflicts_all_fields(spark, sf_dir):
    r = rec.search_records(spark, sf_dir)
    again = r.filter("seq % 5 = 0").withColumn("runtime_ms", F.col("runtime_ms") + F.when(F.col("seq") % 10 == 0, 1).otherwise(0))
    return reports.conflicts(r.unionByName(again))


_SPEC_SQL = _R + """, s AS (SELECT seq, 'part ' || seq AS name, 'more "' || operators[1] || '" \\ ' || p_name AS hypothesis, 'better' || chr(10) || 'than before' AS prediction, 'it isn' || chr(39) || 't' AS falsification,
  list_transform(operators, lambda o: '{"name":"' || o || '","params":{' || CASE WHEN o = 'topology' AND seq % 3 = 0 THEN '"threshold":0.' || (seq % 9 + 1) ELSE '' END || '}}') AS operators FROM records JOIN part ON p_partkey = seq),
e AS (SELECT seq, name, list_aggregate(operators, 'string_agg', ',') AS operators, sha256('{"falsification":' || q(falsification) || ',"hypothesis":' || q(hypothesis) || ',"name":' || q(name) || ',"operators":[' || list_aggregate(operators, 'string_agg', ',') || '],"prediction":' || q(prediction) || '}') AS candidate_id FROM s)
SELECT * FROM e"""
_QUOTED = r"""'"' || replace(replace(replace(\1, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"'"""


@_query(re.sub(r"\bq\((\w+)\)", _QUOTED, _SPEC_SQL))
def archived_identities(spark, sf_dir):
    """Records with whole specifications pass the archive's check, which recomputes each id."""
    names = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), "p_name")
    r = rec.search_records(spark, sf_dir).join(names.hint("merge"), "seq")  # both sides have a row per record
    threshold = F.concat(F.lit("0."), (F.col("seq") % 9 + 1).cast("string"))
    operators = F.transform("operators", lambda o: canonical.operator_json(o, F.when((o == "topology") & (F.col("seq") % 3 == 0), threshold)))
    prose = {
        "name": F.concat(F.lit("part "), F.col("seq").cast("string")), "hypothesis": F.concat(F.lit('more "'), F.get("operators", F.lit(0)), F.lit('" \\ '), F.col("p_name")),
        "prediction": F.lit("better\nthan before"), "falsification": F.lit("it isn't"),
    }
    whole = r.withColumns(prose).withColumn("operators", operators)
    known = whole.withColumn("candidate_id", canonical.spec_id(*[F.col(p) for p in archive_files.PROSE], F.col("operators")))
    return archive_files.checked_records(known).select("seq", "name", F.array_join("operators", ",").alias("operators"), "candidate_id")


@_query(_R + " SELECT count(*) FILTER (record_type = 'candidate') AS candidates, count(*) FILTER (record_type = 'candidate' AND generation >= 5) AS candidates_added, count(*) FILTER (record_type = 'ablation' AND generation >= 5) AS ablations_added FROM records")
def record_totals(spark, sf_dir):
    r = rec.search_records(spark, sf_dir)
    return reports.new_record_totals(r, r.filter("generation < 5"))


@_query(_R + ", i AS (SELECT DISTINCT sha256(CAST(s_suppkey * 7 AS VARCHAR)) AS candidate_id FROM supplier) SELECT candidate_id, r.seq, r.generation, r.candidate_id IS NOT NULL AS found FROM i LEFT JOIN records r USING (candidate_id)".replace("r.candidate_id IS NOT NULL", "r.seq IS NOT NULL"))
def archive_lookup(spark, sf_dir):
    ids = _table(spark, sf_dir, "supplier").select(F.sha2((F.col("s_suppkey") * 7).cast("string"), 256).alias("candidate_id"))
    return reports.lookup(rec.search_records(spark, sf_dir), ids).select("candidate_id", "seq", "generation", "found")


_A = "WITH " + rec.ANSWERS_SQL


@_query(_A + " SELECT event_id, accepted FROM answers")
def accepted_responses(spark, sf_dir):
    return rec.answers(spark, sf_dir).select("event_id", responses.accepted(F.col("text")).alias("accepted"))


@_query(_A + " SELECT event_id, CASE WHEN prompt_tokens >= 0 THEN prompt_tokens END AS prompt_tokens, CASE WHEN response_tokens >= 0 THEN response_tokens END AS response_tokens FROM answers")
def token_guard(spark, sf_dir):
    return rec.answers(spark, sf_dir).select("event_id", *[responses.token_count(F.col(c)).alias(c) for c in ("prompt_tokens", "response_tokens")])


@_query("SELECT conv_id, turn, left(text, 500) AS error FROM conversations")
def error_truncation(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", responses.error_text(F.col("text")).alias("error"))


@_query(_A + """ SELECT CAST(coalesce(sum(prompt_tokens) FILTER (prompt_tokens IS NOT NULL AND response_tokens IS NOT NULL), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(response_tokens) FILTER (prompt_tokens IS NOT NULL AND response_tokens IS NOT NULL), 0) AS BIGINT) AS response_tokens,
  bool_and(prompt_tokens IS NOT NULL AND response_tokens IS NOT NULL) AS complete, count(*) AS answers, count(*) FILTER (accepted) AS accepted, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM answers""")
def model_usage(spark, sf_dir):
    return responses.usage(rec.answers(spark, sf_dir))


@_query(f"WITH {rec.PROPOSING_SQL} SELECT event_id, coalesce(proposals, 0) AS proposals, coalesce(sound, 0) AS sound, coalesce(proposals > 0 AND proposals = sound, false) AS accepted FROM answers LEFT JOIN verdicts USING (event_id)")
def proposal_verdicts(spark, sf_dir):
    return responses.verdicts(rec.proposing_answers(spark, sf_dir), rec.OPERATORS, "event_id")
