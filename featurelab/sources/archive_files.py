"""Archives on disk: search records and model responses as JSON Lines, cached features, frozen finalists.

An archive is a folder of commits of JSON Lines (see ``commits``). Adding records is idempotent: equal ones are left out,
an id that comes with other contents is an error, whoever writes at the same time, and a failing job adds nothing.

A record has the columns of RECORDS and may have those of PROVENANCE: the prose of its specification, with which its id
is recomputed, parents, prompt and model, confusion matrix and feedback."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from featurelab.functions import canonical
from featurelab.operators import archive
from featurelab.plans.compiler import FeaturePipeline, OperatorSpec
from featurelab.sources import commits
from featurelab.sources.records import CATEGORIES

RECORDS = (
    "seq bigint, candidate_id string, generation bigint, record_type string, base_candidate_id string, removed_operator string, proposal_category string, "
    "accuracy_500 double, accuracy_5000 double, feature_dim int, runtime_ms double, ranking_score double, operators array<string>"
)
PROSE = ("name", "hypothesis", "prediction", "falsification")
PROVENANCE = (
    "name string, hypothesis string, prediction string, falsification string, parent_ids array<string>, prompt string, model string, confusion_matrix array<array<bigint>>, "
    "failure_feedback array<struct<actual:int,predicted:int,baseline_count:bigint,candidate_count:bigint>>"
)
WHOLE = f"{RECORDS}, {PROVENANCE}"
RESPONSES = "prompt string, response string, model string, attempt int, accepted boolean, error string, prompt_tokens bigint, response_tokens bigint, total_tokens bigint"


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def _found(read) -> DataFrame | None:
    """What ``read`` gives; None where nothing whole has been written."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


_ID = "^[0-9a-f]{64}$"


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _rules() -> dict[str, Column]:
    ablation, c = F.col("record_type") == "ablation", F.col
    no, told = lambda name: c(name).isNull(), sum(c(p).isNotNull().cast("int") for p in PROSE)
    share = lambda x: (x >= 0) & (x <= 1) & ~F.isnan(x)
    return {
        "candidate_id must be 64 hex digits": c("candidate_id").rlike(_ID),
        "generation must not be negative": c("generation") >= 0,
        "record_type must be candidate or ablation": c("record_type").isin("candidate", "ablation"),
        "an ablation has a base, a removed operator and no category": ~ablation | (c("base_candidate_id").rlike(_ID) & (F.length("removed_operator") > 0) & c("proposal_category").isNull()),
        "a candidate has no base and no removed operator": ablation | (c("base_candidate_id").isNull() & c("removed_operator").isNull()),
        "unknown proposal_category": c("proposal_category").isNull() | c("proposal_category").isin(*CATEGORIES),
        "accuracies must be between 0 and 1": share(c("accuracy_500")) & share(c("accuracy_5000")),
        "feature_dim must be positive": c("feature_dim") > 0,
        "runtime_ms must be finite and not negative": (c("runtime_ms") >= 0) & (c("runtime_ms") < float("inf")),
        "operators must not be empty": F.size("operators") > 0,
        "a specification has a name, a hypothesis, a prediction and a falsification": (told == 0) | ((told == len(PROSE)) & _all(*[F.trim(c(p)) != "" for p in PROSE])),
        "candidate_id isn't that of the specification": (told == 0) | (c("candidate_id") == canonical.spec_id(*[c(p) for p in PROSE], c("operators"))),
        "parents are other candidates, each named once": no("parent_ids") | (F.forall("parent_ids", lambda i: i.rlike(_ID) & (i != c("candidate_id"))) & (F.size(F.array_distinct("parent_ids")) == F.size("parent_ids"))),
        "the base of an ablation is a parent": no("parent_ids") | ~ablation | F.array_contains("parent_ids", c("base_candidate_id")),
        "prompt and model come together and aren't blank": (no("prompt") & no("model")) | ((F.trim("prompt") != "") & (F.trim("model") != "")),
        "an ablation has no prompt and no feedback": ~ablation | (no("prompt") & no("failure_feedback")),
        "feedback belongs to failure-driven candidates": no("failure_feedback") | (F.size("failure_feedback") == 0) | (c("proposal_category") == "failure-driven"),
        "a confusion matrix is square, of counts": no("confusion_matrix") | F.forall("confusion_matrix", lambda r: (F.size(r) == F.size("confusion_matrix")) & F.forall(r, lambda n: n >= 0)),
    }


def _fault() -> Column:
    """What is wrong with a record; null for a sound one. A rule that is null is broken too."""
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in _rules().items()])
    return F.concat(F.lit("record "), F.coalesce(F.col("candidate_id"), F.lit("without id")), F.lit(": "), broken)


def _whole(records: DataFrame) -> DataFrame:
    """``records`` in all columns; what they don't have is null."""
    return records.select(*[(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(WHOLE)])


def checked_records(records: DataFrame) -> DataFrame:
    """``records`` in the archive's columns; one that breaks a rule raises an error that names it. The record is checked
    as one value: what is generated from it are plain columns, in which no rule is repeated."""
    row = _whole(records).select(F.struct(*_names(WHOLE)).alias("_r"), _fault().alias("_fault"))
    return row.select(F.inline(F.array(F.when(F.col("_fault").isNull(), F.col("_r")).otherwise(F.raise_error(F.col("_fault"))))))


def _contents() -> Column:
    return F.to_json(F.struct(*[n for n in _names(WHOLE) if n != "seq"]))


def _one_each(records: DataFrame) -> DataFrame:
    """The first of equal records; an id with different contents raises an error. Partial aggregates, so an id
    that comes again and again meets as one row per task."""
    row = records.select("candidate_id", F.struct(*_names(WHOLE)).alias("_r"), _contents().alias("_c"))
    each = row.groupBy("candidate_id").agg(F.min_by("_r", "_r.seq").alias("_r"), F.min("_c").alias("_least"), F.max("_c").alias("_most"))
    conflict = F.raise_error(F.concat(F.lit("conflicting records for candidate "), F.col("candidate_id")))
    return each.select(F.inline(F.array(F.when(F.col("_least") == F.col("_most"), F.col("_r")).otherwise(conflict))))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path)  # folders whose names begin with _ are left out


def _known_keys(schema: str) -> Column:
    return F.coalesce(F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, _names(schema))))) == 0, F.lit(False))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines of exactly ``schema``'s keys (null ones may be left out), without blank lines; a malformed line
    or an unknown key raises an error. Each line is parsed once, into plain columns."""
    wrong = F.raise_error(F.concat(F.lit("not an object of known keys: "), F.substring("value", 1, 200)))
    value = F.when(_known_keys(schema), F.col("value")).otherwise(wrong)
    return _lines(spark, path).filter("trim(value) <> ''").select(F.inline(F.array(F.from_json(value, schema, {"mode": "FAILFAST"}))))


def check_archive(spark: SparkSession, path: str) -> int:
    """The number of records in the archive's lines; a ValueError that names file and line of the first fault of a file
    that has one.

    One pass: each split of a file tells its number of lines and its first fault. Where a split's lines begin in its file
    follows from the splits before, of which there is one row each."""
    lines = _lines(spark, path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    parsed = lines.select("file", "start", "value", _known_keys(WHOLE).alias("known"), F.from_json("value", f"{WHOLE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    plain = parsed.select("file", "start", "value", "known", F.inline(F.array("_r")))
    fault = F.when(F.trim("value") == "", F.lit(None)).when(~F.col("known") | F.col("_bad").isNotNull(), F.lit("not an object of known keys")).otherwise(_fault())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits: dict[tuple, list] = {}
        for batch in batches:
            for file, start, blank, what in zip(*(c.to_pylist() for c in batch.columns)):
                own = splits.setdefault((file, start), [0, 0, None, None])  # a task reads a split from its beginning to its end
                own[0] += 1
                own[1] += not blank
                if what is not None and own[2] is None:
                    own[2:] = own[0], what
        rows = [(*k, *v) for k, v in splits.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "start", "lines", "records", "at", "what"])

    splits = plain.select("file", "start", (F.trim("value") == "").alias("blank"), fault.alias("what")).mapInArrow(told, "file string, start bigint, lines bigint, records bigint, at bigint, what string")
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    numbered = splits.withColumn("line", F.coalesce(before, F.lit(0)) + F.col("at"))
    first = numbered.agg(F.sum("records").alias("records"), F.min(F.when(F.col("at").isNotNull(), F.struct("file", "line", "what"))).alias("fault")).first()
    if first.fault:
        raise ValueError(f"{first.fault.file}:{first.fault.line}: {first.fault.what}")
    return first.records or 0


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records, each once, checked. Order by ``seq`` for that of insertion."""
    return _one_each(checked_records(read_lines(spark, path, WHOLE)))


def appended_since(spark: SparkSession, path: str, seq: int) -> DataFrame:
    """Records after ``seq``."""
    return read_records(spark, path).filter(F.col("seq") > seq)


def append_records(records: DataFrame, path: str) -> None:
    """Add those ``records`` that the archive at ``path`` doesn't have. Of writers at the same time each sees what those
    before it have committed."""
    spark = records.sparkSession
    fresh = _one_each(checked_records(records))

    def missing() -> DataFrame:
        old = _found(lambda: read_records(spark, path))
        if old is None:
            return fresh
        had = fresh.withColumn("_new", _contents()).join(old.select("candidate_id", _contents().alias("_old")), "candidate_id", "left")
        other = F.raise_error(F.concat(F.lit("other contents are archived for candidate "), F.col("candidate_id")))
        return had.filter(F.when(F.col("_old").isNull(), F.lit(True)).when(F.col("_old") == F.col("_new"), F.lit(False)).otherwise(other)).select(_names(WHOLE))

    commits.append(spark, path, missing)


def append_responses(responses: DataFrame, path: str) -> None:
    """Add a language model's ``responses``, accepted or not, to a log."""
    commits.append(responses.sparkSession, path, lambda: responses.select(_names(RESPONSES)))


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the SHA-256 of each data file, by its path within the archive: files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    each = files.select(F.substring_index("path", "/", -2).alias("name"), F.sha2("content", 256).alias("sha"))
    all_ = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda x: x["sha"]), "").alias("all"))
    return all_.select(F.sha2("all", 256)).first()[0]


def freeze_finalists(spark: SparkSession, path: str, out: str, forced_id: str) -> DataFrame:
    """Choose the finalists of the archive at ``path`` and write them with its checksum. An archive without
    eligible records or without the forced candidate raises a ValueError, as does an earlier choice at ``out``."""
    check_archive(spark, path)
    records = read_records(spark, path)
    if archive.rankable(records).isEmpty():
        raise ValueError("the archive has no eligible records")
    if records.filter((F.col("candidate_id") == forced_id) & (F.col("record_type") == "candidate")).isEmpty():
        raise ValueError("the forced candidate is not in the archive")
    if commits.exists(spark, out):
        raise ValueError(f"finalists are frozen already at {out}")
    roles = archive.with_roles(records, forced_id).select("candidate_id", F.split("roles", ",").alias("selection_roles"), "ord")
    summary = records.select("candidate_id", "operators", "accuracy_500", "accuracy_5000", "feature_dim", "runtime_ms", "ranking_score")
    frozen = roles.join(summary, "candidate_id").withColumns({"search_archive": F.lit(path), "search_archive_sha256": F.lit(checksum(spark, path)), "selected_at_utc": F.current_timestamp(), "test_set_accessed": F.lit(False)})
    place = commits.staged(out.rstrip("/").rpartition("/")[0])
    frozen.write.json(place)
    if not commits.publish(spark, place, out.rstrip("/")):
        raise ValueError(f"finalists are frozen already at {out}")
    return frozen_finalists(spark, out)


def frozen_finalists(spark: SparkSession, out: str) -> DataFrame:
    """Finalists in the order of their choice; a ValueError if their archive has changed since."""
    frozen = spark.read.json(out)
    for row in frozen.select("search_archive", "search_archive_sha256").distinct().collect():  # one
        if checksum(spark, row[0]) != row[1]:
            raise ValueError(f"{row[0]} has changed since its finalists were frozen")
    return frozen.orderBy("ord")


class FeatureCache:
    """Features as Parquet, by operators and by a key that the caller gives to the images."""

    def __init__(self, root: str):
        self._root = root.rstrip("/")

    def path(self, operators: Sequence[OperatorSpec], dataset_key: str) -> str:
        if not dataset_key.strip():
            raise ValueError("the key of a dataset must not be blank")
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return f"{self._root}/{digest(chr(10).join(o.to_json() for o in operators))}/{digest(dataset_key)}"

    def features(self, images: DataFrame, operators: Sequence[OperatorSpec], dataset_key: str) -> DataFrame:
        """(image_id, label, features), computed at the first call. Readers see whole features only: they are written
        aside and renamed; where two write at the same time, the first one's stay."""
        spark = images.sparkSession
        pipeline, path, read = FeaturePipeline(operators), self.path(operators, dataset_key), spark.read
        if not commits.exists(spark, path):
            place = commits.staged(self._root)
            pipeline.transform(images).select("image_id", "label", "features").write.parquet(place)
            commits.publish(spark, place, path)
        sound = (F.size("features") == pipeline.feature_dim) & ~F.exists("features", lambda x: x.isNull() | F.isnan(x))
        wrong = F.raise_error(F.lit("cached features aren't finite or not of the declared size"))
        return read.parquet(path).withColumn("features", F.when(sound, F.col("features")).otherwise(wrong))
