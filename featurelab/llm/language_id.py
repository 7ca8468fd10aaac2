"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines first choose the language family, others then separate the
languages within it. Features are hashed byte trigrams and bigrams of the whole lower-cased text, with all but
letters as spaces. The machines are fitted on at most ``per_language`` labelled rows of each language.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled rows all are;
null languages teach nothing; rows with equal ids are predicted each; an empty table gives an empty result;
further columns are ignored by the query and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import give_back, id_crc, materialize, released, text_slices

#: Buckets of hashed n-grams, and texts at once at most: their vectors take 16 MB.
BUCKETS, ROWS = 2048, 1024
#: Families of some languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, square roots of the shares of hashed n-grams), in slices of whole texts."""
    for at, data, offsets in text_slices(texts, rows=ROWS):
        rows = len(offsets) - 1
        b = _FOLD[data]
        if len(b):
            capital = np.zeros(len(b), dtype=bool)  # Latin-1 capitals, second byte
            capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            b[capital] += 32
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets)) * BUCKETS
        counts = np.zeros(rows * BUCKETS)
        if len(b) >= 3:
            w = b.astype(np.uint32)
            two = w[:-1] * np.uint32(0x9E3779B1) + w[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) + w[2:] * np.uint32(0x27D4EB2F)
            for h, n in ((two, 2), (three, 3)):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                bucket = (h >> np.uint32(21)).astype(np.int64)
                inside = (row[: len(h)] == row[n - 1 :]) & (w[: len(h)] + w[n - 1 :] != 64)
                counts += np.bincount((row[: len(h)] + bucket)[inside], minlength=len(counts))
        x = counts.reshape(rows, BUCKETS)
        yield at, np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


def training_rows(docs: DataFrame, per_language: int = 1200) -> DataFrame:
    """Labelled rows (lang, features): at most ``per_language`` of each, by hash of the id."""
    some = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = dict(some.groupBy("lang").count().collect())  # a row per language, of which the model holds pairs
    h = F.xxhash64(F.lit(3), "doc_id")
    below = [F.lit(x) for lang, n in counts.items() for x in (lang, -(-(2 * per_language << 20) // n))]
    # drawn in the scan: texts that don't teach are never shuffled
    near = some.filter(F.pmod(h, F.lit(1 << 20)) < F.element_at(F.create_map(*below), F.col("lang"))) if counts else some.limit(0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text")))
    near = near.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in features(batch.column(1)):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float32)), BUCKETS).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), lists], names=["lang", "x"])

    return near.mapInArrow(released(vectors), "lang string, x array<float>")


def _svm(rows: DataFrame, column: str, pair: tuple[str, str]) -> tuple[np.ndarray, float]:
    two = rows.filter(F.col(column).isin(*pair)).select((F.col(column) == pair[1]).cast("double").alias("label"), array_to_vector("x").alias("features"))
    m = LinearSVC(maxIter=12, regParam=1e-3, standardization=False).fit(two)
    return m.coefficients.toArray(), float(m.intercept)


def fit(docs: DataFrame, per_language: int = 1200) -> dict:
    """The hierarchy: families, their languages and a machine for each pair of families and of languages
    within a family. Weights are bounded by pairs times 2,048."""
    rows = training_rows(docs, per_language)
    name = F.col("lang")
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _FAMILY.items() for x in kv]), name), name)
    rows = materialize(rows.withColumn("family", family), "lang-train")
    known = sorted((r[0], r[1]) for r in rows.select("family", "lang").distinct().collect())
    by: dict[str, list[str]] = {}
    for f, lang in known:
        by.setdefault(f, []).append(lang)
    families = {p: _svm(rows, "family", p) for p in combinations(sorted(by), 2)}
    give_back(docs.sparkSession)  # each machine is many jobs
    languages = {p: _svm(rows, "lang", p) for f in by for p in combinations(by[f], 2)}
    give_back(docs.sparkSession)
    return {"by": by, "families": families, "languages": languages}


def _vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the winner by votes, then margins; mean probability of its duels) per row."""
    n = len(names)
    votes, margin, sure = np.zeros((len(x), n)), np.zeros((len(x), n)), np.zeros((len(x), n))
    if n == 1:
        return np.zeros(len(x), dtype=int), np.ones(len(x))
    for i, j in combinations(range(n), 2):
        w, b = machines[(names[i], names[j])]
        m = x @ w + b
        p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        votes[:, j] += m > 0
        votes[:, i] += m <= 0
        margin[:, j] += m
        margin[:, i] -= m
        sure[:, j] += p
        sure[:, i] += 1 - p
    best = np.argmax(votes + 1e-3 * np.tanh(margin), axis=1)
    return best, sure[np.arange(len(x)), best] / (n - 1)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_lang_score``; a text's language depends on the text alone."""
    by = model["by"]
    names = sorted(by)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, letters = batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(len(letters), "und", dtype=object), np.zeros(len(letters))
            for at, x in features(text) if by else ():
                family, sure = _vote(x, names, model["families"])
                for f in np.unique(family):
                    rows = np.flatnonzero(family == f)
                    best, inner = _vote(x[rows], by[names[f]], model["languages"])
                    pred[at + rows] = np.array(by[names[f]], dtype=object)[best]
                    score[at + rows] = sure[rows] * inner
            pred[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "_lang_pred", "_lang_score"])

    schema = StructType([*docs.schema.fields, StructField("_lang_pred", StringType()), StructField("_lang_score", DoubleType())])
    return docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(released(label), schema)


def predicted_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Predictions for all documents, learned from those outside fold 0 of crc32(doc_id)."""
    held_out = F.coalesce(id_crc(F.col("doc_id")) % folds == 0, F.lit(False))
    model = fit(docs.filter(~held_out))
    df = predict(docs.select("doc_id", "text"), model)
    return df.select("doc_id", held_out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def filter_documents(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents in a language that is known with a score of ``least``; their ``lang`` becomes what was
    found where it was null."""
    df = predict(docs, fit(docs))
    kept = df.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*docs.columns)
