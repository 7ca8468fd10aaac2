"""Quality classifier by co-training.

Two views of a document, its text (hashed words and pairs of words, byte classes and word figures) and its metadata
(source, language, length), each have a logistic classifier. Over rounds every document is scored by both views, and
each view labels documents for the other: those at its upper and at its lower end, each as wide as it may be for the view
to be right about enough of the labelled rows there. A round from which no view learns anything is the last. At the end both views' margins are calibrated on labelled
documents that no classifier was fitted on, and combined; every document is scored.

Texts are read where they are stored and never shuffled: a pass leaves two margins of a document, and only the rows
that a classifier is fitted on, a bounded number, keep their features.

Defined cases: a null or empty text has figures of 0; null source and language are values of their own; documents
without a label are only scored; if the labelled rows to fit on are of one class or none, every score is the mean of
the labels (0.5 if there are none); if those to calibrate on are, calibration takes the ones fitted on; a document with
several labels has their majority; repeated rows are scored alike; null ids have no label; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, id_crc, materialize, mix, text_slices, words_of

#: Byte classes: each letter and each sign of its own, capitals, digits, control and non-ASCII bytes together.
_CLASS = np.full(256, 0, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 3
_CLASS[97:123] = np.arange(4, 30)
_SIGNS = np.frombuffer(b" \n\t!\"#$%&'()*+,-./:;<=>?@[]^_{|}~", dtype=np.uint8)
_CLASS[_SIGNS] = np.arange(30, 30 + len(_SIGNS))
CLASSES = 30 + len(_SIGNS)
#: Cells of hashed words and pairs (a power of two), texts at once at most, sources and languages with a place of their
#: own (the most frequent of the labelled rows; all others share one), steps of the length.
CELLS, ROWS, SOURCES, LANGUAGES, LENGTHS = 1024, 1024, 255, 63, 24
VIEWS = ("text", "meta")


def text_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) in slices of whole texts."""
    for at, data, offsets in text_slices(texts, rows=ROWS):
        rows = len(offsets) - 1
        size = np.diff(offsets)
        row = np.repeat(np.arange(rows), size)
        shares = np.bincount(row * CLASSES + _CLASS[data], minlength=rows * CLASSES).reshape(rows, CLASSES) / np.maximum(size, 1)[:, None]
        hashes, first, starts, ends = words_of(data, offsets)
        n = np.diff(first)
        owner = np.repeat(np.arange(rows), n)
        cells = np.bincount(owner * CELLS + (hashes % np.uint64(CELLS)).astype(np.int64), minlength=rows * CELLS).astype(float)
        twice = np.zeros(rows)
        if len(hashes) > 1:
            inside = owner[1:] == owner[:-1]
            pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) % np.uint64(CELLS)
            cells += np.bincount((owner[1:] * CELLS + pairs.astype(np.int64))[inside], minlength=rows * CELLS)
            twice = np.bincount(owner[1:][inside & (hashes[1:] == hashes[:-1])], minlength=rows)
        cells = cells.reshape(rows, CELLS)
        order = np.lexsort((hashes, owner))
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        kinds = np.bincount(owner[order][fresh], minlength=rows)
        length = np.bincount(owner, weights=ends - starts, minlength=rows)
        per = np.maximum(n, 1)
        more = np.stack([np.log1p(n), length / per / 10, kinds / per, twice / per, (n < 50).astype(float)], axis=1)
        yield at, np.concatenate([np.sqrt(cells / np.maximum(cells.sum(axis=1, keepdims=True), 1)), np.sqrt(shares), more], axis=1)


def metadata_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array, known: dict) -> np.ndarray:
    """A place for each known source and language, one for all others, and the length by steps of a factor of two."""
    out = np.zeros((len(source), SOURCES + LANGUAGES + 2 + LENGTHS))
    rows = np.arange(len(source))
    for values, places, low, most in ((source, known["source"], 0, SOURCES), (lang, known["lang"], SOURCES + 1, LANGUAGES)):
        out[rows, low + np.array([places.get(x, most) for x in values.to_pylist()], dtype=np.int64)] = 1
    chars = np.maximum(np.array(n_chars.fill_null(0).to_pylist(), dtype=float), 0)
    out[rows, SOURCES + LANGUAGES + 2 + np.minimum(np.log2(chars + 1).astype(int), LENGTHS - 1)] = 1
    return out


_COLUMNS = ("text", "source", "lang", "n_chars")


def _features(docs: DataFrame, keep: str, known: dict) -> DataFrame:
    """``docs`` with the columns of ``keep`` (a schema) and both views' features ``text_x`` and ``meta_x``."""
    names = [c.split()[0] for c in keep.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, source, lang, n_chars = batch.columns[len(names) :]
            for at, x in text_features(text):
                rows = len(x)
                y = metadata_features(source.slice(at, rows), lang.slice(at, rows), n_chars.slice(at, rows), known)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * v.shape[1], pa.int32()), pa.array(v.ravel().astype(np.float32))) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, rows) for c in batch.columns[: len(names)]], *lists], names=[*names, "text_x", "meta_x"])

    return docs.select(*names, *_COLUMNS).mapInArrow(read, f"{keep}, text_x array<float>, meta_x array<float>")


@dataclass
class Model:
    """Weights and intercept by view, places of known sources and languages, calibration by score, and by round and
    teaching view the numbers of bad and good documents that it labelled for the other view."""

    known: dict
    weights: dict
    calibration: dict = field(default_factory=dict)
    taught: list = field(default_factory=list)


def margins(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_m, meta_m) of every document."""
    weights, known = model.weights, model.known

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, text, source, lang, n_chars = batch.columns
            (w, b), (v, c) = weights["text"], weights["meta"]
            one, two = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, x in text_features(text):
                one[at : at + len(x)] = x @ w + b
                two[at : at + len(x)] = metadata_features(source.slice(at, len(x)), lang.slice(at, len(x)), n_chars.slice(at, len(x)), known) @ v + c
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one), pa.array(two)], names=["doc_id", "text_m", "meta_m"])

    return docs.select("doc_id", *_COLUMNS).mapInArrow(read, "doc_id bigint, text_m double, meta_m double")


def _margin(weights: tuple, column: str) -> Column:
    w, b = weights
    terms = F.zip_with(F.col(column), F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x * y)
    return F.aggregate(terms, F.lit(float(b)), lambda s, x: s + x)


def _fit(rows: DataFrame, column: str) -> tuple[np.ndarray, float]:
    some = rows.select("label", array_to_vector(column).alias("features"))
    m = LogisticRegression(maxIter=15, regParam=1e-3, standardization=False).fit(some)
    return m.coefficients.toArray(), float(m.intercept)


def _draw(column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(1 << 20))


def _up_to(rows: int, of: int) -> int:
    """Bound of :func:`_draw` that lets about ``rows`` of ``of`` through."""
    return int(min(1.0, rows / max(1, of)) * (1 << 20)) + (rows > 0)


def _ends(both: DataFrame, own: DataFrame, weights: dict, prior: float, share: float, sure: float) -> dict[tuple[str, int], float]:
    """By view and end (0 the lower, 1 the upper) the margin up to which, or from which, the view is sure: the widest of
    ``share``, a half, a quarter, ... a 32nd of it of the documents, in the labelled proportion, with five labelled rows or
    more that the view is right about ``sure`` of. Ends that have none are left out."""
    shares = [share / 2**k for k in range(6)]
    at = [s * (1 - prior) for s in shares] + [1 - s * prior for s in shares]
    cuts = both.agg(*[F.percentile_approx(f"{v}_m", at, 10_000).alias(v) for v in VIEWS]).first()
    fitted = own.select("label", *[_margin(weights[v], f"{v}_x").alias(f"{v}_m") for v in VIEWS])
    tried = {}
    for v in VIEWS:
        for k, (low, high) in enumerate(zip(cuts[v][:6], cuts[v][6:]) if cuts[v] else ()):
            if low < high:
                tried |= {(v, 0, k): (F.col(f"{v}_m") <= low, low), (v, 1, k): (F.col(f"{v}_m") >= high, high)}
    if not tried:
        return {}
    hits = fitted.agg(*[f(F.when(inside, right)).alias(f"{v}{end}{k}{name}") for (v, end, k), (inside, _) in tried.items() for right in [F.abs(F.col("label") - 1 + end)] for name, f in (("n", F.count), ("r", F.avg))]).first()
    found: dict[tuple[str, int], float] = {}
    for (v, end, k), (_, cut) in tried.items():  # the widest first
        if (v, end) not in found and hits[f"{v}{end}{k}n"] >= 5 and hits[f"{v}{end}{k}r"] >= sure:
            found[v, end] = cut
    return found


def _teach(docs: DataFrame, own: DataFrame, ids: DataFrame, model: Model, prior: float, share: float, sure: float, fit_rows: int, learnt: set[str]) -> DataFrame | None:
    """Documents that a view labels for the other, as rows of features with ``text_label`` and ``meta_label`` (null where
    the other view says nothing); None if no view that has changed (``learnt``) labels any. Adds the counts to the model."""
    both = materialize(margins(docs, model).join(F.broadcast(ids), "doc_id", "left_anti").filter("doc_id is not null"), "cotrain-margins")
    cuts = _ends(both, own, model.weights, prior, share, sure)
    counts, labels = {v: (0, 0) for v in VIEWS}, {}
    inside = {(v, end): F.col(f"{v}_m") >= cut if end else F.col(f"{v}_m") <= cut for (v, end), cut in cuts.items()}
    if inside:
        found = both.agg(*[F.sum(c.cast("long")).alias(f"{v}{end}") for (v, end), c in inside.items()]).first()
        for v in VIEWS:
            n = {end: found[f"{v}{end}"] or 0 for end in (0, 1) if (v, end) in inside}
            # as many of both classes as there are in the labelled proportion where both ends teach, fit_rows at most
            most = min([fit_rows, *(m / (prior if end else 1 - prior) for end, m in n.items())]) if n else 0
            take = {end: round(most * (prior if end else 1 - prior)) for end in n}
            if any(take.values()):
                counts[v] = take.get(0, 0), take.get(1, 0)
                labels[v] = F.coalesce(*[F.when(inside[v, end] & (_draw() < _up_to(take[end], n[end])), float(end)) for end in take if take[end]])
    model.taught.append(counts)
    if not set(labels) & learnt:
        return None
    none = F.lit(None).cast("double")
    chosen = both.select("doc_id", labels.get("meta", none).alias("text_label"), labels.get("text", none).alias("meta_label")).filter("text_label is not null or meta_label is not null")
    chosen = materialize(chosen.dropDuplicates(["doc_id"]), "cotrain-chosen")  # 2 x fit_rows or so
    rows = docs.join(F.broadcast(chosen), "doc_id")
    return materialize(_features(rows, "doc_id bigint, text_label double, meta_label double", model.known), "cotrain-taught")


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = 2, share: float = 0.2, sure: float = 0.9, fit_rows: int = 8_000) -> Model | float:
    """The calibrated model, or the mean label where there is nothing to fit on. A classifier is fitted on at most about
    ``fit_rows`` labelled rows and as many that the other view labelled, drawn by hash of the id. A view labels the
    documents at an end of it, ``share`` of them or fewer, where it is right about ``sure`` of the labelled ones."""
    votes = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    votes, seen = counted(votes, "cotrain-labels", n=F.count("*"))
    ids = votes.filter(_draw() < _up_to(fit_rows, seen["n"]))
    calibrating = id_crc(F.col("doc_id")) % 5 == 0
    some = docs.select("doc_id", *_COLUMNS).join(F.broadcast(ids), "doc_id").withColumn("calibrating", calibrating)
    kinds = {(r.calibrating, r.label): r["count"] for r in some.groupBy("calibrating", "label").count().collect()}  # 4 at most
    total = sum(kinds.values())
    fold = {side: [kinds.get((side, x), 0) for x in (0.0, 1.0)] for side in (False, True)}
    if not min(fold[False]):
        return (kinds.get((False, 1.0), 0) + kinds.get((True, 1.0), 0)) / total if total else 0.5
    known = {}
    for c, most in (("source", SOURCES), ("lang", LANGUAGES)):
        often = some.groupBy(c).count().orderBy(F.desc("count"), F.col(c).asc_nulls_first()).limit(most).collect()
        known[c] = {r[0]: k for k, r in enumerate(often)}
    rows = materialize(_features(some, "doc_id bigint, label double, calibrating boolean", known), "cotrain-labelled")
    own, held = rows.filter("not calibrating"), rows.filter("calibrating" if min(fold[True]) else "not calibrating")
    prior = fold[False][1] / sum(fold[False])
    model = Model(known, {v: _fit(own, f"{v}_x") for v in VIEWS})
    learnt = set(VIEWS)
    for _ in range(rounds):
        more = _teach(docs, own, ids.select("doc_id"), model, prior, share, sure, fit_rows, learnt)
        if more is None:
            break
        learnt = {v for v, n in zip(VIEWS, reversed(model.taught[-1].values())) if sum(n)}  # what the other view taught
        for v in learnt:
            extra = more.filter(f"{v}_label is not null").select(F.col(f"{v}_label").alias("label"), f"{v}_x")
            model.weights[v] = _fit(own.select("label", f"{v}_x").unionByName(extra), f"{v}_x")
    held = held.select("label", *[_margin(model.weights[v], f"{v}_x").alias(f"{v}_m") for v in VIEWS])
    held = materialize(held.select("label", F.array("text_m", "meta_m").alias("both"), F.array("text_m").alias("text"), F.array("meta_m").alias("meta")), "cotrain-held")
    model.calibration = {name: _fit(held, name) for name in ("both", *VIEWS)}
    return model


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of all documents: doc_id, score, text_score, metadata_score, predicted. ``options`` go to :func:`co_train`."""
    model = co_train(docs, labels, **options)
    if isinstance(model, float):
        mean = F.lit(model)
        return docs.select("doc_id", mean.alias("score"), mean.alias("text_score"), mean.alias("metadata_score"), (mean >= 0.5).cast("int").alias("predicted"))
    m = {"both": ("text_m", "meta_m"), "text": ("text_m",), "meta": ("meta_m",)}
    p = {name: 1 / (1 + F.exp(-sum((float(w) * F.col(c) for w, c in zip(model.calibration[name][0], of)), F.lit(model.calibration[name][1])))) for name, of in m.items()}
    out = margins(docs, model)
    return out.select("doc_id", p["both"].alias("score"), p["text"].alias("text_score"), p["meta"].alias("metadata_score"), (p["both"] >= 0.5).cast("int").alias("predicted"))
