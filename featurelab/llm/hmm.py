"""Hidden Markov language model.

Tokens are lower-cased words and an end. A token belongs to a class: the end and the most frequent words are
classes of their own, all other words go by a hash of their last three bytes. Latent states emit classes; within a
class a word has its smoothed training frequency. Baum-Welch expected counts are summed per task and then across
partitions over all training texts (cut into segments of ``segment`` tokens for training only); the scaled forward
recursion over whole texts gives their exact likelihood under the model.

Counts of the 65,536 most frequent words at most are broadcast; those of all others meet their documents by a
join on the word's hash, which so has no hot keys.

Defined cases: a null or empty text is the end token alone; a null id is a training document; repeated rows count
and are scored each; with no training text every word is unknown and the states are uniform; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, materialize, mix, text_slices, words_of

SUFFIXES, OWN = 256, 255
CLASSES = 1 + OWN + SUFFIXES
_SLICE = 2 << 20


def _suffix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class 0..255 of each word by its last three lower-cased bytes."""
    if not len(ends):
        return np.zeros(0, np.int64)
    low = data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    h = np.zeros(len(ends), dtype=np.uint64)
    for k in range(3):
        at = ends - 1 - k
        h = h * np.uint64(257) + np.where(at >= starts, low[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(h) % np.uint64(SUFFIXES)).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """Counts (word, suffix, n) of the hashed words of all ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), _SLICE):
                hashes, _, starts, ends = words_of(data, offsets)
                word, at, n = np.unique(hashes, return_index=True, return_counts=True)
                suffix = _suffix(data, starts[at], ends[at])
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(suffix.astype(np.int16)), pa.array(n.astype(np.int32))], names=["word", "suffix", "n"])

    counted = docs.select("text").mapInArrow(count, "word bigint, suffix smallint, n int")
    return counted.groupBy("word", "suffix").agg(F.sum("n").alias("n"))


def _sequences(docs: DataFrame, top: dict) -> DataFrame:
    """Per document its classes (int16), sums over words with known counts, and its other words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(2), _SLICE):
                rows = len(offsets) - 1
                hashes, first, starts, ends = words_of(data, offsets)
                owner = np.repeat(np.arange(rows), np.diff(first))
                cls = 1 + OWN + _suffix(data, starts, ends)
                logs = np.zeros(len(hashes))
                found = np.zeros(len(hashes), dtype=bool)
                if len(top["word"]) and len(hashes):
                    spot = np.minimum(np.searchsorted(top["word"], hashes), len(top["word"]) - 1)
                    found = top["word"][spot] == hashes
                    logs[found] = top["log"][spot[found]]
                    own = found & (top["own"][spot] > 0)
                    cls[own] = top["own"][spot[own]]
                single = cls <= OWN
                base = np.bincount(owner, weights=logs, minlength=rows)
                inner = np.bincount(owner, weights=np.where(single, 0.0, logs - top["class_log"][np.maximum(cls - 1 - OWN, 0)]), minlength=rows)
                known = np.bincount(owner[found], minlength=rows)
                full = np.zeros(len(cls) + rows, dtype=np.int16)  # the end is class 0
                full[np.arange(len(cls)) + owner] = cls
                edges = first + np.arange(rows + 1)
                order = np.lexsort((hashes[~found], owner[~found]))
                tail, tail_owner = hashes[~found][order], owner[~found][order]
                new = np.ones(len(tail), dtype=bool)
                new[1:] = (tail[1:] != tail[:-1]) | (tail_owner[1:] != tail_owner[:-1])
                cut = np.flatnonzero(new)
                times = np.diff(np.append(cut, len(tail))).astype(np.int32)
                per = np.searchsorted(tail_owner[cut], np.arange(rows + 1)).astype(np.int32)
                uid = serial + np.arange(rows)
                serial += rows
                raw = full.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array([raw[2 * a : 2 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())]
                    + [pa.array(np.diff(edges)), pa.array(base.astype(np.float64)), pa.array(inner.astype(np.float64)), pa.array(known.astype(np.int64))]
                    + [pa.ListArray.from_arrays(pa.array(per), pa.array(tail[cut].view(np.int64))), pa.ListArray.from_arrays(pa.array(per), pa.array(times))],
                    names=["uid", "doc_id", "held_out", "classes", "n_tokens", "base", "inner", "known", "words", "times"],
                )

    schema = "uid bigint, doc_id bigint, held_out boolean, classes binary, n_tokens bigint, base double, inner double, known bigint, words array<bigint>, times array<int>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, schema)


def _groups(sequences: list[np.ndarray], cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(classes by step and sequence, lengths, numbers) of sequences of like length, longest first."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    i = 0
    while i < len(order):
        steps = len(sequences[order[i]])
        part = order[i : i + max(1, cells // max(steps, 1))]
        i += len(part)
        lengths = np.array([len(sequences[k]) for k in part])
        grid = np.zeros((steps, len(part)), dtype=np.int64)
        for j, k in enumerate(part):
            grid[: lengths[j], j] = sequences[k]
        yield grid, lengths, part


def forward(grid: np.ndarray, lengths: np.ndarray, model: dict, keep: bool = False):
    """Scaled forward recursion: natural log-likelihood of each sequence (and the states and scales, if kept)."""
    start, move, emit = model["start"], model["move"], model["emit"].T.copy()
    steps, n = grid.shape
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t, longest first
    total = np.zeros(n)
    alpha = np.zeros((steps, n, len(start))) if keep else None
    scales = np.ones((steps, n)) if keep else None
    a = start * emit[grid[0]]
    for t in range(steps):
        m = active[t]
        if t:
            a = (a[:m] @ move) * emit[grid[t, :m]]
        s = a.sum(axis=1)
        a /= s[:, None]
        total[:m] += np.log(s)
        if keep:
            alpha[t, :m], scales[t, :m] = a, s
    return (total, alpha, scales, active) if keep else total


def expected_counts(sequences: list[np.ndarray], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expected counts of starts, moves and emissions."""
    k = len(model["start"])
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
    out = model["emit"].T.copy()
    for grid, lengths, _ in _groups(sequences):
        _, alpha, scales, active = forward(grid, lengths, model, keep=True)
        steps, n = grid.shape
        beta = np.zeros((steps, n, k))
        ahead = np.zeros((steps, n, k))  # emission times beta over scale, of the step after
        for t in range(steps - 1, -1, -1):
            m = active[t]
            beta[t, :m] = 1.0
            if t + 1 < steps and (longer := active[t + 1]):
                beta[t, :longer] = ahead[t + 1, :longer] @ model["move"].T
            ahead[t, :m] = beta[t, :m] * out[grid[t, :m]] / scales[t, :m, None]
        gamma = alpha * beta
        start += gamma[0].sum(axis=0)
        if steps > 1:
            move += alpha[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k) * model["move"]
        flat = grid.ravel()
        for s in range(k):
            emit[s] += np.bincount(flat, weights=gamma[:, :, s].ravel(), minlength=CLASSES)
    return start, move, emit


def _initial(states: int, shares: np.ndarray, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    emit = shares * np.exp(rng.normal(0, 0.5, (states, CLASSES)))
    move = rng.dirichlet(np.full(states, 5.0), states)
    return {"start": np.full(states, 1 / states), "move": move, "emit": emit / emit.sum(axis=1, keepdims=True)}


def baum_welch(sequences: DataFrame, shares: np.ndarray, states: int, iterations: int, segment: int, seed: int = 11) -> dict:
    """States trained on ``sequences`` (classes). Each task sums its expected counts; they are added by cell
    across tasks, so the driver gets states * (states + classes + 1) numbers."""
    model = _initial(states, shares, seed)
    for _ in range(iterations):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total, begin, later, held = np.zeros(states * (1 + states + CLASSES)), [], [], 0
            inside = model | {"start": np.linalg.matrix_power(model["move"], 64).mean(axis=0)}  # a segment within a text

            def add() -> None:
                nonlocal total
                counts, rest = expected_counts(begin, model), expected_counts(later, inside)
                total = total + np.concatenate([x.ravel() for x in (counts[0], counts[1] + rest[1], counts[2] + rest[2])])
                begin.clear()
                later.clear()

            for batch in batches:
                for raw in batch.column(0):
                    x = np.frombuffer(raw.as_buffer(), dtype=np.int16)
                    for a in range(0, len(x), segment):
                        (later if a else begin).append(x[a : a + segment])  # only a text's beginning tells of starts
                        held += min(segment, len(x) - a)
                    if held > 1_000_000:
                        add()
                        held = 0
            if begin or later:
                add()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "v"])

        sums = sequences.select("classes").mapInArrow(expect, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(states * (1 + states + CLASSES))
        for cell, v in sums:
            total[cell] = v
        start, move, emit = np.split(total, [states, states * (1 + states)])
        smooth = [start + 1.0, move.reshape(states, states) + 1.0, emit.reshape(states, CLASSES) + 0.5 * shares * CLASSES]
        model = dict(zip(("start", "move", "emit"), [x / x.sum(axis=-1, keepdims=True) for x in smooth]))
    return model


def score_texts(docs: DataFrame, states: int = 6, iterations: int = 3, segment: int = 512, most: int = 65_536) -> DataFrame:
    """``docs`` (doc_id, text, held_out) scored by a model of those that aren't held out: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score and score, in log10."""
    train = docs.filter(~F.col("held_out"))
    ends = train.count()
    counts = materialize(count_words(train), "lm-counts")
    words, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = (words or 0) + ends, kinds + (ends > 0)
    best = counts.orderBy(F.desc("n"), "word").limit(most).select("word", "suffix", "n").toArrow()  # bounded
    word = np.asarray(best.column("word")).view(np.uint64) if len(best) else np.zeros(0, np.uint64)
    n, suffix = np.asarray(best.column("n"), dtype=np.float64), np.asarray(best.column("suffix"), dtype=np.int64)
    own = np.where(np.arange(len(word)) < OWN, np.arange(len(word)) + 1, 0)
    mass, distinct = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for s, m, d in counts.groupBy("suffix").agg(F.sum("n"), F.count("*")).collect():  # 256 rows
        mass[s], distinct[s] = m, d
    np.subtract.at(mass, suffix[own > 0], n[own > 0])
    np.subtract.at(distinct, suffix[own > 0], 1)
    order = np.argsort(word)
    top = {"word": word[order], "log": np.log10(n[order] + 1), "own": own[order], "class_log": np.log10(mass + distinct + 1)}
    shares = np.concatenate([[ends], np.zeros(OWN), mass]) + 0.5
    shares[1 : 1 + min(OWN, len(word))] += n[:OWN]
    shares /= shares.sum()

    rows = materialize(_sequences(docs, top), "lm-sequences")
    model = baum_welch(rows.filter(~F.col("held_out")), shares, states, iterations, segment)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(x.as_buffer(), dtype=np.int16) for x in batch.column(3)]
            log = np.zeros(len(sequences))
            for grid, lengths, numbers in _groups(sequences):
                log[numbers] = forward(grid, lengths, model) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[4:], pa.array(log)], names=["uid", "doc_id", "held_out", "n_tokens", "base", "inner", "known", "log"])

    scored = rows.select("uid", "doc_id", "held_out", "classes", "n_tokens", "base", "inner", "known").mapInArrow(likelihood, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, base double, inner double, known bigint, log double")
    other = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    other = other.join(counts.select("word", "n"), "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("met"))
    df = scored.join(other, "uid", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "met": F.coalesce("met", F.lit(0))})
    end = float(np.log10(ends + 1))
    return df.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("met") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") + F.lit(end) - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        (F.col("log") + F.col("inner") + F.col("more")).alias("score"),
    )


def held_out(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(id_crc(F.col("doc_id")) % folds == fold, F.lit(False)).alias("held_out"))
