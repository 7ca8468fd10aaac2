"""Best-fit packing by bin completion.

Documents become token ids and pieces of at most ``capacity`` tokens. Only lengths matter to the packing, so the
pieces are counted by length (at most ``capacity`` rows); bin completion over those counts gives patterns of
lengths with multiplicities; each piece then finds its slot by its rank among pieces of its length.

Bin completion: the largest length left is completed by all fillings that no other filling dominates, fullest first.
The best of several best-fit packings is the incumbent; if it needs more bins than the waste bound allows, the
``tail`` least filled bins are searched again by branch and bound at any size of input, pruning a branch when its waste
exceeds what the bound leaves; then mixtures of least filled and full bins are. ``nodes`` bounds that search; when it ends, the incumbent stands, which is always a
whole packing.

Defined cases: a null or empty text is one piece, the end token alone; repeated rows are packed each; an empty
table gives an empty result; further columns are ignored by the query.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released

END = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The pattern of byte-level BPE begins a new pre-token at every space before a non-space, so texts without
    double spaces are encoded word by word through a dictionary of words already seen (dropped when large); new
    words go to the same vocabulary as ranks (``ranks``), if that is given. Other texts, and those with the
    special token's string, go to the tokenizer whole."""

    def __init__(self, path: str, ranks: str | None = None, special: str = "<|endoftext|>", remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer, self._special, self._most = Tokenizer.from_file(path), special, remember
        self._seen: dict[str, bytes] = {}
        self._word = lambda w: self._tokenizer.encode(w, add_special_tokens=False).ids
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._word = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if "  " in text or self._special in text:
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        seen, out = self._seen, []
        if len(seen) > self._most:
            seen.clear()
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [w if k == 0 else " " + w for k, w in enumerate(text.split(" "))]
        for w in words:
            ids = seen.get(w)
            out.append(self._new(w) if ids is None else ids)
        return b"".join(out)

    def _new(self, w: str) -> bytes:
        """A word not seen before. A single line end between others and a mark after a letter are pre-tokens of
        their own, so what stands before them may have been seen."""
        a, line, b = w.partition("\n")
        if line and a and b and not a[-1].isspace() and not b[0].isspace():
            parts = (a, "\n", b)
        elif len(w) > 2 and w[-1] in ".,;:!?" and w[-2].isalpha():
            parts = (w[:-1], w[-1])
        else:
            ids = self._seen[w] = array("I", self._word(w)).tobytes()
            return ids
        ids = self._seen[w] = b"".join([self._seen.get(x) or self._new(x) for x in parts])
        return ids


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, ranks: str | None = None, remember: int = 600_000) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document. A document longer than ``capacity`` is
    cut into full pieces, the first of which may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer, ranks, remember=remember), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                at = n % capacity or capacity
                edges = [0, *range(at, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(released(cut), PIECES)


def _completions(counts: np.ndarray, room: int, most: int = 24, per_part: float = 0) -> list[tuple[int, ...]]:
    """Good fillings of ``room`` from the lengths that are left, for packings to begin with: fullest first (each part
    counting as ``per_part`` tokens of waste, which saves small lengths for later), at most ``most``. Not all: for
    each first length the fullest pair, with more lengths while some fit. The search has ``_fillings``."""
    found: dict[tuple[int, ...], int] = {(): 0}
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    largest = int(have[-1])
    found[(largest,)] = largest
    if largest < room:
        left = np.zeros(room + 1, dtype=np.int64)  # the largest length available up to each size
        left[have] = have
        np.maximum.accumulate(left, out=left)
        second = left[room - have]
        # the same length twice needs two of it
        twice = (second == have) & (counts[have] < 2)
        second = np.where(twice, left[np.maximum(second - 1, 0)], second)
        order = np.argsort(per_part * (1 + (second > 0)) - (have + second), kind="stable")[:most]
        for a, b in zip(have[order].tolist(), second[order].tolist()):
            key = tuple(sorted((a, b) if b else (a,), reverse=True))
            found[key] = sum(key)
        for key in [k for k in found if len(k) == 2 and sum(k) < room]:
            rest = counts.copy()
            for x in key:
                rest[x] -= 1
            while (space := room - sum(key)) > 0 and len(fits := np.flatnonzero(rest[: space + 1])):
                key += (int(fits[-1]),)
                rest[key[-1]] -= 1
            found[tuple(sorted(key, reverse=True))] = sum(key)
    ranked = sorted(found, key=lambda k: (per_part * len(k) - found[k], len(k), [-x for x in k]))
    return ranked[:most]


def _up_to(sums: int, more: int) -> int:
    """The sizes (bits) that are up to ``more`` larger than those of ``sums``."""
    width = 1
    while width <= more:
        step = min(width, more + 1 - width)
        sums |= sums << step
        width += step
    return sums


def _fillings(counts: np.ndarray, room: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` from the lengths that are left, of any number of parts, fullest first and
    then those of larger parts first. A filling is dominated if two or more of its parts could be exchanged for one
    length left out of the same sum or more, or one part (or none) for a larger one. Sets of sizes are bits of a
    number: ``sums[i]`` are the sums that the smallest i lengths make, so that no branch ends without a filling.
    Only ``budget``, from which every part tried takes one, cuts the list."""
    have, sums = np.flatnonzero(counts[: room + 1]).tolist(), [1]
    for x in have:
        reached, left, step = sums[-1], min(int(counts[x]), room // x), 1
        while left:
            step = min(step, left)
            reached |= reached << (x * step)
            left, step = left - step, 2 * step
        sums.append(reached & ((1 << (room + 1)) - 1))

    def parts(i: int, need: int, slack: int, taken: tuple[int, ...], one: int, more: int, out: int) -> Iterator[tuple[int, ...]]:
        """``one`` and ``more``: sums of one and of several parts of ``taken``; ``out``: lengths left out so far."""
        if not need:
            out |= sum(1 << x for x in have[:i])
            if not (_up_to(more, slack) | (_up_to(one | 1, slack - 1) << 1 if slack else 0)) & out:
                yield taken
            return
        for at in range(i, 0, -1):
            x = have[at - 1]
            if not sums[at] >> need & 1:
                return
            with_x, most = [(taken, one, more)], min(int(counts[x]), need // x)
            for _ in range(most):
                t, a, b = with_x[-1]
                with_x.append(((*t, x), a | 1 << x, b | b << x | a << x))
            for k in range(most, 0, -1):
                if budget[0] <= 0:
                    return
                if sums[at - 1] >> (need - k * x) & 1:
                    budget[0] -= 1
                    t, a, b = with_x[k]
                    left_out = out | (1 << x if k < counts[x] else 0)
                    if not _up_to(b, slack) & left_out:
                        yield from parts(at - 1, need - k * x, slack, t, a, b, left_out)
            out |= 1 << x

    for target in range(room, -1, -1):
        if sums[-1] >> target & 1:
            yield from parts(len(have), target, room - target, (), 0, 0, 0)


def _even_filling(counts: np.ndarray, room: int) -> tuple[int, ...]:
    """A filling without waste of the fewest parts (up to three), as equal as can be, which keeps small lengths for
    later; where there is none, the first of all fillings."""
    if room and counts[room]:
        return (room,)
    for least in (0, *range(room // 3, 0, -1)):  # the smallest of three parts, 0 for two parts
        if least and not counts[least]:
            continue
        small = np.arange((room - least) // 2, max(least, 1) - 1, -1)
        large = room - least - small
        fits = (counts[small] > (small == least)) & (counts[large] > (large == least).astype(int) + (large == small))
        if len(found := np.flatnonzero(fits)):
            return tuple(sorted((int(large[found[0]]), int(small[found[0]]), *([least] if least else [])), reverse=True))
    return next(_fillings(counts, room, [1 << 30]))  # the first filling is reached without a wrong turn


def _fits(counts: np.ndarray, items: tuple[int, ...]) -> int:
    lengths, uses = np.unique(np.array(items), return_counts=True)
    return int((counts[lengths] // uses).min())


def _completed(counts: np.ndarray, capacity: int, per_part: float | None) -> list[tuple[int, tuple[int, ...]]]:
    """Every largest length completed by its best filling (the even one without ``per_part``), as often as the counts
    allow."""
    counts, bins = counts.copy(), []
    while len(have := np.flatnonzero(counts)):
        top = int(have[-1])
        counts[top] -= 1
        filling = _even_filling(counts, capacity - top) if per_part is None else _completions(counts, capacity - top, 8, per_part)[0]
        counts[top] += 1
        items = (top, *filling)
        times = _fits(counts, items)
        for x in items:
            counts[x] -= times
        bins.append((times, items))
    return bins


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: equal bins are kept as one with its number."""
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {capacity: [(int(counts.sum()), ())]}
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        while left:
            room = min(r for r in bins if r >= x)
            times, items = bins[room].pop()
            used = min(times, left)
            if used < times:
                bins[room].append((times - used, items))
            if not bins[room]:
                del bins[room]
            bins.setdefault(room - x, []).append((used, (*items, x)))
            left -= used
    return [b for r, group in bins.items() if r < capacity for b in group]


def _incumbent(counts: np.ndarray, capacity: int, least: int) -> list[tuple[int, tuple[int, ...]]]:
    """The best of best-fit decreasing, of even completions and of those that save small lengths less and less."""
    best = _best_fit(counts, capacity)
    for per_part in (None, 256, 128, 64, 32, 16, 8, 4, 2, 0):
        if sum(t for t, _ in best) <= least:
            break
        best = min(best, _completed(counts, capacity, per_part and per_part * capacity / 1024), key=lambda b: sum(t for t, _ in b))
    return best


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: for each size ``a``, pieces that leave less than ``a`` stand alone, and what is between
    ``a`` and half a bin has to fit beside the larger ones (Martello and Toth)."""
    lengths = np.arange(len(counts))
    n, size = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    half = capacity // 2
    best = 0
    for a in range(half + 1):
        large = n[-1] - n[half + 1]
        alone = n[-1] - n[capacity - a + 1]
        beside = (large - alone) * capacity - (size[capacity - a + 1] - size[half + 1])
        small = size[half + 1] - size[a]
        best = max(best, int(large + max(0, -(-(small - beside) // capacity))))
    return best


def _search(bins: list[tuple[int, tuple[int, ...]]], capacity: int, budget: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """Fewer bins for the lengths of ``bins`` by branch and bound, or ``bins`` themselves. The stack holds a node per
    bin of the branch; ``budget`` is the number of nodes left, each of which stands for 25 parts tried."""
    tries = [25 * budget[0]]
    left = np.zeros(capacity + 1, dtype=np.int64)
    for times, items in bins:
        np.add.at(left, list(items), times)
    size, most, goal = int((left * np.arange(capacity + 1)).sum()), sum(t for t, _ in bins), least_bins(left, capacity)

    def node(left: np.ndarray, waste: int) -> tuple[np.ndarray, int, Iterator[tuple[int, ...]]]:
        budget[0] -= 1
        top = int(np.flatnonzero(left)[-1])
        once = left.copy()
        once[top] -= 1
        return left, waste, ((top, *filling) for filling in _fillings(once, capacity - top, tries))

    stack, taken = [node(left, 0)] if left.any() else [], []
    while stack and most > goal and budget[0] > 0:
        left, waste, options = stack[-1]
        items = next(options, None)
        if tries[0] <= 0:  # the list may have been cut
            break
        if items is not None:
            waste += capacity - sum(items)
        if items is None or waste > (most - 1) * capacity - size:  # more waste than one bin fewer leaves, as all later ones
            stack.pop()
            del taken[len(stack) - 1 :]
            continue
        once = left.copy()
        np.subtract.at(once, list(items), 1)
        if once.any():
            taken.append((1, items))
            stack.append(node(once, waste))
        else:
            bins, most = [*taken, (1, items)], len(taken) + 1
    return bins


def _tail(bins: list[tuple[int, tuple[int, ...]]], tail: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``tail`` least filled bins, of equally filled ones those of most parts."""
    last = []
    for times, items in sorted(bins, key=lambda b: (sum(b[1]), -len(b[1]))):
        last.append((min(times, tail), items))
        tail -= last[-1][0]
        if not tail:
            break
    return last


def _mixed(bins: list[tuple[int, tuple[int, ...]]], capacity: int, tail: int, rng: np.random.Generator) -> list[tuple[int, tuple[int, ...]]]:
    """The least filled bins and as many full ones drawn from those of three and more parts, whose small lengths can
    fill the others."""
    last = _tail([b for b in bins if sum(b[1]) < capacity], tail // 2)
    full = [b for b in bins if sum(b[1]) == capacity and len(b[1]) > 2]
    if full:
        times = np.array([t for t, _ in full])
        drawn = rng.multivariate_hypergeometric(times, min(tail - tail // 2, int(times.sum())), method="marginals")
        last += [(int(t), items) for t, (_, items) in zip(drawn, full) if t]
    return last


def pack_lengths(counts: np.ndarray, capacity: int, nodes: int = 4000, tail: int = 150) -> list[tuple[int, tuple[int, ...]]]:
    """Bins (times, lengths) for ``counts[length]`` pieces of each length."""
    least = least_bins(counts, capacity)
    bins = _incumbent(counts, capacity, least)
    left, rng, mixed = nodes, np.random.default_rng(0), False
    # branch and bound over the least filled bins, while it saves some; then over mixtures with full bins
    while (total := sum(t for t, _ in bins)) > least and left > 0:
        last = _mixed(bins, capacity, tail, rng) if mixed else _tail(bins, tail)
        budget = [left if total <= tail else min(left, nodes // 16) if mixed else max(1, left // 2)]
        left -= budget[0]
        found = _search(last, capacity, budget)
        left += max(0, budget[0]) - 1
        if found is not last:
            times = Counter()
            for sign, some in ((1, bins), (-1, last), (1, found)):
                for t, items in some:
                    times[items] += sign * t
            bins = [(t, items) for items, t in times.items() if t]
        elif total <= tail:
            break
        else:
            mixed = True
    return bins


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset. Ranks within a length go per salt, with the
    counts of earlier salts added, so that a frequent length is many tasks."""
    spark = pieces.sparkSession
    salts = max(8, pieces.count() // 20_000)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counted = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "pack-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("_n")).collect():  # at most one row per length
        counts[length] = n
    ranges, sequence, next_rank = [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for times, items in pack_lengths(counts, capacity):
        offset = 0
        for x in items:
            ranges.append((int(x), int(next_rank[x]), int(next_rank[x] + times), sequence, offset))
            next_rank[x] += times
            offset += x
        sequence += times
    slots = spark.createDataFrame(ranges, "length bigint, low bigint, high bigint, first_sequence bigint, offset bigint")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_own", own - 1).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    # ranges meet ranks in cells of equal size, so that a frequent length is not all of its pieces by all of its ranges
    cell = 12
    cells = slots.withColumn("_cell", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))))
    joined = ranked.withColumn("_cell", F.shiftright("_rank", cell)).join(cells, ["length", "_cell"]).filter("_rank >= low and _rank < high")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("_rank") - F.col("low")).alias("sequence_id"), "offset")


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, ranks: str | None = None, remember: int = 600_000) -> DataFrame:
    """Every piece of every document with its place in the packed sequences. A task remembers ``remember`` words' ids."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity, ranks, remember), "pack-pieces"), capacity)
