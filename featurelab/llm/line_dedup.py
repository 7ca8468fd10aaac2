"""Lines that many documents share stay in one document.

Hashes of lines are range-partitioned with a secondary sort by document and position. Each partition is streamed once:
of a hash's rows those of its first document (the largest id) stay, and the rows after them go once enough documents have
been seen. A hash that may run over the end of a partition is left open there; what the partitions saw of it (two rows
each at most) settles its open rows, so a line of any frequency is cut over as many tasks as it needs. The result is a
compressed bitmap for each document that loses lines, not text.

Defined cases: a null or empty text is one empty line; ``\\n`` alone ends a line, so an empty last line counts; rows
without an id (or with the least long) are together one document, smaller than all others; rows of one id are one
document, whatever their texts, and repeated rows lose the same lines; an empty table gives an empty result; further
columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, OPEN, OPEN_FIRST, SEEN = 0, 1, 2, 3
NO_ID = -(1 << 63)
LINE = ["h1", "h2", "doc", "text_id", "line"]
_STREAM = "kind int, part int, seen bigint, h1 bigint, h2 bigint, doc bigint, text_id bigint, line bigint"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(docs: DataFrame) -> list[Column]:
    """Names a row: its document and, as rows of one id may differ, a hash of its text."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_id")]


def line_hashes(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """(h1, h2, doc, text_id, line) of each line whose key has ``least_chars`` code points or more: 128 bits of hash."""
    lines = docs.select(*_keys(docs), F.posexplode(text_lines(docs["text"])).alias("line", "_line"))
    key = F.translate(F.trim(F.col("_line"), F.lit(WHITE)), UPPER, LOWER)
    keys = lines.withColumn("_key", key).filter(F.char_length("_key") >= least_chars)
    return keys.select(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("h2"), "doc", "text_id", F.col("line").cast("long").alias("line"))


class _Stream:
    """One partition's rows in order, batch by batch; of the hash at hand only undecided rows are kept, which are those
    of fewer than ``documents`` documents."""

    def __init__(self, documents: int):
        self._least, self._hash, self._shared, self.out = documents, None, True, []

    def feed(self, rows: np.ndarray) -> None:
        """``rows``: the columns of LINE."""
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        new[0] = self._hash is None or (rows[0, :2] != self._hash).any()
        starts = np.flatnonzero(new)
        if not len(starts):
            return self._more(rows)
        if self._hash is not None:
            self._more(rows[: starts[0]])
            self._close()
        elif len(starts) > 1:  # the partition's first hash, whole
            self._open(rows[0])
            self._more(rows[: starts[1]])
            self._close()
            starts = starts[1:]
        inner = rows[starts[0] : starts[-1]]
        if len(inner):
            self._whole(inner)
        self._open(rows[starts[-1]])
        self._more(rows[starts[-1] :])

    def _whole(self, rows: np.ndarray) -> None:
        """Rows of hashes that begin and end here."""
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        doc = fresh.copy()
        doc[1:] |= rows[1:, 2] != rows[:-1, 2]
        group, upto = np.cumsum(fresh) - 1, np.cumsum(doc)
        ordinal = upto - upto[np.flatnonzero(fresh)][group] + 1
        self._tell(DROP, rows[(np.bincount(group, doc)[group] >= self._least) & (ordinal > 1)])

    def _open(self, row: np.ndarray) -> None:
        self._shared = self._hash is None  # an earlier partition may have begun the partition's first hash
        self._hash, self._seen, self._doc, self._waiting = row[:2].copy(), 0, None, []

    def _more(self, rows: np.ndarray) -> None:
        """More rows of the hash. Those after its first document go once enough documents are seen; whether the first
        document's go hangs on the partitions before."""
        if not len(rows):
            return
        doc = np.ones(len(rows), dtype=bool)
        doc[1:] = rows[1:, 2] != rows[:-1, 2]
        doc[0] = rows[0, 2] != self._doc if self._doc is not None else True
        ordinal = self._seen + np.cumsum(doc)
        self._seen, self._doc = int(ordinal[-1]), rows[-1, 2]
        if self._shared:
            self._tell(OPEN_FIRST, rows[ordinal == 1])
        self._waiting.append(rows[ordinal > 1])
        if self._seen >= self._least:
            for x in self._waiting:
                self._tell(DROP, x)
            self._waiting = []

    def _close(self, last: bool = False) -> None:
        if self._shared or last:
            self._tell(SEEN, np.array([[*self._hash, 0, 0, 0]], dtype=np.int64), self._seen)
            for x in self._waiting:
                self._tell(OPEN, x)

    def end(self) -> None:
        if self._hash is not None:
            self._close(last=True)

    def _tell(self, kind: int, rows: np.ndarray, seen: int = 0) -> None:
        if len(rows):
            self.out.append((kind, seen, rows))


def _streamed(documents: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = _Stream(documents), TaskContext.get().partitionId()

        def told() -> Iterator[pa.RecordBatch]:
            for kind, seen, rows in state.out:
                n = len(rows)
                columns = [np.full(n, kind, np.int32), np.full(n, part, np.int32), np.full(n, seen, np.int64), *(np.ascontiguousarray(c) for c in rows.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "part", "seen", *LINE])
            state.out = []

        for batch in batches:
            if batch.num_rows:
                state.feed(np.column_stack([batch.column(k).to_numpy() for k in range(len(LINE))]))
                yield from told()
        state.end()
        yield from told()

    return stream


def dropped_lines(docs: DataFrame, least_chars: int = 40, documents: int = 5) -> DataFrame:
    """(doc, text_id, line) of every line that goes."""
    hashes = materialize(line_hashes(docs, least_chars), "line-hashes")  # its ranges are sampled before they are dealt
    ordered = hashes.repartitionByRange("h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "text_id", "line")
    streamed = materialize(ordered.mapInArrow(_streamed(documents), _STREAM), "line-stream")
    seen = streamed.filter(F.col("kind") == SEEN).groupBy("h1", "h2").agg(F.sum("seen").alias("documents"), F.min("part").alias("begins"))
    undecided = streamed.filter(F.col("kind").isin(OPEN, OPEN_FIRST)).join(seen, ["h1", "h2"])
    go = (F.col("documents") >= documents) & ((F.col("kind") == OPEN) | (F.col("part") > F.col("begins")))
    names = ["doc", "text_id", "line"]
    return streamed.filter(F.col("kind") == DROP).select(names).unionByName(undecided.filter(go).select(names))


def _bitmaps(lines: pa.Array) -> pa.Array:
    def pack(x: list[int]) -> bytes:
        keep = np.ones(max(x) // 8 * 8 + 8, dtype=np.uint8)
        keep[x] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return pa.array([pack(x) for x in lines.to_pylist()], pa.binary())


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, documents: int = 5) -> DataFrame:
    """(doc, text_id, n_dropped, keep) of each document that loses lines. ``keep``: a bit a line up to the last one
    dropped, 1 if it stays, deflated; the last byte is filled with ones, and lines beyond it stay."""
    lines = dropped_lines(docs, least_chars, documents)
    each = lines.groupBy("doc", "text_id").agg(F.collect_set("line").alias("lines"))  # repeated rows name a line more than once
    return each.select("doc", "text_id", F.size("lines").cast("long").alias("n_dropped"), F.arrow_udf(_bitmaps, "binary")("lines").alias("keep"))


def _cut(texts: pa.Array, keeps: pa.Array) -> pa.Array:
    def cut(text: str | None, keep: bytes | None) -> str | None:
        if keep is None:
            return None
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
        return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i >= len(bits) or bits[i])

    return pa.array([cut(t.as_py(), k.as_py()) for t, k in zip(texts, keeps)], pa.string())


def deduplicated(docs: DataFrame, least_chars: int = 40, documents: int = 5) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``: keys of ``least_chars`` code points or more
    in ``documents`` documents or more lose their lines but for those of the largest doc_id. Only texts that lose lines
    go to Python."""
    doc, text = _keys(docs)
    bitmaps = keep_bitmaps(docs, least_chars, documents).select(F.col("doc").alias("_doc"), F.col("text_id").alias("_text_id"), F.col("n_dropped").alias("_gone"), "keep")
    rows = docs.select(*docs.columns, doc.alias("_d"), text.alias("_t"))
    both = rows.join(bitmaps.hint("shuffle_hash"), (F.col("_d") == F.col("_doc")) & (F.col("_t") == F.col("_text_id")), "left")
    loses = F.col("_gone").isNotNull()
    cut = F.arrow_udf(_cut, "string")(F.when(loses, docs["text"]), F.col("keep"))
    return both.select(*[docs[c] for c in docs.columns], F.when(loses, cut).otherwise(F.coalesce(docs["text"], F.lit(""))).alias("kept_text"), F.size(text_lines(docs["text"])).cast("long").alias("n_lines"), F.coalesce("_gone", F.lit(0)).alias("n_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    rows = deduplicated(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
