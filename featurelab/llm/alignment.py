"""Alignment of two tokenizers' tokens over the same bytes.

Spark deals out the documents; a task cuts each into pieces that no token runs over, and tokenises and aligns each
different piece once. Bytes where both tokenizers end cut a piece's tokens into groups. Each byte where either ends gives
one link: the pair of tokens that cover it. A document's groups and links are those of its pieces, one after another.

Pairs are counted over documents and looked up for every link: pairs held by many documents, at most ``broadcast_pairs``
of them, are broadcast, all others are joined by a shuffle.

Defined cases: a text that is null or empty, or whose bytes the tokens of one tokenizer don't give back, has no tokens:
zeros and ''; special tokens' strings are plain text; every row is a document, repeated ones too; an empty table gives an
empty result; further columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, small_batches

DOCUMENTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<bigint>"
SPACE = "▁"


def _byte_values() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Pair:
    """Both tokenizers over texts in batches.

    No token of either runs over the border between a character that is no white space and a space after it, so texts
    are cut there; pieces seen before come from a table of their tokens, groups and links, which is dropped when it is
    large."""

    def __init__(self, a: str, b: str, ranks: str | None = None, remember: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a)
        self._a.encode_special_tokens = True
        self._encode_a = lambda s: self._a.encode(s, add_special_tokens=False).ids
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
            self._encode_a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._b = sentencepiece.SentencePieceProcessor(model_file=b)
        values, names = _byte_values(), {i: t for t, i in self._a.get_vocab().items()}
        self.a_bytes = [bytes(values[c] for c in t) if (t := names.get(i, "")) and all(c in values for c in t) else t.encode() for i in range(max(names) + 1)]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._space = self._b.piece_to_id(SPACE)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece runs over the end of a word")
        self._a_len, self._b_len = (np.array([len(x) for x in t], dtype=np.int32) for t in (self.a_bytes, self.b_bytes))
        self._most = remember
        self._forget()

    def _forget(self) -> None:
        self._seen: dict[str, int] = {}
        self._ids = (array("i"), array("i"))
        self._first = (array("q", [0]), array("q", [0]))
        self._wrong = bytearray()
        self._links, self._first_link = array("q"), array("q", [0])  # A's id times 2^32 plus B's
        self._groups: list[bytes] = []
        self._n_groups = array("q")

    def _add(self, pieces: list[str]) -> None:
        """New ones. Each begins with a space, of which B's pieces have the first by themselves; A gives all bytes back."""
        before = len(self._wrong)
        for piece, a, b in zip(pieces, map(self._encode_a, pieces), self._b.encode([p[1:] for p in pieces], num_threads=1)):
            b = b or [self._space]
            self._seen[piece] = len(self._wrong)
            self._wrong.append(b"".join(map(self.b_bytes.__getitem__, b)) != piece.encode())
            for ids, flat, first in zip((a, b), self._ids, self._first):
                flat.extend(ids)
                first.append(len(flat))
        self._align(before)

    def _align(self, before: int) -> None:
        """Groups and links of the pieces from number ``before`` on; wrong ones, which no text uses, have none."""
        right = np.frombuffer(self._wrong, np.uint8)[before:] == 0
        ids, ends = [], []
        for flat, begin, lengths in zip(self._ids, self._first, (self._a_len, self._b_len)):
            begin = np.frombuffer(begin, np.int64)[before:]
            own = np.frombuffer(flat, np.int32)[begin[0] :][np.repeat(right, np.diff(begin))].astype(np.int64)
            ids.append(own)
            ends.append(np.cumsum(lengths[own], dtype=np.int64))  # over all right pieces, of which both have the same bytes
            last = np.cumsum(np.diff(begin) * right)
        (a, b), (a_end, b_end) = ids, ends
        over = np.concatenate([[0], b_end])[last]  # where each piece ends
        every, common = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
        self._first_link.extend((len(self._links) + np.searchsorted(every, over, side="right")).tolist())
        self._links.frombytes(((a[np.searchsorted(a_end, every)] << 32) + b[np.searchsorted(b_end, every)]).tobytes())
        cut = np.searchsorted(common, over, side="right")
        self._n_groups.extend(np.diff(cut, prepend=0).tolist())
        a, b, texts = list(map(str, a.tolist())), list(map(str, b.tolist())), []
        i = j = 0
        for i2, j2 in zip((np.searchsorted(a_end, common) + 1).tolist(), (np.searchsorted(b_end, common) + 1).tolist()):
            texts.append(f"{a[i]}|{b[j]}" if i2 - i == j2 - j == 1 else ",".join(a[i:i2]) + "|" + ",".join(b[j:j2]))
            i, j = i2, j2
        k = 0
        for k2 in cut.tolist():
            self._groups.append(";".join(texts[k:k2]).encode())
            k = k2

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Of a space and ``text``."""
        parts = text.split(" ")
        if all(parts) and all(not p[-1].isspace() for p in parts):
            return [" " + p for p in parts]
        out, open_ = [], True  # open: no character but white space since the last border
        for p in parts:
            if open_ and out:
                out[-1] += " " + p
            else:
                out.append(" " + p)
            open_ = not p or p[-1].isspace()
        return out

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts' pieces, their numbers in the table)."""
        if len(self._seen) > self._most:
            self._forget()
        every, first = [], [0]
        for text in texts:
            every += self.pieces(text) if text else []
            first.append(len(every))
        rows = list(map(self._seen.get, every))
        if None in rows:
            self._add(list(dict.fromkeys(p for p, at in zip(every, rows) if at is None)))
            rows = list(map(self._seen.__getitem__, every))
        rows, n = np.array(rows, dtype=np.int64), np.diff(first)
        wrong = np.concatenate([[0], np.cumsum(np.frombuffer(self._wrong, np.uint8)[rows])])
        good = wrong[first[1:]] == wrong[first[:-1]]
        return np.concatenate([[0], np.cumsum(n * good)]), rows[np.repeat(good, n)]

    def chunk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(offsets of the texts' pieces, places of these among the chunk's different pieces; for A and B: offsets of the
        different pieces' tokens, ids, byte ends within the piece)."""
        first, rows = self.found(texts)
        pieces, place = np.unique(rows, return_inverse=True)
        sides = []
        for flat, begin, lengths in zip(self._ids, self._first, (self._a_len, self._b_len)):
            upto, ids = _gathered(np.frombuffer(flat, np.int32), np.frombuffer(begin, np.int64), pieces)
            ends = np.concatenate([[0], np.cumsum(lengths[ids], dtype=np.int64)])
            sides.append((upto, ids, (ends[1:] - np.repeat(ends[upto[:-1]], np.diff(upto))).astype(np.int32)))
        return first, place, sides

    def documents(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """(A tokens, B tokens and groups of each text; digests of its groups; offsets of its links; links, sorted within
        their text)."""
        first, rows = self.found(texts)

        def summed(each: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(each[rows])])[first])

        counts = [summed(np.diff(np.frombuffer(begin, np.int64))) for begin in self._first] + [summed(np.frombuffer(self._n_groups, np.int64))]
        upto, links = _gathered(np.frombuffer(self._links, np.int64), np.frombuffer(self._first_link, np.int64), rows)
        upto, groups, digests = upto[first], list(map(self._groups.__getitem__, rows.tolist())), []
        for i, j, x, y in zip(first[:-1].tolist(), first[1:].tolist(), upto[:-1].tolist(), upto[1:].tolist()):
            digests.append(hashlib.sha256(b";".join(groups[i:j])).hexdigest() if j > i else "")
            links[x:y].sort()
        return counts, digests, upto, links


def _gathered(flat: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the lists ``rows``, one after another; list k is ``flat`` from ``begin[k]`` to ``begin[k + 1]``."""
    many = begin[rows + 1] - begin[rows]
    upto = np.concatenate([[0], np.cumsum(many)])
    return upto, flat[np.repeat(begin[rows] - upto[:-1], many) + np.arange(upto[-1])]


def aligned(docs: DataFrame, a: str, b: str, ranks: str | None = None, rows: int = 2048, size: int = 1 << 21) -> DataFrame:
    """DOCUMENTS of ``docs`` (doc_id, text), read in chunks of ``rows`` documents at most, and about ``size`` characters
    unless one document has more."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(a, b, ranks)

        def one(ids: list, texts: list) -> pa.RecordBatch:
            counts, digests, upto, links = pair.documents(texts)
            columns = [pa.array(ids, pa.int64()), *(pa.array(n.astype(np.int64)) for n in counts), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(links))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if len(ids) >= rows or held >= size:
                    yield one(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield one(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(encode), DOCUMENTS)


def _looked_up(documents: DataFrame, pairs: DataFrame, broadcast_pairs: int) -> DataFrame:
    """(row, n_best, count_sum): of each row's links, how many are their A id's best, and the sum of their counts."""
    sizes = pairs.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count"))  # a row for each count that occurs
    least, held = 0, 0
    for r in sizes.toLocalIterator():
        if held + r.n > broadcast_pairs:
            least = r["count"] + 1
            break
        held += r.n
    links = documents.select("row", F.explode("links").alias("pair"))
    often = F.broadcast(pairs.filter(F.col("count") >= least))
    if least == 0:
        found = links.join(often, "pair")
    else:
        some = links.join(often, "pair", "left")
        rare = some.filter(F.col("count").isNull()).select("row", "pair").join(pairs.filter(F.col("count") < least), "pair")
        found = some.filter(F.col("count").isNotNull()).unionByName(rare)
    return found.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


def alignments(docs: DataFrame, a: str, b: str, ranks: str | None = None, broadcast_pairs: int = 1_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs``. Links are written
    once, sorted within their document, in which they take little room."""
    with small_batches(docs.sparkSession):
        documents = materialize(aligned(docs, a, b, ranks).select(F.monotonically_increasing_id().alias("row"), "*"), "links")
    held = documents.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    pairs, a_id = materialize(held, "pairs"), F.shiftright("pair", 32)
    most = pairs.groupBy(a_id.alias("_a")).agg(F.max("count").alias("_most"))
    pairs = pairs.join(most, a_id == F.col("_a")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    counts = _looked_up(documents, pairs, broadcast_pairs)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.select("row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256").join(counts, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
