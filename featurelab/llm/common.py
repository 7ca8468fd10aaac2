"""Shared folder, materialisation and word hashing used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if all tasks run in this process,
    an error otherwise: executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="featurelab-")
    return _OWN["dir"]


def give_back(spark: SparkSession) -> None:
    """The driver's JVM gives native memory that it has freed back to the system, as workers do in :func:`released`: many
    plans make its compilers and codecs free much that the C library would keep. A JVM without that command keeps it."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    name_of, types, values = jvm.java.lang.Class.forName, new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    try:
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = name_of(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class isn't public, so its interface is asked
        name_of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage is cut, and a lost
    executor costs only a reread. What the driver freed meanwhile is given back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of about ``size`` at most in what is executed inside, for rows that may be large each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize` with aggregates of the rows, taken while they are written."""
    seen = Observation()
    written = materialize(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return written, seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_crc(col) -> F.Column:
    """crc32 of the id's decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Longer words are hashed one by one.
_LONG_WORD = 128
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _hashed(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word of bytes: every 8 bytes are added to what the mixer made of those before."""
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(low) + 1, 8), (1, 1))
    at = np.flatnonzero(lengths <= _LONG_WORD)
    done = 0
    while len(at):
        block = eights[starts[at] + done].view("<u8")[:, 0] & _HEAD[np.minimum(lengths[at] - done, 8)]
        h[at] = mix(mix(h[at] ^ block) + np.uint64(0x2545F4914F6CDD1D))
        done += 8
        at = at[lengths[at] > done]
    for k in np.flatnonzero(lengths > _LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def released(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``read`` for mapInArrow; at its end the worker, which waits for other tasks then, gives unused memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from read(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return run


def text_slices(texts: pa.Array, most: int = 1 << 18, rows: int = 1 << 20):
    """(first row, bytes, row offsets) of runs of ``rows`` rows at most and about ``most`` bytes; a longer text is a
    run of its own. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each row and the end, word starts, word ends)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    inside = _IS_WORD[low]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True  # a row begins here: words never run over
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return _hashed(low, starts, ends), np.searchsorted(starts, offsets), starts, ends


_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles_of(hashes: np.ndarray, first: np.ndarray, lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct codes of its ``size``-word shingles; fewer words: the whole sequence as one;
    none: empty. A code is 6 bits of inverted length in bytes (63 or more are 0) and 58 of hash, so that long
    shingles, which are rare ones, come first."""
    n = len(hashes)
    upto = np.concatenate([[0], np.cumsum(lengths)])

    def code(h: np.ndarray, length: np.ndarray) -> np.ndarray:
        return ((63 - np.minimum(length, 63)).astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))

    if n >= size:
        windows = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            windows += mix(hashes[k : n - size + 1 + k] * _K[k % 6] + np.uint64(k))
        windows = code(mix(windows), upto[size:] - upto[:-size])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                whole = mix(hashes[k : k + 1] * _K[(k - a) % 6] + whole)
            out.append(code(whole, upto[b : b + 1] - upto[a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
