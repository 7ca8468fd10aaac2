"""Exact n-gram Jaccard join.

A document is its set of distinct word shingles. Equal sets are one node. Nodes meet in tiles: a tile is a shingle
of the nodes' prefixes (in an order that puts long shingles first and the most frequent ones last; in any order two
sets that are similar enough share one there) and a band of set sizes. In a tile, hashed bitmap signatures (a bit is the parity of the elements
that hash to it, so differing bits never outnumber differing elements) bound overlaps from above; what passes is
checked by intersecting the sorted arrays.

First each node is checked against its tile's first node and against the one that shares most with others, which
joins groups of near copies; then tiles that still hold several components compare their nodes across components, in
chunks that bound a task. In such a tile the nodes of its largest component meet the others only, not each other.

A shingle that very many nodes have is dealt over salts, by counts that the first pass over the texts gives; each salt
is a tile of its own, their first nodes are checked in a chain, and comparison across components covers all salts.

Defined cases: a text with fewer words than a shingle is one element, its whole sequence; without words or text a
document has an empty set and is linked with nothing; equal ids are one document for the links, with a result row
each; a null id takes part in no link and has a null component; an empty table gives an empty result; further
columns are ignored by the query and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, materialize, mix, released, shingles_of, small_batches, text_slices, words_of

#: Bits of a signature, of the wide one of sets over WIDE_FROM, nodes of a chunk, most frequent shingles at most, rows of a
#: tile about, rows of one tile read at once at most.
BITS, WIDE, WIDE_FROM, CHUNK, HOT, TILE_ROWS, AT_ONCE = 1024, 16_384, 1500, 256, 1 << 19, 20_000, 50_000


def _key(s: np.ndarray) -> bytes:
    """128-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))) if len(s) else np.uint64(0)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, data, offsets in text_slices(texts):
        hashes, first, starts, ends = words_of(data, offsets)
        yield at, shingles_of(hashes, first, ends - starts, words)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: a document's (doc_id, node, n, signature, wide), and (shingle, times) of those found twice or more
    among the sets of a few thousand documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def frequent() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            s, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return s[n >= 2], n[n >= 2]

        def rows(ids, keys, sizes, signatures, wide, s, times) -> pa.RecordBatch:
            a, b = len(keys), len(s)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids, pa.nulls(b, pa.int64())]), pa.array(keys + [None] * b, pa.binary()), pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(b, pa.int64())])]
                + [pa.array(signatures + [None] * b, pa.binary()), pa.array(wide + [None] * b, pa.binary()), pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(s.view(np.int64))]), pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(times.astype(np.int64))])],
                names=["doc_id", "node", "n", "signature", "wide", "shingle", "times"],
            )

        none, seen = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), set()
        for batch in batches:
            for at, sets in _sets(batch.column(1), words):
                keys = [_key(s) for s in sets]
                for k, s in zip(keys, sets):
                    if k not in seen:  # copies in a task don't make a shingle frequent
                        seen.add(k)
                        held.append(s)
                over = sum(map(len, held)) > 1_500_000
                yield rows(batch.column(0).slice(at, len(sets)).cast(pa.int64()), keys, [len(s) for s in sets], [_signature(s) for s in sets], [_signature(s, WIDE) if len(s) >= WIDE_FROM else None for s in sets], *(frequent() if over else none))
        yield rows(pa.nulls(0, pa.int64()), [], [], [], [], *frequent())

    return docs.select("doc_id", "text").mapInArrow(released(read), "doc_id bigint, node binary, n bigint, signature binary, wide binary, shingle bigint, times bigint")


def _least(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _frequent(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with their counts: all from the least count on from which there are HOT
    at most."""
    often = read.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).filter("times >= 8")
    steps = often.groupBy(F.floor(8 * F.log2("times")).alias("step")).count().orderBy(F.desc("step")).collect()  # 512 at most
    upto = np.cumsum([r["count"] for r in steps])
    some = [r["step"] for r, n in zip(steps, upto) if n <= HOT]
    if not some:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = often.filter(F.floor(8 * F.log2("times")) >= some[-1]).toArrow()
    hot, times = np.asarray(found.column(0)).view(np.uint64), np.asarray(found.column(1))
    order = np.argsort(hot)
    return hot[order], times[order]


def _tiles(docs: DataFrame, words: int, percent: int, hot: np.ndarray, times: np.ndarray, tile_rows: int) -> DataFrame:
    """Prefix rows (shingle, salt, salts, node, n, place) of every node that can have a partner; a task emits equal
    sets once."""
    many = 1 + times // tile_rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), words):
                keys, sizes, prefixes = [], [], []
                for s in sets:
                    if not len(s) or (k := _key(s)) in seen:
                        continue
                    seen.add(k)
                    p = len(s) - _least(len(s), percent) + 1
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        often = hot[at] == s
                        rare = s[~often]
                        if len(rare) < p:
                            late = at[often]
                            rare = np.concatenate([rare, hot[late[np.lexsort((hot[late], times[late]))]]])
                        s_prefix = rare[:p]
                    else:
                        s_prefix = s[:p]
                    keys.append(k)
                    sizes.append(len(s))
                    prefixes.append(s_prefix)
                if not keys:
                    continue
                per = np.array([len(p) for p in prefixes])
                index = pa.array(np.repeat(np.arange(len(keys)), per))
                place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                shingle, salts = np.concatenate(prefixes), np.ones(len(place), dtype=np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, shingle), len(hot) - 1)
                    salts = np.where(hot[at] == shingle, many[at], 1).astype(np.int32)
                salt = np.repeat(np.array([int.from_bytes(k[:4], "big") for k in keys]), per) % salts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(salts), pa.array(keys, pa.binary()).take(index), pa.array(np.repeat(np.array(sizes, dtype=np.int32), per)), pa.array(place.astype(np.int32))],
                    names=["shingle", "salt", "salts", "node", "n", "place"],
                )

    return docs.select("text").mapInArrow(released(read), "shingle bigint, salt int, salts int, node binary, n int, place int")


def _shared(prefixes: DataFrame, percent: int, at_once: int) -> DataFrame:
    """Prefix rows of shingles that several nodes have or that are salted, each with its tile's first node (``hub``):
    nodes come by shingle, salt and size, and a new tile begins where the size leaves the band of its first node."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
            fresh = begins(t)
            # the last salt of a shingle may go on in the next batch
            cut = int(np.flatnonzero(fresh)[-1]) if len(fresh) else 0
            last = cut
            if cut == 0 and len(fresh) > at_once:
                cut, last = len(fresh) - 1, len(fresh)  # one tile fills the batch: its last node links on
            carried = t.slice(cut).to_batches()
            carried = carried[0] if carried else None
            if last:
                yield tiles(t.slice(0, last))
        if carried is not None and carried.num_rows:
            yield tiles(pa.Table.from_batches([carried]))

    def begins(t: pa.Table) -> np.ndarray:
        shingle, salt = t.column("shingle").to_numpy(), t.column("salt").to_numpy()
        out = np.ones(len(shingle), dtype=bool)
        out[1:] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
        return out

    def tiles(t: pa.Table) -> pa.RecordBatch:
        t, fresh = t.combine_chunks(), begins(t)
        node = t.column("node").combine_chunks()
        again = np.zeros(len(fresh), dtype=bool)  # tasks that read copies emit a node each
        if len(fresh) > 1:
            again[1:] = ~fresh[1:] & pc.equal(node.slice(1), node.slice(0, len(fresh) - 1)).to_numpy(zero_copy_only=False)
        t = t.take(pa.array(np.flatnonzero(~again)))
        fresh, salts = begins(t), t.column("salts").to_numpy()
        alone = fresh & np.append(fresh[1:], True) & (salts == 1)
        t = t.take(pa.array(np.flatnonzero(~alone))).combine_chunks()
        fresh, n = begins(t), t.column("n").to_numpy()
        hub = np.arange(len(n))
        starts = np.flatnonzero(fresh)
        for a, b in zip(starts, np.append(starts[1:], len(n))):
            while a < b:
                stop = a + int(np.searchsorted(n[a:b], n[a] * 100 // percent, side="right"))
                hub[a:stop] = a
                a = max(stop, a + 1)
        columns = [t.column(c).combine_chunks() for c in ("shingle", "salt", "salts", "node", "n", "place")]
        return pa.RecordBatch.from_arrays([*columns, columns[3].take(pa.array(hub)), columns[4].take(pa.array(hub))], names=["shingle", "salt", "salts", "node", "n", "place", "hub", "hub_n"])

    ordered = prefixes.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "n", "node")
    return ordered.mapInArrow(released(read), "shingle bigint, salt int, salts int, node binary, n int, place int, hub binary, hub_n int")


def _signature(s: np.ndarray, size: int = BITS) -> bytes:
    bits = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


#: Nodes whose ids are broadcast to the texts at most; more meet them by a shuffle.
BROADCAST_NODES = 500_000


def _arrays(docs: DataFrame, found: DataFrame, words: int, most: int) -> DataFrame:
    """(node, items) of the nodes that ``found`` names, ``most`` at most, from the text of the document that stands
    for the node."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch.column(0), words):
                want = batch.column(1).slice(at, len(sets)).to_pylist()
                got = [(k, s.tobytes()) for k, s in zip(want, sets) if _key(s) == k]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in list(zip(*got)) or [[]] * 2], names=["node", "items"])

    wanted = found.select(F.col("ia").alias("_id"), F.col("a").alias("_node")).union(found.select("ib", "b")).distinct()
    if most <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id")).select("text", "_node")
    return texts.mapInArrow(released(read), "node binary, items binary")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _candidates(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose bit counts allow enough overlap, with the ids that stand for both. Large sets,
    whose differences would fill a signature, have a wide one for what passes the first."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(5).to_numpy().astype(np.int64)
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64) for k in (3, 6))
            most = (na + nb - _differing(sa, sb)) // 2
            ok = pa.array((100 * most >= percent * (na + nb - most)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 4, 1, 7, 2, 5)], names=["a", "b", "ia", "ib", "na", "nb"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, dtype=bool)
            both = np.flatnonzero(~(np.asarray(batch.column(4).is_null()) | np.asarray(batch.column(5).is_null())))
            if len(both):
                at = pa.array(both)
                na, nb = (batch.column(k).take(at).to_numpy().astype(np.int64) for k in (6, 7))
                sa, sb = (np.frombuffer(b"".join(batch.column(k).take(at).to_pylist()), dtype=np.uint64).reshape(-1, WIDE // 64) for k in (4, 5))
                most = (na + nb - _differing(sa, sb)) // 2
                ok[both] = 100 * most >= percent * (na + nb - most)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in range(4)], names=["a", "b", "ia", "ib"])

    one = nodes.select(F.col("node").alias("a"), F.col("doc_id").alias("ia"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"), F.col("doc_id").alias("ib"))
    met = pairs.join(one, "a").join(two, "b").select("a", "ia", "na", "sa", "b", "nb", "sb", "ib")
    met = met.mapInArrow(released(read), "a binary, b binary, ia bigint, ib bigint, na bigint, nb bigint")
    large = nodes.filter("wide is not null").select("node", "wide")
    met = met.join(large.toDF("a", "wa"), "a", "left").join(large.toDF("b", "wb"), "b", "left").select("a", "b", "ia", "ib", "wa", "wb", "na", "nb")
    return met.mapInArrow(released(again), "a binary, b binary, ia bigint, ib bigint")


def _links(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b; ids) of those ``pairs`` of nodes whose sets are similar enough: bit counts first, then exact
    intersection of the sorted arrays, which only candidates carry."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i in range(len(ok)):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    found, seen = counted(_candidates(pairs, nodes, percent), "join-candidates", n=F.count("*"))
    arrays = materialize(_arrays(docs, found, words, 2 * seen["n"]), "join-arrays")
    both = found.join(arrays.select(F.col("node").alias("a"), F.col("items").alias("xa")), "a").join(arrays.select(F.col("node").alias("b"), F.col("items").alias("xb")), "b")
    return both.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "xa", "xb").mapInArrow(released(read), "a bigint, b bigint")


def connected(edges: DataFrame) -> tuple[DataFrame, int]:
    """((id, root) of every id that ``edges`` (a, b; bigint) link with a smaller one, the smallest that they reach; their
    number). Edges are turned into stars: each id links its larger neighbours, then its smaller ones, with the
    smallest, until nothing changes."""
    state = {"n": F.count("*"), "bits": F.bit_xor(F.xxhash64("a", "b")), "sum": F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))}
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = counted(e, "component-edges", **state)
    before = None
    while seen["n"] and seen != before:
        before = seen
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("_m"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("_e")).select("_e.*")
        e, seen = counted(e.filter("a <> b").distinct(), "component-edges", **state)
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")), seen["n"]


def _across(shared: DataFrame, nodes: DataFrame, component: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a tile and that place, size and bit counts
    don't exclude. Chunks of a shingle's nodes meet in pairs, by size, and only those whose bands touch and that
    aren't both of the shingle's largest component."""
    rows = shared.select("shingle", "salt", "salts", "node", "n", "place").join(component, "node")
    parts = rows.groupBy("shingle", "component").agg(F.count("*").alias("_rows"), F.max("salts").alias("_salts"))
    largest = F.max_by("component", F.struct("_rows", "component")).alias("_largest")
    open_ = parts.groupBy("shingle").agg(F.count("*").alias("_parts"), largest, F.max("_salts").alias("_salts"), F.sum("_rows").alias("_all")).filter("_parts > 1")
    open_ = open_.select("shingle", "_largest", "_all", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"))
    rows = rows.join(open_, ["shingle", "salt"]).withColumn("large", F.col("component") == F.col("_largest"))
    rows = rows.join(nodes.select("node", "signature"), "node")
    columns = ["shingle", "node", "n", "place", "component", "signature"]
    # most tiles are one cell, whatever their chunks would be
    whole = rows.filter(F.col("_all") <= chunk).select(*columns, F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("other"), F.lit(0).alias("side"))
    rows = rows.filter(F.col("_all") > chunk)
    number = F.row_number().over(Window.partitionBy("shingle", "salt", "large").orderBy("n", "node"))
    # a chunk's number holds its salt and whether it is of the largest component
    at = F.floor((number - 1) / chunk).cast("bigint") * 2 + F.col("large").cast("bigint")
    rows = materialize(rows.withColumn("chunk", at * F.col("salts") + F.col("salt")).select(*columns, "chunk", "large"), "join-open")
    spans = rows.groupBy("shingle", "chunk").agg(F.min("n").alias("_small"), F.max("n").alias("_large"), F.first("large").alias("large"))
    left = spans.filter("not large").select("shingle", "chunk", F.col("_small").alias("_s"), F.col("_large").alias("_l"))
    right = spans.select("shingle", F.col("chunk").alias("other"), F.col("_small").alias("_s2"), F.col("_large").alias("_l2"), F.col("large"))
    touching = (F.col("_s2") * percent <= F.col("_l") * 100) & (F.col("_s") * percent <= F.col("_l2") * 100)
    meet = left.join(right, "shingle").filter(F.col("large") | (F.col("chunk") <= F.col("other"))).filter(touching).select("shingle", "chunk", "other")
    rows = rows.drop("large")
    first = rows.join(meet, ["shingle", "chunk"]).withColumn("side", F.lit(0))
    second = rows.join(meet.filter("chunk <> other").withColumnRenamed("chunk", "_c").withColumnRenamed("other", "chunk"), ["shingle", "chunk"])
    second = second.withColumn("other", F.col("chunk")).withColumn("chunk", F.col("_c")).drop("_c").withColumn("side", F.lit(1))
    cells = whole.unionByName(first).unionByName(second).repartition("shingle", "chunk", "other").sortWithinPartitions("shingle", "chunk", "other", "n", "node")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
            cell = keys(t)
            cut = int(np.flatnonzero(cell == cell[-1])[0]) if len(cell) else 0  # a cell has 512 rows at most
            carried = t.slice(cut).to_batches()[0] if cut < len(cell) else None
            if cut:
                yield compare(t.slice(0, cut))
        if carried is not None:
            yield compare(pa.Table.from_batches([carried]))

    def keys(t: pa.Table) -> np.ndarray:
        a = t.column("shingle").to_numpy().view(np.uint64)
        return mix(mix(a) + t.column("chunk").to_numpy().astype(np.uint64) * np.uint64(1 << 32) + t.column("other").to_numpy().astype(np.uint64))

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        cell, n, place, component, side = keys(t), *[t.column(c).to_numpy().astype(np.int64) for c in ("n", "place", "component", "side")]
        cross = t.column("chunk").to_numpy() != t.column("other").to_numpy()
        bits = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        node = t.column("node").combine_chunks()
        found = [np.zeros((0, 2), dtype=np.int64)]
        step, at = 1, np.arange(len(cell))
        while True:
            at = at[at + step < len(cell)]
            at = at[cell[at] == cell[at + step]]
            if not len(at):
                break
            to = at + step
            most = np.minimum(n[at] - place[at], n[to] - place[to])
            ok = (component[at] != component[to]) & (~cross[at] | (side[at] != side[to])) & (100 * most >= percent * (n[at] + n[to] - most))
            i, j = at[ok], to[ok]
            most = (n[i] + n[j] - _differing(bits[i], bits[j])) // 2
            ok = 100 * most >= percent * (n[i] + n[j] - most)
            found.append(np.stack([i[ok], j[ok]], axis=1))
            step += 1
        pairs = np.concatenate(found)
        a, b = node.take(pa.array(pairs[:, 0])).to_pylist(), node.take(pa.array(pairs[:, 1])).to_pylist()
        once = {(min(x, y), max(x, y)) for x, y in zip(a, b)}
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in once], pa.binary()), pa.array([y for _, y in once], pa.binary())], names=["a", "b"])

    columns = ["shingle", "chunk", "other", "n", "place", "component", "side", "node", "signature"]
    return cells.select(*columns).mapInArrow(released(read), "a binary, b binary").distinct()


def _stars(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each tile's nodes with its first node and with the one that shares most of its prefix with
    others: in a group of edited copies that is the text they come from. The salts of a shingle are linked in a chain."""
    typical = F.count("*").over(Window.partitionBy("node")) / F.col("n")
    rows = shared.withColumn("_typical", typical)
    tile = Window.partitionBy("shingle", "salt")
    rows = rows.withColumn("_hub", F.max_by(F.struct("node", "n"), F.struct("_typical", "node")).over(tile))
    pair = lambda a, na, b, nb: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.least(na, nb).alias("_s"), F.greatest(na, nb).alias("_l"))
    c = F.col
    pairs = rows.select(F.explode(F.array(pair(c("node"), c("n"), c("hub"), c("hub_n")), pair(c("node"), c("n"), c("_hub.node"), c("_hub.n")))).alias("p")).select("p.*")
    firsts = shared.filter("salts > 1").select("shingle", "hub", "hub_n").distinct()
    chain = Window.partitionBy("shingle").orderBy("hub_n", "hub")
    firsts = firsts.select(c("hub"), c("hub_n"), F.lag("hub").over(chain).alias("_b"), F.lag("hub_n").over(chain).alias("_bn")).filter("_b is not null")
    pairs = pairs.union(firsts.select(pair(c("hub"), c("hub_n"), c("_b"), c("_bn")).alias("p")).select("p.*"))
    return pairs.filter((c("a") != c("b")) & (c("_s") * 100 >= c("_l") * percent)).select("a", "b").distinct()


def _components(docs: DataFrame, words: int, percent: int, **tiles: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n of every document; id and root of those that are linked with a smaller id)."""
    with small_batches(docs.sparkSession):  # sets of long texts are large rows
        return _linked(docs, words, percent, **tiles)


def _linked(docs: DataFrame, words: int, percent: int, tile_rows: int = TILE_ROWS, at_once: int = AT_ONCE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    read = materialize(document_sets(docs, words), "join-sets")
    found = read.filter("node is not null").select("doc_id", "node", "n")
    hot, times = _frequent(read)
    shared = materialize(_shared(_tiles(docs.filter("doc_id is not null"), words, percent, hot, times, tile_rows), percent, at_once), "join-shared")
    usable = read.filter("node is not null and doc_id is not null and n > 0")
    nodes = usable.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("wide").alias("wide"))
    nodes = materialize(nodes, "join-nodes")
    ids = usable.groupBy("node").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("_last")).filter("b <> _last").select("node", "b")
    copies = usable.select("node", F.col("doc_id").alias("a")).join(ids, "node").filter("a <> b").select("a", "b")
    roots, n = connected(_links(docs, _stars(shared, percent), nodes, words, percent).union(copies))
    component = nodes.join(roots, nodes["doc_id"] == roots["id"], "left").select("node", F.coalesce("root", "doc_id").alias("component"))
    links = _links(docs, _across(shared, nodes, component, percent, chunk), nodes, words, percent)
    a, b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"_{x}")) for x in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    further, n = connected(between)
    if n:
        above = further.select(F.col("id").alias("root"), F.col("root").alias("_above"))
        roots = roots.join(above, "root", "left").select("id", F.coalesce("_above", "root").alias("root")).union(further)
    return found, roots


def document_components(docs: DataFrame, words: int = 4, percent: int = 85, **tiles: int) -> DataFrame:
    """Per document its set's size and the smallest id it is linked with, over any number of links. ``tiles`` are the
    sizes of tiles and chunks, which the result doesn't depend on."""
    found, roots = _components(docs, words, percent, **tiles)
    return found.join(roots, found["doc_id"] == roots["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def filter_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id. Documents without words or id
    are in no group. Of rows that are equal in id and text one stays; rows of one id with different texts all do."""
    _, roots = _components(docs, words, percent)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    again = docs.filter("doc_id is not null").groupBy("doc_id", text.alias("_t")).count().filter("count > 1")
    # one join by id, written before, so that it is broadcast where it is small
    known = roots.select("id", F.lit(True).alias("_join_gone")).unionByName(again.select(F.col("doc_id").alias("id"), F.lit(False).alias("_join_gone")))
    known = materialize(known.groupBy(F.col("id").alias("_join_id")).agg(F.max("_join_gone").alias("_join_gone")), "join-known")
    kept = docs.join(known, F.col("doc_id") == F.col("_join_id"), "left").filter("_join_gone is null or not _join_gone")
    number = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(F.to_json(F.struct(*docs.columns))))
    more = kept.filter("_join_id is not null").withColumn("_join_number", number).filter("_join_number = 1")
    return kept.filter("_join_id is null").select(*docs.columns).unionByName(more.select(*docs.columns))
