"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample (``sample`` rows by hash of the id); every row is
then assigned to its nearest centroid's list and its residual encoded. Lists that lie near each other make a shard, in
which a list of more than SHARD_ROWS rows is several shards by hash of the id. A query probes the lists of the largest
centroid products until they hold the share of rows that reaches ``recall`` on the sample, there scores their rows by
asymmetric distance tables, and reranks each shard's ``shortlist`` exactly, in double precision. An exact check follows,
so that nothing near is missed whatever the vectors are like: a row's product is at most that with its code plus the
query's length times the code's error, and a list's at most that with its centroid plus the query's length times the
list's radius. Rows and lists whose bound reaches the ``k``-th best score known so far, among some rows of the sample and
the shard's shortlist, are scored exactly too. A query goes to the shards that have lists of either kind only. Queries
meet a shard in chunks, so that a task holds a bounded number of both.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite components
take no part, neither as query nor as candidate; of rows with equal ids the nearest counts, once, and as a query the one of
least vector; equal scores go to the
smaller id; with fewer candidates than ``k`` all are returned; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Shards at least, rows of a shard about, queries of a chunk about.
SHARDS, SHARD_ROWS, CHUNK = 24, 20_000, 20_000
#: Rows of the sample at most, of which every query takes its first bound.
SEEN = 5_000


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if empty := int((n == 0).sum()):
            c[n == 0] = x[rng.choice(len(x), size=empty)]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = 0.5 * (c * c).sum(axis=1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ c.T - half, axis=1)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.select("vec_id", v.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    ok = ok.filter(~bad & F.exists("embedding", lambda x: x != 0))
    return ok


def fit_index(rows: DataFrame, n: int, sample: int = 20_000, parts: int = 16, recall: float = 0.96, seed: int = 7) -> dict:
    """Centroids (about the square root of ``n``, 4,096 at most) and codebooks, from ``sample`` rows at most."""
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // (2 * sample)))) == 0)
    some = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    found = some.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.float64)
    dim = x.shape[1]
    lists = int(min(4096, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n)))))))
    lists = min(lists, len(x))
    centroids = _kmeans(x, lists, 8, seed)
    near = _nearest(x, centroids)
    residual = x - centroids[near]
    cuts = np.array_split(np.arange(dim), min(parts, dim))
    books = [_kmeans(residual[:, c], min(256, len(x)), 6, seed + i) for i, c in enumerate(cuts, 1)]
    first = np.sort(np.unique(ids, return_index=True)[1])[:SEEN]  # one row of an id
    return {"centroids": centroids, "cuts": cuts, "books": books, "share": _probe_share(x, centroids, near, recall), "seen_ids": ids[first], "seen": x[first]}


def _probe_share(x: np.ndarray, centroids: np.ndarray, near: np.ndarray, recall: float, queries: int = 200, k: int = 20) -> float:
    """The share of rows to probe that finds ``recall`` of the exact neighbours among the sample. Neighbours are
    closer together in more rows, so that the share is rather too large for all."""
    q = x[:: max(1, len(x) // queries)]
    exact = np.argsort(-(q @ x.T), axis=1)[:, : k + 1]
    order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    reach = np.cumsum(np.bincount(near, minlength=len(centroids))[order], axis=1) / len(x)
    before = np.concatenate([np.zeros((len(q), 1)), reach], axis=1)
    need = np.take_along_axis(before, np.take_along_axis(place, near[exact], axis=1), axis=1)
    return float(min(1.0, np.quantile(need, recall) + 0.02))


def build_index(rows: DataFrame, model: dict) -> DataFrame:
    """Every row with its list, its code, how far the code is off (``error``) and its distance from the centroid (``off``)."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["embedding"].tolist(), dtype=np.float64).reshape(len(f), -1)
            near = _nearest(x, model["centroids"])
            residual = x - model["centroids"][near]
            codes = np.stack([_nearest(residual[:, c], b) for c, b in zip(model["cuts"], model["books"])], axis=1).astype(np.uint8)
            left = np.concatenate([residual[:, c] - b[codes[:, m]] for m, (c, b) in enumerate(zip(model["cuts"], model["books"]))], axis=1)
            yield pd.DataFrame({"vec_id": f["vec_id"], "list_id": near, "code": [c.tobytes() for c in codes], "error": np.linalg.norm(left, axis=1), "off": np.linalg.norm(residual, axis=1), "embedding": list(x)})

    return rows.mapInPandas(encode, "vec_id bigint, list_id bigint, code binary, error double, off double, embedding array<double>")


def _bundles(centroids: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each list: lists are halved across the direction in which they differ most
    until a bundle holds ``most`` rows; a larger list is several shards."""
    first, splits, shards = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64), 0
    todo = [np.arange(len(sizes))]
    while todo:
        lists = todo.pop()
        if len(lists) > 1 and sizes[lists].sum() > most:
            x = centroids[lists] - centroids[lists].mean(axis=0)
            along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
            lists = lists[np.argsort(along, kind="stable")]
            half = int(np.searchsorted(np.cumsum(sizes[lists]), sizes[lists].sum() / 2, side="right"))
            half = min(max(half, 1), len(lists) - 1)
            todo += [lists[:half], lists[half:]]
        else:
            first[lists], splits[lists] = shards, max(1, -(-int(sizes[lists].sum()) // most))
            shards += int(splits[lists[0]])
    return first, splits


def _probed(near: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which lists each query probes, by its products with the centroids (``near``)."""
    order = np.argsort(-near, axis=1, kind="stable")
    reach = np.cumsum(sizes[order], axis=1)
    probed = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(probed, order, reach - sizes[order] < least, axis=1)
    return probed


def _kth_seen(q: np.ndarray, own: np.ndarray, model: dict, k: int) -> np.ndarray:
    """The ``k``-th best score of each query among rows of the sample other than its own; -inf if there are fewer."""
    if len(model["seen"]) <= k:
        return np.full(len(q), -np.inf)
    score = q @ model["seen"].T
    score[own[:, None] == model["seen_ids"][None, :]] = -np.inf
    return np.partition(score, score.shape[1] - k, axis=1)[:, -k]


def _best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the hits are the ``k`` best of their query (``at``), an id once, by query, score and id."""
    order = np.lexsort((-score, ids, at))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (at[order][1:] != at[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((ids[order], -score[order], at[order]))]
    return order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < k]


def _products(x: np.ndarray, row: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of rows and queries, pair by pair: equal vectors have equal ones."""
    parts = [(x[row[lo : lo + 50_000]] * q[at[lo : lo + 50_000]]).sum(axis=1) for lo in range(0, len(row), 50_000)]
    return np.concatenate(parts) if parts else np.zeros(0)


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.96, shortlist: int = 60, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = dims[0]
    rows = rows.filter(F.size("embedding") == dim)
    model = fit_index(rows, n, recall=recall)
    index = materialize(build_index(rows, model), "ann-index")
    held = {r.list_id: r for r in index.groupBy("list_id").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries"), F.max("off").alias("off")).collect()}  # at most 4,096 rows
    sizes = np.array([held[i].n if i in held else 0 for i in range(len(model["centroids"]))], dtype=np.int64)
    radius = np.array([held[i].off if i in held else -np.inf for i in range(len(sizes))])
    longest = float((np.linalg.norm(model["centroids"], axis=1) + np.maximum(radius, 0)).max())
    chunks = max(1, -(-sum(r.queries for r in held.values()) // chunk))
    least = max(8 * k, model["share"] * n)
    first, splits = _bundles(model["centroids"], sizes, max(1, min(shard_rows, -(-n // SHARDS))))

    def _slack(q: np.ndarray) -> np.ndarray:
        """What rounding may take from a bound."""
        return 1e-9 * np.linalg.norm(q, axis=1) * longest

    def _reached(q: np.ndarray, near: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which lists may hold a row of each query's score ``reach``."""
        return (near + np.linalg.norm(q, axis=1)[:, None] * radius >= (reach - _slack(q))[:, None]) & (sizes > 0)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = np.array(f["embedding"].tolist()).reshape(len(f), -1)
            for lo in range(0, len(f), 512):
                some, own = q[lo : lo + 512], f["query_id"].to_numpy()[lo : lo + 512]
                near, reach = some @ model["centroids"].T, _kth_seen(some, own, model, k)
                probed = _probed(near, sizes, least) | _reached(some, near, reach)
                found = [np.unique(np.concatenate([np.arange(a, a + s) for a, s in set(zip(first[p].tolist(), splits[p].tolist()))])) for p in probed]
                at = np.repeat(np.arange(lo, lo + len(found)), [len(x) for x in found])
                part = f.iloc[at].copy()
                part["shard"], part["reach"] = np.concatenate(found), reach[at - lo]
                yield part[["query_id", "embedding", "shard", "reach"]]

    def scan(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if not len(queries) or not len(rows):
            return found[0]
        rows = rows.sort_values(["list_id", "vec_id"], kind="stable")
        ids, x, error = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist()), rows["error"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1).astype(np.int64)
        lists, starts = np.unique(rows["list_id"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(rows))
        step = max(1, 500_000 // len(rows))
        for lo in range(0, len(queries), step):
            part = queries.iloc[lo : lo + step]
            q, own, reach = np.array(part["embedding"].tolist()), part["query_id"].to_numpy(), part["reach"].to_numpy().copy()
            near, length, slack = q @ model["centroids"].T, np.linalg.norm(q, axis=1), _slack(q)
            tables = [q[:, cut] @ book.T for cut, book in zip(model["cuts"], model["books"])]
            approx = np.full((len(part), len(rows)), -np.inf)
            mine = own[:, None] == ids[None, :]

            def look(which: np.ndarray) -> None:
                for name, a, b in zip(lists, starts, ends):  # the lists that a query doesn't probe cost it nothing
                    some = np.flatnonzero(which[:, name])
                    if not len(some):
                        continue
                    block = np.repeat(near[some, name][:, None], b - a, axis=1)
                    for m, table in enumerate(tables):
                        block += table[some][:, codes[a:b, m]]
                    approx[some, a:b] = block
                approx[mine] = -np.inf

            probed = _probed(near, sizes, least)
            look(probed)
            most = min(shortlist, len(rows))
            row = np.argpartition(-approx, most - 1, axis=1)[:, :most].ravel()
            at = np.repeat(np.arange(len(part)), most)
            told = np.isfinite(approx[at, row])
            at, row = at[told], row[told]
            score = _products(x, row, q, at)
            best = _best(at, ids[row], score, k)
            at, row, score = at[best], row[best], score[best]
            full = np.flatnonzero(np.bincount(at, minlength=len(part)) == k)
            last = np.searchsorted(at, full, side="right") - 1
            reach[full] = np.maximum(reach[full], score[last])
            look(_reached(q, near, reach) & ~probed)
            near_enough = (approx + length[:, None] * error >= (reach - slack)[:, None]) & ~mine  # the exact check
            some = np.flatnonzero(near_enough.any(axis=0))
            more, place = np.nonzero(near_enough[:, some] & (q @ x[some].T >= (reach - slack)[:, None]))
            at, row, score = np.append(at, more), np.append(row, some[place]), np.append(score, _products(x, some[place], q, more))
            best = _best(at, ids[row], score, k)
            found.append(pd.DataFrame({"query_id": own[at[best]], "vec_id": ids[row[best]], "score": score[best]}))
        return pd.concat(found)

    queries = index.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").groupBy("query_id").agg(F.min("embedding").alias("embedding"))  # the least of several vectors of one id
    queries = queries.mapInPandas(route, "query_id bigint, embedding array<double>, shard bigint, reach double").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    # every chunk of queries reads the shard's rows again, of which there are about as many
    of = spark.createDataFrame([(i, int(a), int(s)) for i, (a, s) in enumerate(zip(first, splits))], "list_id bigint, _first bigint, _splits bigint")  # at most 4,096 rows
    dealt = index.join(F.broadcast(of), "list_id").withColumn("shard", F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_splits"))).drop("_first", "_splits")
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    hits = queries.groupBy("shard", "chunk").cogroup(dealt.groupBy("shard", "chunk")).applyInPandas(scan, "query_id bigint, vec_id bigint, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
