"""Deterministic stratified samples of exact size: quotas by largest remainder, rows by md5 of seed and id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotas(rows: DataFrame, size: int) -> DataFrame:
    """(label, n, quota): quotas add up to ``size``."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    share = counts.withColumn("exact", F.col("n") * float(size) / F.sum("n").over(every)).withColumn("base", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), "label"))
    missing = F.lit(size) - F.sum("base").over(every)
    return share.withColumn("quota", F.col("base") + (rank <= missing).cast("long")).select("label", "n", "quota")


def _shares(counts: dict, size: int) -> dict:
    """The quotas of :func:`quotas` from counts that are known."""
    total = sum(counts.values())
    exact = {k: n * float(size) / total for k, n in counts.items()}
    base = {k: int(x // 1) for k, x in exact.items()}
    for k in sorted(counts, key=lambda k: (base[k] - exact[k], k))[: size - sum(base.values())]:
        base[k] += 1
    return base


def stratified_samples(rows: DataFrame, wanted: Sequence[tuple[int, int]], id_column: str = "image_id") -> list[Column]:
    """For each (size, seed) a condition on the rows: whether the row is of that sample, in which each label has its
    share. Ids are unique, and every row has a label.

    Of a label and seed, the rows of least hash are chosen. One aggregate counts rows by label and the hash's first 12
    bits, for all seeds at once; that tells in which bucket a quota ends, and only rows of such buckets are ranked. What
    comes back is a threshold per label and sample, so choosing shuffles no rows."""
    key = F.col(id_column)
    hashed = lambda seed: F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    seeds = list(dict.fromkeys(seed for _, seed in wanted))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("sample"), hashed(seed).alias("h")) for k, seed in enumerate(seeds)]))
    long = rows.select("label", key.alias("id"), each.alias("_s")).select("label", "id", "_s.sample", "_s.h", F.substring("_s.h", 1, 3).alias("bucket"))
    counted = long.groupBy("sample", "label", "bucket").count().collect()  # seeds x classes x 4,096 at most
    buckets: dict[tuple, list] = {}
    for r in sorted(counted, key=lambda r: r.bucket):
        buckets.setdefault((r["sample"], r.label), []).append((r.bucket, r["count"]))
    counts = {label: sum(n for _, n in found) for (k, label), found in buckets.items() if k == 0}
    if None in counts:
        raise ValueError("every row needs a label")
    total, ends, needed = sum(counts.values()), {}, set()
    for size, seed in wanted:
        if not 0 < size <= total:
            raise ValueError(f"sample size must be between 1 and {total}")
        if size < total and min(size, total - size) < len(counts):
            raise ValueError("the sample and the rest need a row of every class")
        for label, quota in _shares(counts, size).items():
            k, left = seeds.index(seed), quota
            for bucket, n in buckets[k, label]:
                if 0 < left <= n:
                    ends[size, seed, label] = (k, label, bucket, left)
                    needed.add((k, label, bucket, left))
                left -= n
    kind = rows.schema["label"].dataType.simpleString()
    places = rows.sparkSession.createDataFrame(sorted(needed), f"sample int, label {kind}, bucket string, rank int")
    in_order = Window.partitionBy("sample", "label", "bucket").orderBy("h", "id")
    some = long.join(F.broadcast(places.select("sample", "label", "bucket").distinct()), ["sample", "label", "bucket"], "left_semi")  # a bucket per class and sample
    ranked = some.withColumn("rank", F.row_number().over(in_order)).join(F.broadcast(places), ["sample", "label", "bucket", "rank"])
    found = {(r["sample"], r.label, r.bucket, r["rank"]): (r.h, r.id) for r in ranked.select("sample", "label", "bucket", "rank", "h", "id").collect()}
    out = []
    for size, seed in wanted:
        last = [(label, *found[ends[size, seed, label]]) for label in counts if (size, seed, label) in ends]
        limit = F.create_map(*[x for label, h, i in last for x in (F.lit(label).cast(kind), F.struct(F.lit(h).alias("h"), F.lit(i).cast(rows.schema[id_column].dataType).alias("id")))])
        out.append(F.coalesce(F.struct(hashed(seed).alias("h"), key.alias("id")) <= F.element_at(limit, F.col("label")), F.lit(False)))
    return out


def stratified_sample(rows: DataFrame, size: int, seed: int, id_column: str = "image_id") -> DataFrame:
    """``rows`` with ``chosen``: ``size`` of them, each label in proportion."""
    return rows.withColumn("chosen", stratified_samples(rows, [(size, seed)], id_column)[0])
