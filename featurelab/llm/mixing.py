"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points pass through the cumulative target shares and give each slot of the schedule a source; slots
are ranked per source; slot r of a source reads block r of its shuffled stream of words (blocks of equal size,
taken from the start again in a second pass). The few slots that a source has beyond its target go, in their order, to
sources that have too few; a source's last slot stops at its target. What is taken of a document is what its blocks'
slots read, and a document's place in the mix is the slot of its first block.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source, last in order;
repeated rows each have their place in the stream; an empty table or one without words gives targets of 0;
further columns are ignored by the query and kept by :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, counted, materialize

#: The golden ratio's fractional part in 31 bits: slot k's point is frac(k * ratio) * 2^31, in integers.
GOLDEN_31 = 1327217885
ONE_31 = 1 << 31


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (source, source_size, target) of ``sizes`` (source, size). The targets fill up by
    weight and stop at ``most`` times the source: with sources by the ratio cap / weight, the level that is
    left after the first k have stopped is (total - caps of those) / weights of the others."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    s = s.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    # the first source by ratio that doesn't reach its cap fixes the level of all after it
    open_level = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level"))
    s = s.withColumn("_at", F.first(open_level, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.coalesce(F.least(F.col("_at") * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def _plan(targets: DataFrame, block: int) -> DataFrame:
    """Per source its number, stream length, words to take, blocks, slots needed and span of 31-bit points."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = targets.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    t = t.withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    needed = f"if(source_size = 0, 0, (words div greatest(source_size, 1)) * blocks + cast(ceil((words % greatest(source_size, 1)) / {block}) as bigint))"
    t = t.withColumn("needed", F.expr(needed))
    t = t.withColumn("_upto", F.sum("needed").over(by_name)).withColumn("_all", F.sum("needed").over(Window.partitionBy()))
    point = lambda x: F.floor(x / F.greatest(F.col("_all"), F.lit(1)) * ONE_31).cast("long")
    return t.withColumns({"low": point(F.col("_upto") - F.col("needed")), "high": point(F.col("_upto"))}).drop("_upto", "_all")


def schedule(plan: DataFrame, total: int, step: int = GOLDEN_31) -> DataFrame:
    """The ``total`` slots of ``plan`` (source_no, rank, slot): slot k is the source's in whose span the point
    k * ``step`` (in 31 bits) falls. Slots that a source has beyond its need go, in order, to the sources that have too few.

    Sources meet the points by an equality join on 4,096 cells of the unit interval. Ranks go per source and run
    of 65,536 slots with the counts of earlier runs added, so that no source meets in one task."""
    spark = plan.sparkSession
    cell = 19
    spans = plan.filter("high > low").select("source_no", "needed", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % ONE_31) * step % ONE_31).alias("point")).withColumn("cell", F.shiftright("point", cell))
    slots = slots.join(spans, "cell").filter("point >= low and point < high").select("source_no", "needed", "slot", F.shiftright("slot", 16).alias("run"))
    counts = slots.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot"))
    ranked = slots.withColumn("own", own).join(counts, ["source_no", "run"])
    ranked = materialize(ranked.select("source_no", (F.col("before") + F.col("own") - 1).cast("long").alias("rank"), "slot", "needed"), "mix-slots")
    # what is over and what is short are a few slots per source: the sequence's discrepancy
    over = ranked.filter("rank >= needed").select("slot", F.row_number().over(Window.orderBy("slot")).alias("_n"))
    had = ranked.groupBy("source_no").agg(F.count("*").alias("had"))
    short = plan.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < needed")
    short = short.select("source_no", F.explode(F.sequence(F.col("had").cast("long"), F.col("needed") - 1)).alias("rank"))
    short = short.withColumn("_n", F.row_number().over(Window.orderBy("rank", "source_no"))).join(over, "_n")
    return ranked.filter("rank < needed").select("source_no", "rank", "slot").unionByName(short.select("source_no", "rank", "slot"))


def _streams(sizes: DataFrame, n: int, plan: DataFrame, seed: int) -> DataFrame:
    """Place (``start``) of every row of ``sizes`` (``n`` rows) in its source's shuffled stream of words. Sums go per
    source and bucket of the shuffle hash, the sums of earlier buckets are added: a hot source is many buckets."""
    rows = sizes.filter("size > 0").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    buckets = 1 << max(4, (max(1, n // 20_000) - 1).bit_length())
    known = plan.select(F.col("source").alias("_s"), "source_no", "blocks", "words", "source_size")
    rows = rows.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(buckets))).join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sums = rows.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("source_no", "_bucket").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(sums, ["source_no", "_bucket"])
    return rows.withColumn("start", F.col("_before") + F.col("_own")).drop("_h", "_bucket", "_own", "_before")


def mix(sizes: DataFrame, n: int, block: int = 256, seed: int = 17, step: int = GOLDEN_31) -> DataFrame:
    """``sizes`` (doc_id, source, size; a written table of ``n`` rows) with source_size, target, taken: the words of each
    row that the schedule's blocks take, and ``slots``: the slot of the first of its blocks in each pass."""
    plan, seen = counted(_plan(source_targets(sizes), block), "mix-plan", slots=F.sum("needed"), passes=F.max(F.expr("words div greatest(source_size, 1)")))
    rows = _streams(sizes, n, plan, seed)
    # a row's blocks in each pass, by the rank of the slot that reads them
    parts = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(seen["passes"] or 0)).cast("long"))))
    parts = parts.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    parts = parts.withColumn("rank", F.expr("_pass * blocks + block"))
    slots = schedule(plan, int(seen["slots"] or 0), step)
    limit = F.expr("if(_pass < words div source_size, source_size, words % source_size)")
    own = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, limit) - F.greatest("start", F.col("block") * block)
    read = F.when(F.col("slot").isNotNull(), F.greatest(own, F.lit(0))).otherwise(0)
    first = [F.min(F.when((F.col("_pass") == k) & (F.col("_read") > 0), F.col("slot"))) for k in range(int(seen["passes"] or 0) + 1)]
    got = parts.join(slots, ["source_no", "rank"], "left").withColumn("_read", read)
    got = got.groupBy("source_no", "start", "doc_id", "size").agg(F.sum("_read").alias("taken"), F.array(*first).alias("slots"))
    known = plan.select("source_no", F.col("source").alias("_s"), "source_size", "target")
    got = got.join(known, "source_no").select("doc_id", F.col("_s").alias("source"), "size", "source_size", "target", "taken", "slots")
    none = sizes.filter("size = 0").join(known, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("array<bigint>").alias("slots"))
    return got.unionByName(none)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def document_shares(docs: DataFrame, block: int = 256, step: int = GOLDEN_31) -> DataFrame:
    """One row per document: what the mix takes of it, and its place in the mix (null: none)."""
    sizes, seen = counted(docs.select("doc_id", "source", _size().alias("size")), "mix-sizes", n=F.count("*"))
    return mix(sizes, seen["n"], block, step=step).select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


def mix_documents(docs: DataFrame, block: int = 256, step: int = GOLDEN_31, in_order: bool = False) -> DataFrame:
    """The mixed documents: each as often as the words taken of it come to its size, rounded, a copy per pass of the
    schedule. Rows that are equal in id and text share evenly. Every partition has its copies in the order of their
    slots; ``in_order`` orders partitions too, which shuffles all texts once more."""
    key = {"_mix_size": _size(), "_mix_hash": F.xxhash64(F.coalesce("text", F.lit("")))}
    sizes = docs.select("doc_id", "source", *[c.alias(k) for k, c in key.items()])
    sizes, seen = counted(sizes.select(F.struct("doc_id", "_mix_hash").alias("doc_id"), "source", F.col("_mix_size").alias("size")), "mix-sizes", n=F.count("*"))
    taken = mix(sizes, seen["n"], block, step=step).filter("size > 0").groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"), F.min("slots").alias("slots"))
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    places = F.slice(F.array_sort(F.filter("slots", lambda x: x.isNotNull())), 1, copies)
    taken = taken.select(F.col("doc_id.doc_id").alias("_mix_id"), F.col("doc_id._mix_hash").alias("_mix_same"), F.col("source").alias("_mix_source"), places.alias("_mix_slots")).filter("size(_mix_slots) > 0")
    equal = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col("_mix_hash") == F.col("_mix_same")) & F.col("source").eqNullSafe(F.col("_mix_source"))
    joined = docs.withColumn("_mix_hash", key["_mix_hash"]).join(taken, equal).withColumn("_mix_slot", F.explode("_mix_slots"))
    ordered = joined.orderBy("_mix_slot", "_mix_hash") if in_order else joined.sortWithinPartitions("_mix_slot", "_mix_hash")
    return ordered.select(*docs.columns)
