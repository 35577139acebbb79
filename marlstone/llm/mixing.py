"""Operator 8: mixing sources to target weights by weighted fair queueing.

Each document's size is its number of words. Sources share the total in proportion to weights, but none gets more than
``cap`` times its own size; the excess is shared again until none is above. Within a source the documents are shuffled
by hash and queued, over and over up to ``cap`` times; a copy's virtual finish time is the words queued up to its end
over the source's target. All sources' copies are then sorted by that time across ranges and cut where their words
reach the budget, so every source is served in proportion whatever the cut.

Running sums are taken in two steps, buckets of the shuffle hash and rows within a bucket, so a source with a third of
all rows is spread over as many tasks as any; the global order is summed over time ranges in the same way.

Edge cases: null and empty texts have size 0 and take 0; the null source is a source, the last by order; repeated rows
queue each; sources without words have target 0; an empty table gives no row; further columns are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words: places where a word begins."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the shuffle key, and those of its head that choose a bucket.
KEY_BITS, HEAD_BITS = 60, 18


def shuffle_key(seed: int, text: Column) -> Column:
    """A number of KEY_BITS bits from the SHA-256 of seed, doc_id and text: the place in the shuffled order."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), text), 256)
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) by filling up to the caps.

    Sources reach their caps in the order of cap * size / weight, so the level at which what is left is shared follows
    from running sums in that order; one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    n = len(weights)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % n + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(order), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    # the first source in that order whose share stays under its cap sets the level of all after it
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    final = F.min_by(free, F.when(free.isNotNull(), F.struct(F.col("most") / F.col("weight"), F.col("rank")))).over(whole)
    share = F.least(F.col("most"), F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 11, bucket_rows: int = 4096, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words, copies counted).

    ``extra`` names columns of ``docs`` to carry along.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", word_count().alias("size"), shuffle_key(seed, text).alias("h"), *extra)
    rows = written(rows, "sizes")
    n = rows.count()
    targets = written(source_targets(rows, weights, cap), "targets")
    per = sized(targets.withColumnRenamed("source", "s"))
    width = min(max(16, -(-n // bucket_rows)), 1 << HEAD_BITS)  # bounds the tables of bucket and slice sums
    # buckets follow the order of the key, so they part the work and leave the order as it is
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("h", KEY_BITS - HEAD_BITS) * width, HEAD_BITS))
    queue = rows.where("size > 0")
    sums = queue.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    inside = F.sum("size").over(
        Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    queued = queue.withColumn("inside", inside)
    queued = queued.join(starts, queued.source.eqNullSafe(F.col("s")) & (queued.bucket == F.col("b"))).drop("s", "b")
    queued = queued.join(per, queued.source.eqNullSafe(F.col("s"))).drop("s")
    # copy k of a document ends at k whole rounds of the source plus its place in the round
    end = F.col("before") + F.col("inside")
    copies = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    copies = copies.withColumn("finish", (F.col("round") * F.col("source_size") + end) / F.col("target"))
    # time 1 serves the whole budget; the copy that crosses it stays if that brings its source nearer to the target
    crosses = F.col("finish") - F.col("size") / (2 * F.col("target"))
    copies = copies.where(crosses <= 1.0).select("doc_id", "source", "h", "size", "round", "finish")
    ranges = 4 * max(16, width)
    copies = written(copies.withColumn("slice", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges))), "queue")
    slices = copies.groupBy("slice").agg(F.sum("size").alias("words"))
    prior = (F.sum("words").over(Window.orderBy("slice")) - F.col("words")).alias("prior")
    slices = slices.select("slice", prior)
    run = F.sum("size").over(Window.partitionBy("slice").orderBy("finish", "source", "h", "doc_id", "round").rowsBetween(Window.unboundedPreceding, 0))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    served = copies.withColumn("run", run).join(sized(slices, ranges), "slice").where(F.col("run") + F.col("prior") - F.col("size") / 2 <= budget)
    taken = served.groupBy("doc_id", "source", "h").agg(F.sum("size").alias("all_taken"))
    # repeated rows share what their equals took
    same = rows.groupBy("doc_id", "source", "h", "size", *extra).agg(F.count(F.lit(1)).alias("copies"))
    t = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("h").alias("g"), "all_taken")
    out = same.join(t, same.doc_id.eqNullSafe(F.col("d")) & same.source.eqNullSafe(F.col("s")) & (same.h == F.col("g")), "left").drop("d", "s", "g")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    times = F.floor(F.coalesce("all_taken", F.lit(0)) / F.greatest("size", F.lit(1)))
    mine = F.floor(times / F.col("copies")) + (F.col("copy") <= times % F.col("copies")).cast("long")
    out = out.withColumn("taken", (mine * F.col("size")).cast("long"))
    out = out.join(per, out.source.eqNullSafe(F.col("s"))).drop("s")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", *extra)
