"""Mixing sources to target weights along a time-varying curriculum (operator 7).

Each source has a weight schedule over training time 0..1 that rises or falls linearly.  Its integral,
scaled to the source's target, is the source's cumulative demand for words.  Documents of a source stand
in a random but fixed order, once for each pass over the source; a copy's place in that order is inverted
through the demand to the time when training reaches it.  Sorting all copies by time mixes the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermatch.llm.common import KEY, one_row_each, row_key, stored, word_count

WEIGHTS = (5, 2, 1)
TILTS = (-0.5, 0.0, 0.5)  # change of a source's weight from the mean at the start (-tilt) to the end (+tilt)
MOST = 3  # copies of a document, and targets in sizes of their source
BUCKET_ROWS = 4_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, tilt, target of each source, from (source, source_size).

    Sources in code point order, null last, take the weights in turn.  Shares of the total by weight stop
    at ``most`` times a source's size; what is over is shared again.  In order of size per weight, the
    first source that its share does not fill ends the resharing, so one pass settles it.  The window
    holds one row for each source.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long")
    tilt = F.element_at(F.array(*map(F.lit, TILTS)), place % len(TILTS) + 1)
    known = sizes.withColumn("weight", weight).withColumn("tilt", tilt).withColumn("cap", F.col("source_size") * most)
    fullness = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*fullness).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*fullness).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*fullness).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = known.withColumn(
        "left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ).withColumn("weights", F.sum("weight").over(onward))
    free = F.col("weight") * F.col("left") <= F.col("cap") * F.col("weights")
    ends = F.first(F.when(free, F.struct("left", "weights")), ignorenulls=True).over(everything)
    share = F.col("weight") * F.col("ends.left") / F.col("ends.weights")
    return filled.withColumn("ends", ends).select(
        "source", "source_size", "weight", "tilt",
        F.least(F.col("cap").cast("double"), share.cast("double")).alias("target"))


def training_time(fraction: Column, tilt: Column) -> Column:
    """When a schedule that goes linearly from 1 - tilt to 1 + tilt has spent a fraction of its integral."""
    start = F.lit(1.0) - tilt
    root = F.sqrt(start * start + 4 * tilt * fraction)
    return F.when(fraction <= 0, 0.0).otherwise(2 * fraction / (start + root))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
          weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Every row's copies: doc_id, size, source_size, target, copies, taken, times, and its row key.

    Size is the number of words (0 for a null text).  A null source is a source of its own.  Whole passes
    give every row the same copies; of the broken pass a row gets one if the middle of it lies in it, so a
    source's words differ from its target by half a document at most.  The order is by an MD5 of doc_id
    and by size, so reruns agree; repeated rows stand next to each other.

    A source's order is summed in two levels (buckets of the hash, rows in a bucket), so a source with a
    third of all rows is spread over many tasks.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                      word_count(F.col(f"`{text}`")).alias("size"), *row_key(docs))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = stored(own.withColumn("place", order), "sizes")
    buckets = -(-docs.count() // BUCKET_ROWS) or 1
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("bucket", F.shiftright(number * buckets, 32))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    known = stored(bases.join(goals, bases.source.eqNullSafe(goals.source)).drop(goals.source), "targets")
    row = Window.partitionBy("source", "bucket").orderBy("place", "size", *KEY).rowsBetween(
        Window.unboundedPreceding, -1)
    within = sized.withColumn("before", F.coalesce(F.sum("size").over(row), F.lit(0)))
    placed = within.alias("d").join(
        known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.bucket") == F.col("k.bucket")))
    passes = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(MOST))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    at = F.col("base") + F.col("before")
    extra = (F.col("size") > 0) & (F.col("passes") < MOST) & (2 * at + F.col("size") <= 2 * rest)
    counted = placed.withColumn("passes", passes).withColumn("copies", F.col("passes") + extra.cast("long"))
    times = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(
            F.array().cast("array<bigint>")),
        lambda n: training_time(F.least(F.lit(1.0), (n * F.col("source_size") + at) / F.col("target")), F.col("tilt")))
    return counted.select("d.doc_id", "size", "source_size", "target", "copies",
                          (F.col("copies") * F.col("size")).alias("taken"), times.alias("times"), *KEY)


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, range-sorted by training time."""
    keyed = mixed(docs, doc_id, source, text).where("copies > 0").groupBy(*KEY).agg(
        F.flatten(F.collect_list("times")).alias("training_times"))
    rows = one_row_each(docs, stored(keyed, "mixture"))
    copies = rows.select("row", F.explode("training_times").alias("time"))
    return in_training_order(copies).select("row.*")


def in_training_order(copies: DataFrame, *more: str) -> DataFrame:
    """Range-sorted by ``time``, null last, then by ``more``."""
    order = [F.col("time").asc_nulls_last(), *map(F.col, more)]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order)


def rows_in_order(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``mixed`` by the training time of their first copy, those without a copy last."""
    timed = mixed(docs, doc_id, source, text).withColumn("time", F.get("times", F.lit(0)))
    return in_training_order(timed, "doc_id", *KEY)


def positions(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, copy, time, position of every copy: its training time and its place from 0 in training order.

    Copies are numbered in the partitions of the range sort, shifted by the counts of earlier partitions.
    """
    each = mixed(docs, doc_id, source, text).select("doc_id", *KEY, F.posexplode("times").alias("copy", "time"))
    numbered = stored(in_training_order(each, "doc_id", *KEY, "copy").select(
        "doc_id", "copy", "time", F.monotonically_increasing_id().alias("n")), "positions")
    part, place = F.shiftright("n", 33), F.col("n").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("held"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    return numbered.withColumn("part", part.cast("int")).join(starts, "part").select(
        "doc_id", "copy", "time", (F.col("start") + place).alias("position"))
