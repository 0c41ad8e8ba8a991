"""The history table: one row per listing, first and last seen dates kept up by each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offermatch import rules as R
from offermatch.session import dropping_shuffles, stored
from offermatch.sinks.outputs import display_columns, project

ID, FIRST, LAST = "Listing ID", "First Seen Date", "Last Seen Date"


def history_layout(columns: list[str]) -> str:
    """'current', 'legacy' or 'custom'; a table without id and last-seen columns is refused."""
    names = [c.strip() for c in columns]
    if names == R.HISTORY_HEADERS:
        return "current"
    if names == R.LEGACY_HISTORY_HEADERS:
        return "legacy"
    if ID in names and LAST in names:
        return "custom"
    raise ValueError("history has an unexpected header row")


def history_rows(deals: DataFrame, seen_date: str, columns: list[str] | None = None) -> DataFrame:
    """Deals as history rows in the given layout; unknown custom columns stay null."""
    wanted = columns or R.HISTORY_HEADERS
    day = F.lit(seen_date).cast("date")
    known = [c for c in wanted if c in {*R.HISTORY_HEADERS, *R.LEGACY_HISTORY_HEADERS}]
    rows = project(deals, known, {FIRST: day, LAST: day})
    for name in wanted:
        if name not in known:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.select(*[F.col(f"`{c}`") for c in wanted])


def merge_history(history: DataFrame, deals: DataFrame, seen_date: str, order: list[str],
                  history_ord: str = "row") -> tuple[DataFrame, DataFrame]:
    """(new history, counts of appended and updated ids).

    ``history`` carries its row number in ``history_ord``.  The first deal row per id counts; of
    a known id only the last-seen date changes (on its last row, should it occur twice); blank ids
    are skipped.  History is joined with narrow id rows and never shuffled for inserts.
    """
    columns = [c for c in history.columns if c != history_ord]
    history_layout(columns)
    day = F.lit(seen_date).cast("date")
    shown = {**display_columns(deals), FIRST: day, LAST: day}
    null = F.lit(None).cast("string")
    rows = deals.select(
        shown[ID].alias("_id"), F.struct(*order).alias("_at"),
        F.struct(*[shown.get(c, null).alias(c) for c in columns]).alias("_row"),
    ).filter(F.col("_id") != "")
    first = rows.groupBy("_id").agg(F.min_by("_row", "_at").alias("_row"))
    last_rows = history.groupBy(F.col(f"`{ID}`").alias("_id")).agg(
        F.max(history_ord).alias("_last")
    ).filter(F.coalesce("_id", F.lit("")) != "")
    known = last_rows.join(first.select("_id"), "_id", "left_semi")
    touched = history.join(
        known.withColumnRenamed("_last", history_ord), history_ord, "left"
    )
    updated = touched.select(*[
        (F.when(F.col("_id").isNotNull(), day).otherwise(F.col(f"`{c}`")) if c == LAST
         else F.col(f"`{c}`")).alias(c)
        for c in columns
    ])
    fresh = first.join(last_rows, "_id", "left_anti").select("_row.*")
    counts = first.join(last_rows.select("_id", "_last"), "_id", "left").agg(
        F.count_if(F.col("_last").isNull()).alias("appended"),
        F.count_if(F.col("_last").isNotNull()).alias("updated"),
    )
    return updated.unionByName(fresh), counts


BUCKET, ROW = "bucket", "row"


def _bucket(listing_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(listing_id, F.lit(""))), F.lit(buckets)).cast("int")


def write_history(history: DataFrame, path: str, buckets: int = 512) -> None:
    """A history table (with its row number in ``row``) as folders of ids, ``buckets`` of them.

    The number of buckets stays with the table; it is chosen so that a run's new ids touch few of them, or that
    a bucket is small.
    """
    layout = [c for c in history.columns if c != ROW]
    history_layout(layout)
    rows = history.withColumn(BUCKET, _bucket(F.col(f"`{ID}`"), buckets))
    with dropping_shuffles(history.sparkSession):
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def upsert_history(spark: SparkSession, path: str, deals: DataFrame, seen_date: str, order: list[str], run: int,
                   buckets: int = 512, schema: StructType | None = None) -> DataFrame:
    """Merge a run's deals into a history kept by :func:`write_history`; returns appended and updated counts.

    Only the buckets that the run's ids fall into are read and written, found by their numbers, which are at most
    ``buckets``; every other file stays as it is.  ``run`` numbers the runs and
    becomes the ``row`` of what they add.  A run that is repeated after a failure, even half-way through its buckets, gives the same table.  A table that may be
    empty needs its ``schema``.
    """
    ids = display_columns(deals)[ID]
    with dropping_shuffles(spark):
        touched = sorted(r[0] for r in deals.select(_bucket(ids, buckets)).filter(ids != "").distinct().collect())
    held = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    here = held.filter(F.col(BUCKET).isin(touched) if touched else F.lit(False))
    columns = [c for c in held.columns if c not in (BUCKET, ROW)]
    day = F.lit(seen_date).cast("date")
    old = here.select(*[F.col(f"`{c}`") for c in columns], ROW, BUCKET)
    shown = {**display_columns(deals), FIRST: day, LAST: day}
    null = F.lit(None).cast("string")
    first = deals.select(
        shown[ID].alias("_id"), F.struct(*order).alias("_at"), F.struct(*[shown.get(c, null).alias(c) for c in columns]).alias("_row"),
    ).filter(F.col("_id") != "").groupBy("_id").agg(F.min_by("_row", "_at").alias("_row"))
    # Everything of an id lies in one bucket: the rows of the touched buckets meet the deals once, by id.
    last = F.max(ROW).over(Window.partitionBy(f"`{ID}`"))
    met = old.withColumn("_last", last).join(
        first.select(F.col("_id").alias(ID), F.lit(True).alias("_seen")), ID, "left")
    again = F.coalesce("_seen", F.lit(False)) & (F.col(ROW) == F.col("_last"))
    kept = met.select(*[F.when(again, day).otherwise(F.col(f"`{c}`")).alias(c) if c == LAST else F.col(f"`{c}`") for c in columns],
                      ROW, BUCKET, again.alias("_again"))
    fresh = first.join(old.select(F.col(f"`{ID}`").alias("_id")).distinct(), "_id", "left_anti").select(
        "_row.*", F.lit(run).cast("long").alias(ROW), _bucket(F.col("_id"), buckets).alias(BUCKET), F.lit(None).cast("boolean").alias("_again"))
    # Written once for the counts and for the table: the old files are read before any of them is replaced.
    merged = stored(kept.unionByName(fresh), "merged")
    with dropping_shuffles(spark):
        merged.drop("_again").repartition(BUCKET).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return merged.agg(F.count_if(F.col("_again").isNull()).alias("appended"), F.count_if("_again").alias("updated"))
