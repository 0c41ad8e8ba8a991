"""History fed by a file stream equals one merge per batch."""

from pyspark.sql import functions as F

from offermatch.sinks.history import history_rows, upsert_history, write_history
from offermatch.streaming.history_feed import feed_history

SCHEMA = "o int, listing_id string, link string, title string, matched_item string, price double"


def test_history_feed(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "history")

    def arrive(rows, day):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        feed_history(stream, folder, str(tmp_path / "cp"), day, ["o"], buckets=8).awaitTermination()

    arrive([(1, "a", "", "t", "x", 1.0), (2, "b", "", "u", "x", 2.0)], "2024-01-01")
    arrive([(1, "b", "", "changed", "x", 9.0), (2, "c", "", "v", "x", 3.0)], "2024-01-02")
    rows = {r["Listing ID"]: r for r in spark.read.parquet(folder).collect()}
    assert {k: (str(r["First Seen Date"]), str(r["Last Seen Date"])) for k, r in rows.items()} == {
        "a": ("2024-01-01", "2024-01-01"), "b": ("2024-01-01", "2024-01-02"), "c": ("2024-01-02", "2024-01-02")}
    assert rows["b"]["Listing Title"] == "u"


def test_a_run_replaces_the_buckets_of_its_ids_only(spark, tmp_path):
    path = str(tmp_path / "history")
    deals = spark.createDataFrame([(i, f"id{i}", "", "t", "x", 1.0) for i in range(400)], SCHEMA)
    start = history_rows(deals, "2024-01-01").withColumn("row", F.lit(0).cast("long"))
    write_history(start, path, buckets=32)
    files = lambda: {str(f.relative_to(path)) for f in (tmp_path / "history").rglob("*.parquet")}
    before = files()
    run = spark.createDataFrame([(2, "id7", "", "late", "x", 9.0), (1, "id7", "", "new", "x", 9.0), (3, "fresh", "", "f", "x", 2.0),
                                 (4, "", "", "blank", "x", 2.0)], SCHEMA)
    counts = upsert_history(spark, path, run, "2024-01-02", ["o"], 1, buckets=32).first()
    assert (counts.appended, counts.updated) == (1, 1)
    gone = {f.split("/")[0] for f in before - files()}
    assert 1 <= len(gone) <= 2 and len(before & files()) >= 28
    rows = {r["Listing ID"]: r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 401 and rows["id7"]["Listing Title"] == "t"
    assert {k for k, r in rows.items() if str(r["Last Seen Date"]) == "2024-01-02"} == {"id7", "fresh"}
    again = upsert_history(spark, path, run, "2024-01-02", ["o"], 1, buckets=32).first()
    assert again.appended == 0 and {r["Listing ID"]: r for r in spark.read.parquet(path).collect()} == rows
    untouched = files()
    upsert_history(spark, path, run.limit(0), "2024-01-03", ["o"], 2, buckets=32)
    assert files() == untouched


def test_the_last_row_of_a_repeated_id_is_seen_again(spark, tmp_path):
    path = str(tmp_path / "history")
    deals = spark.createDataFrame([(i, "a" if i < 3 else "b", "", f"t{i}", "x", 1.0) for i in range(4)], SCHEMA)
    rows = deals.select("o", "listing_id", "link", "title", "matched_item", "price")
    start = history_rows(rows, "2024-01-01").withColumn("row", F.regexp_extract("`Listing Title`", "t(.)", 1).cast("long"))
    write_history(start, path, buckets=4)
    upsert_history(spark, path, deals.filter("o = 0"), "2024-02-02", ["o"], 9, buckets=4)
    seen = {r["Listing Title"]: str(r["Last Seen Date"]) for r in spark.read.parquet(path).collect()}
    assert seen == {"t0": "2024-01-01", "t1": "2024-01-01", "t2": "2024-02-02", "t3": "2024-01-01"}
