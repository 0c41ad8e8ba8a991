"""What stays on disk between the jobs of a run, and what is moved at all."""

import time

import pytest
from pyspark.sql import functions as F

from offermatch.operators import audits as A, deals as D
from offermatch.operators.pairs import likely_among
from offermatch.plans.audit_queries import pairs
from offermatch.session import stored
from offermatch.sinks import history as H
from offermatch.sources import listings as L

AUDIT = """listing_id string, chunk_number int, pos int, matched_item string, confidence bigint, specs_matched boolean,
 is_accessory boolean, is_bundle boolean, separately_available boolean, individual_price double, price_evidence string"""
STAGE_ONE = "listing_id string, item_name string, effective_price double, price double, price_flag string, title string, description string, seq int, deal_price double, ord int"
TARGETS = "item_name string, deal_price double, retail_price double, target_type string, allow_bundle_check boolean, downsizing_keywords array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark):
    """Shuffle files of jobs that are over, once the driver has had time to drop them."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f and f.endswith(".data")}


def gone(spark, before):
    """Whether the files go within seconds; nothing here collects the driver's garbage."""
    until = time.time() + 10
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.25)
    return not shuffles(spark) - before


def test_stored_tables_leave_no_shuffles(spark):
    before = shuffles(spark)
    assert len(stored(spark.range(1000).repartition(5, "id"), "kept").collect()) == 1000
    assert gone(spark, before)


def test_history_leaves_no_shuffles(spark, tmp_path):
    before = shuffles(spark)
    old = spark.range(50).select(F.col("id").cast("string").alias("Listing ID"), F.lit(None).cast("date").alias("Last Seen Date"),
                                 F.col("id").alias("row"))
    H.write_history(old, str(tmp_path / "history"), buckets=4)
    assert gone(spark, before)


def test_likely_among_keeps_wanted_rows_and_drops_most_others(spark):
    rows = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    some = rows.filter("a < 'n2'").unionByName(rows.filter("a < 'n2'"))
    none = spark.createDataFrame([(None, "1"), ("n1", None)], "a string, b string")
    got = [tuple(r) for r in likely_among(rows.unionByName(none), some, "a", "b").collect()]
    wanted = {tuple(r) for r in some.collect()}
    assert wanted <= set(got) and len(got) == len(set(got)) < len(wanted) + 10
    assert likely_among(rows, some.limit(0), "a", "b").count() == 0


def test_unjudged_candidates_are_not_moved(spark):
    audits = spark.createDataFrame([
        ("a", 1, 0, "x", 90, True, False, False, False, None, None), ("b", 1, 1, "x", 90, True, False, False, False, None, None),
        ("c", 1, 2, "x", 10, True, False, False, False, None, None), ("d", 1, 3, None, 90, True, False, False, False, None, None),
    ], AUDIT)
    found = spark.createDataFrame([
        ("a", "x", 5.0, 5.0, "normal", "t", "d", 1, 0.0, 0), ("a", "x", 7.0, 7.0, "normal", "t", "d", 2, 0.0, 0),
        ("a", "y", 5.0, 5.0, "normal", "t", "d", 3, 0.0, 0), ("b", "x", 50.0, 50.0, "normal", "t", "d", 4, 0.0, 0),
        ("c", "x", 5.0, 5.0, "normal", "t", "d", 5, 0.0, 0), (None, "x", 5.0, 5.0, "normal", "t", "d", 6, 0.0, 0),
    ], STAGE_ONE)
    cat = spark.createDataFrame([("x", 10.0, 20.0, "Hardware", False, ["issue"])], TARGETS)
    made = D.accept_audited(audits, found, cat, ["chunk_number", "pos"])
    assert [(r.listing_id, r.verified_price) for r in made.collect()] == [("a", 7.0)]
    assert "bitmap_construct_agg" in plan(made)


def test_routed_candidates_move_once(spark):
    rows = spark.range(1, 61).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("listing_id"),
                                     F.expr("(id - 1) div 20 + 1").alias("chunk_number"))
    rows = rows.unionByName(spark.createDataFrame([(61, None, 1), (62, None, 2), (63, "5", 1)], "seq long, listing_id string, chunk_number long"))
    key = "chunk_number bigint, listing_id string"
    failed = spark.createDataFrame([(1,)], "chunk_number bigint")
    missing = spark.createDataFrame([(1, "3"), (2, "25"), (2, "25"), (3, "25"), (2, None)], key)
    outside = spark.createDataFrame([(3, "41"), (None, "42")], key)
    made = A.route_fallback(rows, failed, missing, outside)
    assert plan(made).count("Range (") == 1
    assert sorted(r.seq for r in made.collect()) == [*range(1, 21), 25, 41, 61, 63]


@pytest.fixture
def tables(spark, tmp_path):
    line = """1L AS l_orderkey, 2L AS l_partkey, 3L AS l_suppkey, 1 AS l_linenumber, 4.0D AS l_quantity, 500.0D AS l_extendedprice,
 0.1D AS l_discount, 0.1D AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus, DATE'1995-01-01' AS l_shipdate"""
    for name, row in [("lineitem", line), ("supplier", "3L AS s_suppkey, 's' AS s_name"),
                      ("part", "2L AS p_partkey, 'red ring' AS p_name, 'b' AS p_brand, 't' AS p_type, 1.0D AS p_retailprice")]:
        spark.sql(f"SELECT {row}").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_pairs_find_listings_where_their_part_is(spark, tables):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = pairs(spark, tables)
        assert plan(made).count("hashpartitioning(l_partkey") == 2  # of listings once, and of names
        assert [(r.listing_id, r.title, r.item_name, r.seller, r.price) for r in made.collect()] == [
            ("1-1", "red ring", "red ring", "s", 5.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_merging_moves_the_order_once_for_a_scalar(spark):
    rows = spark.createDataFrame([
        (1, "a", "", None, ["u"]), (2, "a", "t", 0.0, ["v", "u"]), (3, "a", "z", 4.0, ["w"]), (4, "b", "", None, None)],
        "o int, listing_id string, title string, price double, source_urls array<string>").withColumn("link", F.lit(""))
    made = L.merge_listings(rows, ["o"], ["title", "price"], ["source_urls"])
    assert {r.identity_key: (r.o, r.title, r.price, r.source_urls) for r in made.collect()} == {
        "a": (1, "t", 4.0, ["u", "v", "w"]), "b": (4, "", None, [])}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("min_by(") == 2
