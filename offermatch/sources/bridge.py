"""Catalog and listing tables derived from the TPC-H-like test tables.

The same SQL text runs in Spark and in the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermatch.functions.text import split_keywords
from offermatch.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

CATALOG_SQL = """
SELECT p_name AS item_name, min(p_type) AS category, max(p_retailprice) AS retail_price,
 CAST(300 + 10 * length(p_name) AS DOUBLE) AS deal_price,
 CASE WHEN p_name LIKE '%ring' THEN 'Game' ELSE 'Hardware' END AS target_type,
 p_name LIKE '%gear' AS allow_bundle_check,
 'issue, defect, scratch' AS downsizing_keywords,
 'comes with, free, includes' AS freebie_keywords
FROM part GROUP BY p_name
"""

LISTINGS_SQL = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS listing_id,
 CASE l_linenumber WHEN 1 THEN p_name WHEN 2 THEN concat(upper(p_name), ' ', p_brand)
  WHEN 3 THEN concat('case for ', p_name) WHEN 4 THEN concat(p_name, ' bundle + extras')
  WHEN 5 THEN concat(p_name, ' complete set with case') WHEN 6 THEN concat('rush ', p_name, ' 0.4k')
  ELSE concat('item ', p_brand) END AS title,
 CASE WHEN l_discount = 0 THEN 0 WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 100 END AS price,
 CASE l_returnflag WHEN 'A' THEN 'brand new' WHEN 'N' THEN 'Like New' ELSE 'well used' END AS condition,
 CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'no issue, comes with charger.'
  WHEN 1 THEN 'has scratch. free pouch and cable' WHEN 2 THEN 'price: php 1,200 only #rush'
  WHEN 3 THEN 'contact 0917 123 4567 or seller@example.com' WHEN 4 THEN 'asking 0.4k, not a defect'
  ELSE '' END AS description,
 s_name AS seller, p_type AS category, l_shipdate AS listed_at,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""

LISTING_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, spread over the cores: each is a single small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _sql(spark: SparkSession, sf_dir: str, text: str, names: list[str]) -> DataFrame:
    return spark.sql(
        text.replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}")
        .replace("JOIN part", "JOIN {part}").replace("JOIN supplier", "JOIN {supplier}"),
        **{n: table(spark, sf_dir, n) for n in names},
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed catalog rows in item-name order (``ord`` 1, 2, ...)."""
    raw = _sql(spark, sf_dir, CATALOG_SQL, ["part"])
    # One row per distinct product name: a small dimension, so a global numbering is fine.
    return raw.select(
        F.row_number().over(Window.orderBy("item_name")).cast("long").alias("ord"),
        "item_name", "category", "retail_price", "deal_price", "target_type",
        "allow_bundle_check",
        split_keywords(F.col("downsizing_keywords")).alias("downsizing_keywords"),
        split_keywords(F.col("freebie_keywords")).alias("freebie_keywords"),
        F.lit("").alias("notes"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of LISTINGS_SQL.  Suppliers are joined while rows are narrow, parts last: a later join by part finds
    the rows where they are."""
    chosen = LISTINGS_SQL.partition("FROM lineitem")[0]
    joined = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"
    return _sql(spark, sf_dir, chosen + joined, ["lineitem", "part", "supplier"])
