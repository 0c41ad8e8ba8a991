"""Catalog, source planning and page extraction over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermatch.functions.prices import normalize_price, parse_sheet_price
from offermatch.functions.text import clean_string, split_keywords
from offermatch.plans.registry import LISTINGS, query
from offermatch.session import stored
from offermatch.sources import bridge, catalog as C, listings as L, pages as P
from offermatch.sources.bridge import LISTING_ORDER, table

SITE = "https://market.example"

PRICE_TEXT = """concat('PHP ', CASE WHEN p_retailprice >= 1000 THEN
 concat(CAST(CAST(floor(p_retailprice / 1000) AS BIGINT) AS STRING), ',',
  lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS STRING), 3, '0'))
 ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END, '.5')"""
KIND_TEXT = """CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'hardware' WHEN 2 THEN ' GAME '
 ELSE 'Gadget' END"""
FLAG_TEXT = """CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'Yes' WHEN 2 THEN 'no' WHEN 3 THEN '1'
 ELSE 'maybe' END"""
KIND_SQL = f"""CASE lower(trim({KIND_TEXT})) WHEN '' THEN 'Hardware' WHEN 'hardware' THEN 'Hardware'
 WHEN 'game' THEN 'Game' END"""
FLAG_SQL = f"""CASE lower(trim({FLAG_TEXT})) WHEN '' THEN false WHEN 'no' THEN false
 WHEN 'yes' THEN true WHEN '1' THEN true END"""
PRICE_SQL = "floor(p_retailprice) + 0.5::DOUBLE"


@query("read_catalog", f"""
SELECT p_partkey + 2 AS ord, p_name AS item_name, p_type AS category, {PRICE_SQL} AS deal_price,
 {KIND_SQL} AS target_type, {FLAG_SQL} AS allow_bundle_check,
 CAST(({KIND_SQL}) IS NULL AS BIGINT) + CAST(({FLAG_SQL}) IS NULL AS BIGINT) AS problems
FROM part WHERE p_size % 10 <> 0""")
def read_catalog(spark: SparkSession, sf: str) -> DataFrame:
    header = ["Notes", "Item Name ", "Deal Price (PHP)", "Retail Price (PHP)", " Category",
              "Keyword for Condition Downsizing", "Keyword for Finding Freebies", "Target Type",
              "Allow Bundle Check"]
    head = spark.createDataFrame([(0, ["Price list", ""]), (1, header)], "ord long, cells array<string>")
    rows = table(spark, sf, "part").select(
        (F.col("p_partkey") + 2).alias("ord"),
        F.array(
            F.lit("x"), F.expr("CASE WHEN p_size % 10 = 0 THEN ' ' ELSE p_name END"),
            F.expr(PRICE_TEXT), F.expr(PRICE_TEXT), F.col("p_type"), F.lit("issue, defect"),
            F.lit("free"), F.expr(KIND_TEXT), F.expr(FLAG_TEXT),
        ).alias("cells"),
    )
    return C.read_catalog(head.unionByName(rows)).select(
        "ord", "item_name", "category", "deal_price", "target_type", "allow_bundle_check",
        F.size("violations").cast("long").alias("problems"),
    )


@query("parse_sheet_price", f"""
SELECT p_partkey, {PRICE_SQL} AS price, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS brand_no,
 CAST(NULL AS DOUBLE) AS nothing FROM part""")
def sheet_price(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", parse_sheet_price(F.expr(PRICE_TEXT)).alias("price"),
        parse_sheet_price(F.col("p_brand")).alias("brand_no"),
        parse_sheet_price(F.col("p_name")).alias("nothing"),
    )


@query("parse_target_type", f"SELECT p_partkey, {KIND_SQL} AS target_type FROM part")
def target_type(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", C.parse_target_type(F.expr(KIND_TEXT)).alias("target_type")
    )


@query("parse_bundle_flag", f"SELECT p_partkey, {FLAG_SQL} AS flag FROM part")
def bundle_flag(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", C.parse_bundle_flag(F.expr(FLAG_TEXT)).alias("flag")
    )


@query("parse_keywords", """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
 lambda k: lower(regexp_replace(k, '^\\s+|\\s+$', '', 'g'))), lambda k: k <> ''), '|') AS keywords
FROM documents""")
def keywords(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(split_keywords(F.col("text")), "|").alias("keywords")
    )


@query("clean_string", """
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean_string(F.col("text")).alias("cleaned"))


TARGET_PRICE = "CASE p_size % 7 WHEN 0 THEN '0' WHEN 1 THEN NULL WHEN 2 THEN '-5' ELSE '250.5' END"


@query("coerce_targets", f"""
SELECT p_partkey AS ord, p_name AS item_name,
 CASE WHEN p_size % 7 IN (0, 1) THEN NULL ELSE 250.5::DOUBLE END AS deal_price,
 CASE WHEN p_size % 7 IN (0, 1) THEN concat('Target ''', p_name, ''' is missing required deal_price.')
  ELSE '' END AS problem
FROM part WHERE p_size % 7 <> 2""")
def coerce_targets(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("  "), "p_name").alias("Item Name"),
        F.col("p_type").alias("category"), F.expr(TARGET_PRICE).alias("deal_price"),
        F.lit("a, b").alias("Keyword for Finding Freebies"),
    )
    return C.coerce_targets(raw).select(
        "ord", "item_name", "deal_price", F.array_join("violations", "; ").alias("problem")
    )


@query("coerce_listings", f"""WITH {LISTINGS}
SELECT listing_id, title, CAST(price AS DOUBLE) AS price, condition, description, seller,
 l_linenumber AS like_count, 'Normal' AS price_flag FROM listings""")
def coerce_listings(spark, sf):
    raw = bridge.listings(spark, sf).select(
        F.concat(F.lit(" "), "listing_id").alias("listing_id"),
        F.concat(F.replace("title", F.lit(" "), F.lit(" \n ")), F.lit(" ")).alias("title"),
        F.coalesce(F.col("price").cast("string"), F.lit(" ")).alias("price"),
        "condition", F.concat(F.lit("\t"), "description").alias("description"), "seller",
        F.col("l_linenumber").cast("string").alias("like_count"), F.lit("").alias("price_flag"),
    )
    return L.coerce_listings(raw).select(
        "listing_id", "title", "price", "condition", "description", "seller", "like_count",
        "price_flag",
    )


# Categories derived from the part types; one type is left out so that it stays unknown.
CATEGORIES_SQL = f"""SELECT row_number() OVER (ORDER BY p_type) AS ord, concat(p_type, ' & More') AS category,
 concat('{SITE}/categories/', lower(p_type), '-goods-', CAST(length(p_type) AS STRING), '/?sort_by=3') AS url
 FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO') AS types"""
MODE_TEXT = "CASE p_size % 6 WHEN 0 THEN 'Item  Name' WHEN 1 THEN '' WHEN 2 THEN 'Both' ELSE 'category' END"
CATEGORY_TEXT = """CASE p_size % 3 WHEN 0 THEN concat(p_type, ' & More') WHEN 1 THEN
 concat(' ', lower(p_type), ' and  more') ELSE concat(p_type, '-goods') END"""
MODE_SQL = """CASE p_size % 6 WHEN 0 THEN 'Item Name' WHEN 2 THEN NULL ELSE 'Category' END"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CATEGORIES_SQL.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))


def planned_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.concat("p_name", F.lit(" "), "p_brand").alias("item_name"),
        F.expr(MODE_TEXT).alias("search_mode"), F.expr(CATEGORY_TEXT).alias("category"),
        F.expr(FLAG_TEXT).alias("allow_bundle_check"),
        F.when(F.col("p_size") % 8 != 0, F.col("p_retailprice")).alias("deal_price"),
    )


@query("resolve_category", """
SELECT p_partkey AS ord, CASE WHEN p_type <> 'PROMO' THEN concat(p_type, ' & More') END AS resolved
FROM part""")
def resolve_category(spark, sf):
    rows = C.resolve_category(planned_catalog(spark, sf), "category", categories(spark, sf))
    return rows.select("ord", F.col("resolved_category").alias("resolved"))


SEARCH_URL_SQL = f"""concat('{SITE}/search/', url_encode(lower(concat(p_name, ' ', p_brand))),
 '?sort_by=3&t-search_query_source=ss_dropdown')"""


@query("build_search_url", f"SELECT p_partkey, {SEARCH_URL_SQL} AS url FROM part")
def search_url(spark, sf):
    name = F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", C.build_search_url(name, SITE).alias("url")
    )


@query("validate_catalog", f"""
WITH base AS (SELECT p_partkey + 1 AS row_number, concat(p_name, ' ', p_brand) AS item_name,
 row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) > 1 AS repeat, {MODE_SQL} AS mode,
 p_type = 'PROMO' AS unknown, {FLAG_SQL} AS flag, p_size % 8 = 0 AS priceless FROM part)
SELECT row_number, item_name, 'duplicate item name' AS problem FROM base WHERE repeat
UNION ALL SELECT row_number, item_name, 'invalid search mode' FROM base WHERE mode IS NULL
UNION ALL SELECT row_number, item_name, 'unknown category' FROM base WHERE mode = 'Category' AND unknown
UNION ALL SELECT row_number, item_name, 'invalid bundle settings' FROM base
 WHERE flag IS NULL OR (flag AND priceless)""")
def validate(spark, sf):
    return C.validate_catalog(planned_catalog(spark, sf), categories(spark, sf))


PLAN_SQL = f"""
cats AS ({CATEGORIES_SQL}),
planned AS (SELECT p_partkey AS ord, concat(p_name, ' ', p_brand) AS item_name, {MODE_SQL} AS mode,
 CASE WHEN p_size % 6 = 0 THEN {SEARCH_URL_SQL} ELSE c.url END AS url,
 CASE WHEN p_size % 6 = 0 THEN '' ELSE c.category END AS category,
 CASE WHEN p_size % 6 = 0 THEN concat(p_name, ' ', p_brand) ELSE '' END AS query,
 coalesce({FLAG_SQL}, false) AS bundle, p_retailprice * 3.0::DOUBLE AS ceiling
 FROM part LEFT JOIN cats c ON c.category = concat(p_type, ' & More')
 WHERE p_size % 6 <> 2 AND (p_size % 6 = 0 OR p_type <> 'PROMO'))"""


def valid_sources(spark: SparkSession, sf: str) -> DataFrame:
    cat = planned_catalog(spark, sf).withColumn("deal_price", F.col("ord") * 0 + F.coalesce(
        "deal_price", F.lit(0.0)
    ))
    part = table(spark, sf, "part")
    # Prices and bad rows are as many as there are parts: merged where they lie, not sent to the driver to be broadcast.
    priced = cat.drop("deal_price").join(
        part.select(F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("deal_price")).hint("merge"), "ord"
    )
    bad = C.validate_catalog(priced, categories(spark, sf)).filter(
        F.col("problem").isin("invalid search mode", "unknown category")
    ).select((F.col("row_number") - 1).alias("ord"))
    return C.plan_sources(priced.join(bad.hint("merge"), "ord", "left_anti"), categories(spark, sf), SITE)


@query("plan_sources", f"""WITH {PLAN_SQL}
SELECT url, min(ord) AS source_ord, arg_min(mode, ord) AS mode, arg_min(category, ord) AS category,
 arg_min(query, ord) AS query, string_agg(item_name, '|' ORDER BY ord) AS target_items,
 bool_or(bundle) AS fetch_details, max(CASE WHEN bundle THEN ceiling END) AS price_ceiling
FROM planned GROUP BY url""")
def sources(spark, sf):
    return valid_sources(spark, sf).select(
        "url", "source_ord", "mode", "category", "query",
        F.array_join("target_items", "|").alias("target_items"), "fetch_details", "price_ceiling",
    )


# --- pages -----------------------------------------------------------------------------------

def derived_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per (supplier, order block) in three shapes: JSON body, assignment, rendered HTML."""
    rows = bridge.listings(spark, sf).withColumn("pos", F.struct(*LISTING_ORDER))
    card = F.struct(
        F.col("listing_id").alias("id"), "title",
        F.struct(F.concat(F.lit("PHP "), F.concat(F.floor("price").cast("string"), F.lit(".25")))
                 .alias("amount")).alias("price"),
        F.struct("condition", F.lit("x").alias("label")).alias("belowFold"),
        F.col("description"), F.struct(F.col("seller").alias("username")).alias("user"),
    )
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rendered = F.concat(
        F.lit('<div data-testid="listing-card-'), "listing_id", F.lit('" data-listing-id="'),
        "listing_id", F.lit('"><a href="/p/x-'), "listing_id", F.lit('/"><h3>'), esc(F.col("title")),
        F.lit('</h3></a><p class="price">PHP '),
        F.coalesce(F.concat(F.floor("price").cast("string"), F.lit(".25")), F.lit("")),
        F.lit('</p><span data-testid="condition">'), "condition",
        F.lit('</span><br><p data-testid="description">'), esc(F.col("description")),
        F.lit('</p><i class="seller">'), "seller", F.lit("</i></div>"),
    )
    pages = rows.groupBy("l_suppkey", (F.col("l_orderkey") % 64).alias("block")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", card.alias("card"), rendered.alias("html")))),
            lambda x: F.struct(x["card"].alias("card"), x["html"].alias("html")),
        ).alias("cards")
    )
    body = F.to_json(F.struct(F.struct(
        F.transform("cards", lambda x: x["card"]).alias("listingCards")
    ).alias("SearchListing")))
    shape = F.col("l_suppkey") % 3
    return pages.select(
        F.concat(F.lit(SITE + "/s/"), F.col("l_suppkey").cast("string"), F.lit("/"),
                 F.col("block").cast("string")).alias("url"),
        F.when(shape == 0, F.concat(F.lit("<html><script>"), body, F.lit("</script></html>")))
        .when(shape == 1, F.concat(F.lit("<html><script>window.STATE = "), body,
                                   F.lit(";</script></html>")))
        .otherwise(F.concat(F.lit("<html><body>"),
                            F.array_join(F.transform("cards", lambda x: x["html"]), ""),
                            F.lit("</body></html>"))).alias("html"),
    )


@query("pages_to_listings", f"""WITH {LISTINGS},
typed AS (SELECT concat('{SITE}/s/', CAST(l_suppkey AS STRING), '/', CAST(l_orderkey % 64 AS STRING)) AS url,
 CASE WHEN l_suppkey % 3 = 2 THEN 'html' ELSE 'structured' END AS extract_status, listing_id,
 CASE WHEN l_suppkey % 3 = 2 THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) ELSE title END AS title,
 floor(price) + 0.25::DOUBLE AS price,
 CASE lower(condition) WHEN 'brand new' THEN 'Brand New' WHEN 'like new' THEN 'Like New' ELSE 'Well Used' END
  AS condition, description,
 CASE WHEN l_suppkey % 3 = 2 THEN concat('{SITE}/p/x-', listing_id, '/') ELSE
  concat('{SITE}/p/', trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), '-', listing_id, '/') END
  AS link, seller, {', '.join(LISTING_ORDER)} FROM listings)
SELECT url, extract_status, listing_id, title, price, condition, description, link, seller FROM (
 SELECT *, row_number() OVER (PARTITION BY url, listing_id, link, title ORDER BY {', '.join(LISTING_ORDER)})
  AS rn FROM typed) WHERE rn = 1
UNION ALL SELECT url, 'structure_error', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pages""")
def pages_to_listings(spark, sf):
    pages = derived_pages(spark, sf).unionByName(table(spark, sf, "pages").select("url", "html"))
    return P.pages_to_listings(pages, SITE).select(
        "url", "extract_status", "listing_id", "title", "price", "condition", "description", "link",
        "seller",
    )


@query("detail_description", f"""WITH {LISTINGS}
SELECT listing_id, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE trim(description) END AS description,
 CASE l_linenumber % 3 WHEN 0 THEN 'by_id' WHEN 1 THEN 'only_product' ELSE 'structure_error' END AS status
FROM listings""")
def detail_description(spark, sf):
    node = lambda i: F.to_json(F.struct(
        i.alias("id"), F.lit("Product").alias("@type"), "description"
    ))
    own, other = node(F.col("listing_id")), node(F.lit("other"))
    shape = F.col("l_linenumber") % 3
    pages = bridge.listings(spark, sf).select(
        F.concat(F.lit(SITE + "/p/"), "listing_id").alias("url"), "listing_id",
        F.concat(
            F.lit('<script type="application/json">'),
            F.when(shape == 0, F.concat(F.lit('{"a":['), other, F.lit(","), own, F.lit("]}")))
            .when(shape == 1, F.concat(F.lit('{"b":'), other, F.lit("}")))
            .otherwise(F.concat(F.lit("["), other, F.lit(","), other, F.lit("]"))),
            F.lit("</script>"),
        ).alias("html"),
    )
    return P.detail_descriptions(pages).select("listing_id", "description", "status")


SHOWN_PRICE = """CASE l_linenumber % 5 WHEN 0 THEN concat('PHP ', CAST(CAST(l_quantity AS INT) AS STRING), ',250.75')
 WHEN 1 THEN concat('₱&nbsp;', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 2 THEN 'ask me'
 WHEN 3 THEN concat('now ', CAST(CAST(l_quantity AS INT) AS STRING), '.5 only, was 99') ELSE NULL END"""


@query("normalize_price", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 5
 WHEN 0 THEN CAST(l_quantity AS INT) * 1000 + 250.75::DOUBLE WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE)
 WHEN 3 THEN CAST(l_quantity AS INT) + 0.5::DOUBLE END AS price FROM lineitem""")
def shown_price(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        normalize_price(F.expr(SHOWN_PRICE)).alias("price"),
    )


@query("nested_price", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 4 THEN NULL
 WHEN l_linenumber = 5 THEN 7.5::DOUBLE ELSE l_quantity + 0.25 END AS price FROM lineitem""")
def nested_price(spark, sf):
    """Prices in objects up to 28 deep; one without an amount, one whose first branch holds none."""
    amount = F.concat(F.lit('"PHP '), (F.col("l_quantity") + 0.25).cast("string"), F.lit('"'))
    depth = F.col("l_linenumber") * 4
    inner = F.when(F.col("l_linenumber") == 4, F.lit('"soon"')).when(
        F.col("l_linenumber") == 5, F.lit('{"amount":{"value":{}},"price":{"value":7.5}}')).otherwise(amount)
    card = F.concat(F.lit('{"price":'), F.repeat(F.lit('{"value":'), depth), inner, F.repeat(F.lit("}"), depth), F.lit("}"))
    parsed = table(spark, sf, "lineitem").withColumn("_card", F.try_parse_json(card))
    return parsed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.card_price(F.col("_card")).alias("price"))


@query("normalize_condition", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN ''
 WHEN l_returnflag = 'A' THEN 'Brand New' WHEN l_returnflag = 'N' THEN 'Like New' ELSE 'Heavily Used' END
 AS condition FROM lineitem""")
def condition(spark, sf):
    raw = F.expr("""CASE WHEN l_linenumber = 7 THEN 'mint' WHEN l_returnflag = 'A' THEN ' BRAND  new'
     WHEN l_returnflag = 'N' THEN 'Like New' ELSE 'heavily used ' END""")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", P.normalize_condition(raw).alias("condition")
    )


@query("dedup_cards", f"""WITH {LISTINGS}
SELECT l_suppkey, listing_id, title, price FROM (SELECT *, row_number() OVER (
 PARTITION BY l_suppkey, listing_id, title ORDER BY {', '.join(LISTING_ORDER)}) AS rn FROM listings) WHERE rn = 1""")
def dedup_cards(spark, sf):
    cards = bridge.listings(spark, sf).select(
        "l_suppkey", "listing_id", F.lit("").alias("link"), "title", "price",
        F.struct(*LISTING_ORDER).alias("pos"),
    )
    return P.dedup_cards(cards, "l_suppkey").select("l_suppkey", "listing_id", "title", "price")


@query("listing_link", f"""
SELECT p_partkey, concat('{SITE}/p/', trim(regexp_replace(lower(concat(p_name, ' (', p_brand, ')')),
 '[^a-z0-9]+', '-', 'g'), '-'), '-', CAST(p_partkey AS STRING), '/') AS built,
 concat('{SITE}/a/c?d=', CAST(p_partkey AS STRING)) AS relative,
 concat('{SITE}/r/', CAST(p_partkey AS STRING)) AS rooted FROM part""")
def listing_link(spark, sf):
    key, page = F.col("p_partkey").cast("string"), F.lit(SITE + "/a/b?page=2")
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf, "part").select(
        "p_partkey", P.listing_link(title, key, F.lit(""), page, SITE).alias("built"),
        P.listing_link(title, key, F.concat(F.lit("c?d="), key), page, SITE).alias("relative"),
        P.listing_link(title, key, F.concat(F.lit("/r/"), key), page, SITE).alias("rooted"),
    )


# --- listings of several sources -------------------------------------------------------------

SOURCED_SQL = f"""sourced AS (SELECT *, l_suppkey AS source_ord,
 CASE WHEN l_suppkey % 2 = 0 THEN 'Item Name' ELSE 'Category' END AS mode FROM listings)"""


def sourced(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.listings(spark, sf).withColumns({
        "source_ord": F.col("l_suppkey"),
        "mode": F.when(F.col("l_suppkey") % 2 == 0, "Item Name").otherwise("Category"),
        "pos": F.struct(*LISTING_ORDER),
    })


@query("cap_per_source", f"""WITH {LISTINGS}, {SOURCED_SQL}
SELECT source_ord, mode, listing_id, title FROM (SELECT *, row_number() OVER (PARTITION BY source_ord
 ORDER BY {', '.join(LISTING_ORDER)}) AS rn FROM sourced) WHERE rn <= 20 OR mode = 'Category'""")
def cap_per_source(spark, sf):
    return L.cap_per_source(sourced(spark, sf)).select("source_ord", "mode", "listing_id", "title")


LINK_TEXT = "CASE WHEN l_linenumber % 3 = 1 THEN concat('https://market.example/p/a-', listing_id, '/') ELSE '' END"
ID_TEXT = "CASE WHEN l_linenumber % 3 = 0 THEN listing_id ELSE '' END"


@query("listing_identity", f"""WITH {LISTINGS}
SELECT {', '.join(LISTING_ORDER)}, CASE l_linenumber % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'link' ELSE 'title' END AS kind,
 CASE l_linenumber % 3 WHEN 0 THEN listing_id WHEN 1 THEN concat('{SITE}/p/a-', listing_id, '/')
 ELSE lower(title) END AS key FROM listings""")
def identity(spark, sf):
    rows = bridge.listings(spark, sf).withColumn(
        "_i", L.listing_identity(F.expr(ID_TEXT), F.expr(LINK_TEXT), F.col("title"))
    )
    return rows.select(*LISTING_ORDER, F.col("_i.kind").alias("kind"), F.col("_i.key").alias("key"))


@query("listing_id", f"""WITH {LISTINGS}
SELECT {', '.join(LISTING_ORDER)}, CASE l_linenumber % 3 WHEN 0 THEN listing_id
 WHEN 1 THEN CAST(l_linenumber AS STRING) ELSE '' END AS id FROM listings""")
def stable_id(spark, sf):
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, L.listing_id(F.expr(ID_TEXT), F.expr(LINK_TEXT)).alias("id")
    )


@query("merge_listings", f"""WITH {LISTINGS}, ordered AS (SELECT *,
 row_number() OVER (ORDER BY {', '.join(LISTING_ORDER)}) AS n FROM listings),
scalars AS (SELECT listing_id, min(n) AS first_n,
 coalesce(arg_min(price, n) FILTER (price IS NOT NULL AND price <> 0), arg_min_null(price, n)) AS price,
 coalesce(arg_min(description, n) FILTER (description <> ''), '') AS description,
 arg_min(title, n) AS title FROM ordered GROUP BY listing_id),
urls AS (SELECT listing_id, string_agg(seller, '|' ORDER BY n) AS source_urls FROM (
 SELECT listing_id, seller, min(n) AS n FROM ordered GROUP BY ALL) GROUP BY listing_id)
SELECT listing_id, title, price, description, source_urls FROM scalars JOIN urls USING (listing_id)""")
def merge(spark, sf):
    # Written as scraped listings are: scalars and lists each read them.
    read = stored(bridge.listings(spark, sf).select(
        *LISTING_ORDER, "listing_id", "title", "price", "description", "seller"), "listings")
    rows = read.withColumns({"link": F.lit(""), "source_urls": F.array("seller")})
    merged = L.merge_listings(
        rows, LISTING_ORDER, ["listing_id", "title", "price", "description"], ["source_urls"]
    )
    return merged.select(
        "listing_id", "title", "price", "description",
        F.array_join("source_urls", "|").alias("source_urls"),
    )


def supplier_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("source_ord"),
        F.when(F.col("s_suppkey") % 2 == 0, "Item Name").otherwise("Category").alias("mode"),
        F.concat(F.lit(SITE + "/s/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("Tools").alias("category"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("query"),
        F.array(F.col("s_name"), F.lit("other")).alias("target_items"),
        (F.col("s_suppkey") % 4 == 0).alias("fetch_details"),
        F.when(F.col("s_suppkey") % 8 != 0, F.lit(300.0)).alias("price_ceiling"),
    )


@query("stamp_source", f"""WITH {LISTINGS}
SELECT listing_id, l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'Tools' END AS category,
 concat(seller, '|other') AS eligible, CASE WHEN l_suppkey % 2 = 0 THEN 'Item Name' ELSE 'Category' END AS modes,
 concat('{SITE}/s/', CAST(l_suppkey AS STRING)) AS urls,
 CASE WHEN l_suppkey % 2 = 0 THEN seller ELSE '' END AS queries FROM listings""")
def stamp(spark, sf):
    rows = sourced(spark, sf).drop("mode")
    text = lambda c, n: F.array_join(c, "|").alias(n)
    return L.stamp_source(rows, supplier_sources(spark, sf)).select(
        "listing_id", "l_partkey", "l_suppkey", "category", text("eligible_target_names", "eligible"),
        text("source_modes", "modes"), text("source_urls", "urls"), text("source_queries", "queries"),
    )


@query("enrich_descriptions", f"""WITH {LISTINGS}, flags AS (SELECT *,
 l_suppkey % 4 = 0 AND description = '' AND (l_suppkey % 8 = 0 OR price IS NULL OR price <= 300) AS need,
 l_linenumber <> 2 AS valid FROM listings)
SELECT {', '.join(LISTING_ORDER)}, CASE WHEN need AND valid THEN concat('detail of ', listing_id)
 ELSE description END AS description,
 CASE WHEN need AND NOT valid THEN 'invalid listing link' END AS enrich_error FROM flags""")
def enrich(spark, sf):
    rows = sourced(spark, sf).drop("mode").withColumn("link", F.when(
        F.col("l_linenumber") == 2, F.concat(F.lit("http://other.example/p/"), "listing_id")
    ).otherwise(F.concat(F.lit(SITE + "/p/a-"), "listing_id")))
    stamped = L.stamp_source(rows, supplier_sources(spark, sf))
    details = bridge.listings(spark, sf).select(
        F.lit("id").alias("identity_kind"), F.col("listing_id").alias("identity_key"),
        F.struct(*LISTING_ORDER).alias("detail_ord"),
        F.concat(F.lit("detail of "), "listing_id").alias("detail_description"),
    )
    return L.enrich_descriptions(stamped, details, ["market.example"]).select(
        *LISTING_ORDER, "description", "enrich_error"
    )


# Every third source was not asked; detail pages were fetched for the listings of a few lines.
DETAIL = "l_linenumber = 3 AND l_suppkey % 4 = 1"


@query("source_summary", f"""WITH {LISTINGS}, {SOURCED_SQL},
asked AS (SELECT l_suppkey AS source_ord, string_agg(listing_id || ':' || CAST(l_linenumber AS STRING) || ':' ||
 CASE WHEN description <> '' THEN 'true' ELSE 'false' END, '|' ORDER BY {', '.join(LISTING_ORDER)}) AS requests
 FROM listings WHERE {DETAIL} GROUP BY 1),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_ord
 ORDER BY {', '.join(LISTING_ORDER)}) AS rn FROM sourced) WHERE rn <= 20 OR mode = 'Category'),
seen AS (SELECT source_ord, row_number() OVER (PARTITION BY listing_id ORDER BY source_ord,
 {', '.join(LISTING_ORDER)}) > 1 AS again FROM kept)
SELECT s_suppkey AS source_ord, CASE WHEN s_suppkey % 2 = 0 THEN 'Item Name' ELSE 'Category' END AS mode,
 concat('{SITE}/s/', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 3 = 1 THEN '?final' ELSE '' END) AS url,
 CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Tools' END AS category, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS query,
 concat(s_name, '|other') AS target_items, CASE WHEN s_suppkey % 3 > 0 THEN 200 END AS http_status,
 CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 ELSE 0 END AS attempts, coalesce(k.n, 0) AS listing_count,
 coalesce(f.n, 0) AS fetched_listing_count, coalesce(k.n, 0) AS retained_listing_count, coalesce(k.d, 0) AS duplicates_removed,
 coalesce(requests, '') AS description_requests
FROM supplier LEFT JOIN (SELECT source_ord, count(*) AS n FROM sourced GROUP BY 1) f ON f.source_ord = s_suppkey
LEFT JOIN (SELECT source_ord, count(*) AS n, count_if(again) AS d FROM seen GROUP BY 1) k
 ON k.source_ord = s_suppkey LEFT JOIN asked a ON a.source_ord = s_suppkey""")
def summary(spark, sf):
    rows = sourced(spark, sf).drop("mode").withColumn("link", F.lit(""))
    sources = supplier_sources(spark, sf)
    fetches = sources.filter("source_ord % 3 > 0").select(
        "source_ord", F.when(F.col("source_ord") % 3 == 1, F.concat("url", F.lit("?final"))).otherwise(F.col("url")).alias("final_url"),
        F.lit(200).alias("http_status"), (F.col("source_ord") % 3).alias("attempts"))
    details = bridge.listings(spark, sf).filter(DETAIL).select(
        F.col("l_suppkey").alias("source_ord"), F.struct(*LISTING_ORDER).alias("pos"), "listing_id", F.lit("").alias("url"),
        F.lit(200).alias("http_status"), F.col("l_linenumber").alias("attempts"), "description")
    shown = F.transform("description_requests", lambda r: F.concat_ws(
        ":", r["listing_id"], r["attempts"].cast("string"), r["description_available"].cast("string")))
    found = L.source_summary(rows, sources, fetches=fetches, details=details)
    return found.withColumns({"description_requests": F.array_join(shown, "|"), "target_items": F.array_join("target_items", "|")})


@query("flatten_categories", f"""WITH {LISTINGS}
SELECT listing_id, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN category ELSE
 concat('cat-', lower(category)) END AS category FROM listings""")
def flatten(spark, sf):
    rows = bridge.listings(spark, sf).withColumns({
        "source_url": F.concat(F.lit(SITE + "/categories/cat-"), F.lower("category"), F.lit("-884/?sort_by=3")),
        "category": F.when(F.col("l_linenumber") % 2 == 0, F.col("category")).otherwise(""),
    })
    odd, even = (rows.filter(F.col("l_suppkey") % 2 == r) for r in (1, 0))
    return L.flatten_categories([odd, even]).select("listing_id", "l_partkey", "category")
