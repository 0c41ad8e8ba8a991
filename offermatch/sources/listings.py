"""Listing rows: typing, identity, caps, merging across sources and source diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.prices import as_double
from offermatch.functions.text import clean_string, strip_space, text_or_empty
from offermatch.session import stored

LIST_COLUMNS = ["eligible_target_names", "source_modes", "source_urls", "source_queries"]


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def coerce_listings(df: DataFrame) -> DataFrame:
    """Typed listing rows from loosely typed input; absent columns become null or blank."""
    def number(name: str, kind: str) -> Column:
        return _text(df, name).try_cast(kind).alias(name)

    flag = F.coalesce(
        F.nullif(text_or_empty(_text(df, "price_flag")), F.lit("")),
        F.nullif(text_or_empty(_text(df, "price_status")), F.lit("")), F.lit("Normal"),
    )
    extra = [c for c in LIST_COLUMNS if c in df.columns]
    return df.select(
        clean_string(_text(df, "listing_id")).alias("listing_id"),
        clean_string(_text(df, "title")).alias("title"),
        as_double(F.nullif(strip_space(_text(df, "price")), F.lit(""))).alias("price"),
        clean_string(_text(df, "condition")).alias("condition"),
        strip_space(_text(df, "description")).alias("description"),
        strip_space(_text(df, "link")).alias("link"),
        clean_string(_text(df, "seller")).alias("seller"),
        clean_string(_text(df, "category")).alias("category"),
        _text(df, "thumbnail_url").cast("string").alias("thumbnail_url"),
        number("seller_rating", "double"),
        number("seller_rating_count", "int"),
        number("like_count", "int"),
        _text(df, "location").cast("string").alias("location"),
        _text(df, "listing_timestamp").cast("string").alias("listing_timestamp"),
        clean_string(flag).alias("price_flag"),
        *extra,
    )


def listing_id(listing_id: Column, link: Column) -> Column:
    """The id, else the digits that end the link, else the link."""
    link = strip_space(link)
    return F.coalesce(
        F.nullif(strip_space(listing_id), F.lit("")),
        F.nullif(F.regexp_extract(link, r"-(\d+)/?$", 1), F.lit("")),
        link,
    )


def listing_identity(listing_id: Column, link: Column, title: Column) -> Column:
    """struct(kind, key): by id, else by link, else by case-folded title."""
    def tagged(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    own, href = clean_string(listing_id), clean_string(link)
    return (
        F.when(own != "", tagged("id", own)).when(href != "", tagged("link", href))
        .otherwise(tagged("title", F.lower(clean_string(title))))
    )


def cap_per_source(df: DataFrame, source: str = "source_ord", pos: str = "pos",
                   mode: str = "mode", rows: int = R.ITEM_SOURCE_ROWS) -> DataFrame:
    """Item-name sources keep their first page rows, category sources keep all.

    The two kinds are separated first: Spark then applies the row limit per task, before the
    shuffle, and category rows are not shuffled at all.
    """
    by_item = F.col(mode) == "Item Name"
    rank = F.row_number().over(Window.partitionBy(source).orderBy(pos))
    capped = df.filter(by_item).withColumn("_rank", rank).filter(F.col("_rank") <= rows).drop("_rank")
    return capped.unionByName(df.filter(~by_item | F.col(mode).isNull()))


def stamp_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds category, eligible targets, mode, address and query of the listing's source."""
    one = lambda c: F.array(F.col(c))
    stamps = sources.select(
        "source_ord", F.col("category").alias("category"),
        F.col("target_items").alias("eligible_target_names"),
        one("mode").alias("source_modes"), one("url").alias("source_urls"),
        F.when(F.col("query") != "", one("query")).otherwise(F.array().cast("array<string>"))
        .alias("source_queries"),
        "mode", "fetch_details", "price_ceiling",
    )
    return df.drop("category", *LIST_COLUMNS, "mode").join(stamps, "source_ord")


def _truthy(df: DataFrame, name: str) -> Column:
    kind, col = df.schema[name].dataType.typeName(), F.col(name)
    if kind == "string":
        return col.isNotNull() & (col != "")
    if kind == "boolean":
        return F.coalesce(col, F.lit(False))
    if kind in ("double", "float", "integer", "long", "short"):
        return col.isNotNull() & (col != 0)
    return col.isNotNull()


def merge_listings(df: DataFrame, order: list[str], scalars: list[str],
                   lists: list[str] = LIST_COLUMNS) -> DataFrame:
    """One row per identity.

    Scalars take the first value in source order that is neither null, blank nor zero.  List
    columns become the ordered union of their elements; elements are made distinct per identity
    before they are collected, so a listing repeated in a third of all rows stays small.
    """
    key = listing_identity(F.col("listing_id"), F.col("link"), F.col("title"))
    rows = df.withColumn("_id", key).withColumn("_at", F.struct(*order))
    picked = []
    for name in scalars:
        # Rows without a usable value come after all others, so the order moves once for a scalar.
        picked.append(F.min_by(name, F.struct((~_truthy(df, name)).alias("_blank"), "_at")).alias(name))
    merged = rows.groupBy("_id").agg(F.min("_at").alias("_first"), *picked)
    present = [c for c in lists if c in df.columns]
    if present:
        tagged = F.concat(*[
            F.transform(
                F.coalesce(c, F.array().cast("array<string>")),
                lambda x, i: F.struct(F.lit(c).alias("kind"), i.alias("i"), x.alias("x")),
            )
            for c in present
        ])
        elements = (
            rows.select("_id", "_at", F.explode(tagged).alias("e"))
            .groupBy("_id", "e.kind", "e.x").agg(F.min(F.struct("_at", "e.i")).alias("at"))
        )
        unions = elements.groupBy("_id").agg(*[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("at", "x")))),
                lambda p: p["x"],
            ).alias(c)
            for c in present
        ])
        # Written, so that their shuffles are gone when the scalars are grouped.
        merged = merged.join(stored(unions, "unions"), "_id", "left")
    empty = F.array().cast("array<string>")
    return merged.select(
        F.col("_id.kind").alias("identity_kind"), F.col("_id.key").alias("identity_key"),
        "_first.*", *scalars, *[F.coalesce(c, empty).alias(c) for c in present],
    )


def valid_detail_link(link: Column, hosts: list[str], path: str = "/p/") -> Column:
    host = F.lower(F.try_parse_url(link, F.lit("HOST")))
    return (
        F.coalesce(F.try_parse_url(link, F.lit("PROTOCOL")) == "https", F.lit(False))
        & F.coalesce(host.isin(hosts), F.lit(False))
        & F.coalesce(F.startswith(F.try_parse_url(link, F.lit("PATH")), F.lit(path)), F.lit(False))
    )


def enrich_descriptions(df: DataFrame, details: DataFrame, hosts: list[str]) -> DataFrame:
    """Fill blank descriptions from detail pages, for sources that ask for it.

    ``details`` is (identity_kind, identity_key, detail_ord, detail_description).  Only the rows
    that need a description are joined.  ``enrich_error`` marks links that may not be followed.
    """
    blank = F.coalesce("description", F.lit("")) == ""
    in_reach = (
        F.col("price_ceiling").isNull() | F.col("price").isNull()
        | (F.col("price") <= F.col("price_ceiling"))
    )
    need = F.coalesce(F.col("fetch_details") & blank & in_reach, F.lit(False))
    identity = listing_identity(F.col("listing_id"), F.col("link"), F.col("title"))
    once = details.groupBy("identity_kind", "identity_key").agg(
        F.min_by("detail_description", "detail_ord").alias("_detail")
    )
    wanting = (
        df.filter(need).withColumn("_id", identity)
        .withColumns({"identity_kind": F.col("_id.kind"), "identity_key": F.col("_id.key")})
        .join(once, ["identity_kind", "identity_key"], "left")
    )
    valid = valid_detail_link(F.col("link"), hosts)
    others = [c for c in df.columns if c != "description"]
    filled = wanting.select(
        *others,
        F.when(valid, F.coalesce("_detail", F.col("description")))
        .otherwise(F.col("description")).alias("description"),
        F.when(~valid, F.lit("invalid listing link")).alias("enrich_error"),
    )
    return filled.unionByName(
        df.filter(~need).select(
            *others, "description", F.lit(None).cast("string").alias("enrich_error")
        )
    )


def source_summary(rows: DataFrame, sources: DataFrame, rows_kept: int = R.ITEM_SOURCE_ROWS,
                   fetches: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """Per source: the request, rows fetched and retained, repeats of earlier rows, and detail requests.

    ``rows`` has source_ord, pos and the identity columns.  Repeats are counted as retained rows
    minus first sightings, which needs no ordering of a whole identity group in one task.  ``fetches``, one row
    per source, has source_ord, final_url, http_status and attempts; a source without one was not asked.
    ``details`` logs detail pages: source_ord, pos, listing_id, url, http_status, attempts and the
    description found; a page of listings asks for few of them.
    """
    fetched = rows.groupBy("source_ord").agg(F.count("*").alias("fetched_listing_count"))
    kept = cap_per_source(
        rows.join(sources.select("source_ord", "mode"), "source_ord"), rows=rows_kept
    ).withColumn("_id", listing_identity(F.col("listing_id"), F.col("link"), F.col("title")))
    retained = kept.groupBy("source_ord").agg(F.count("*").alias("retained_listing_count"))
    firsts = (
        kept.groupBy("_id").agg(F.min(F.struct("source_ord", "pos")).alias("at"))
        .groupBy(F.col("at.source_ord").alias("source_ord"))
        .agg(F.count("*").alias("_firsts"))
    )
    spark = rows.sparkSession
    if fetches is None:
        fetches = spark.createDataFrame([], "source_ord long, final_url string, http_status int, attempts int")
    if details is None:
        details = spark.createDataFrame([], "source_ord long, pos long, listing_id string, url string, http_status int, "
                                            "attempts int, description string")
    request = F.struct("pos", F.struct(
        "listing_id", "url", "http_status", "attempts",
        (F.coalesce("description", F.lit("")) != "").alias("description_available"),
    ).alias("request"))
    requests = details.groupBy("source_ord").agg(F.transform(
        F.array_sort(F.collect_list(request)), lambda r: r["request"]).alias("description_requests"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    nothing = F.array().cast(requests.schema["description_requests"].dataType)
    return (
        sources.join(fetched, "source_ord", "left").join(retained, "source_ord", "left")
        .join(firsts, "source_ord", "left").join(fetches, "source_ord", "left").join(requests, "source_ord", "left")
        .select(
            "source_ord", "mode", F.coalesce("final_url", "url").alias("url"), "category", "query", "target_items",
            "http_status", count("attempts").alias("attempts"),
            count("retained_listing_count").alias("listing_count"),
            count("fetched_listing_count").alias("fetched_listing_count"),
            count("retained_listing_count").alias("retained_listing_count"),
            (count("retained_listing_count") - count("_firsts")).alias("duplicates_removed"),
            F.coalesce("description_requests", nothing).alias("description_requests"),
        )
    )


def category_from_url(url: Column) -> Column:
    """Last path segment without its trailing ``-id``."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "-[^-]*$", "")


def flatten_categories(batches: list[DataFrame] | DataFrame) -> DataFrame:
    """Union of category batches (with ``source_url``); a listing's own category wins."""
    if isinstance(batches, DataFrame):
        batches = [batches]
    rows = batches[0]
    for batch in batches[1:]:
        rows = rows.unionByName(batch)
    return rows.withColumn("category", F.coalesce(
        F.nullif(text_or_empty(F.col("category")), F.lit("")), category_from_url(F.col("source_url"))
    ))
