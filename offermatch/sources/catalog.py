"""Header-driven catalog reading, validation and the plan of source pages."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.prices import as_double, parse_sheet_price
from offermatch.functions.text import clean_string, split_keywords, strip_space


def parse_target_type(col: Column) -> Column:
    """'Hardware' or 'Game'; blank means Hardware, anything else is null (a violation)."""
    value = F.lower(strip_space(col))
    return F.when(value.isin("", "hardware"), "Hardware").when(value == "game", "Game")


def parse_bundle_flag(col: Column) -> Column:
    """TRUE/FALSE, Yes/No or 1/0; blank means false, anything else is null (a violation)."""
    value = F.lower(strip_space(col))
    return F.when(value.isin("", "false", "no", "0"), False).when(
        value.isin("true", "yes", "1"), True
    )


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV as (ord, cells), each row with as many cells as it has.

    A file is one row to its task, as quoted cells may hold line breaks.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame({"cells": list(csv.reader(io.StringIO(text, newline="")))})

    files = spark.read.text(path, wholetext=True).coalesce(1)
    return files.mapInPandas(parse, "cells array<string>").select(
        F.monotonically_increasing_id().alias("ord"), "cells"
    )


def read_catalog(cells: DataFrame) -> DataFrame:
    """Catalog rows from raw (ord, cells): the header row is found by content, columns by name.

    Short rows are padded, rows without an item name dropped.  ``violations`` lists values that
    are not allowed; such rows stay visible.
    """
    trimmed = F.transform("cells", strip_space)
    required = [h for h in R.CATALOG_HEADERS if h not in R.OPTIONAL_HEADERS]
    is_header = F.size(F.array_except(F.array(*[F.lit(h) for h in required]), trimmed)) == 0
    header = cells.filter(is_header).agg(
        F.min("ord").alias("ord"), F.min_by(trimmed, F.col("ord")).alias("names")
    ).first()
    if header["ord"] is None:
        raise ValueError("no row holds all required catalog headers")
    place = {name: i for i, name in enumerate(header["names"])}

    def cell(name: str, default: str = "") -> Column:
        if name not in place:
            return F.lit(default)
        return F.coalesce(F.get("cells", F.lit(place[name])), F.lit(""))

    kind, bundle = parse_target_type(cell("Target Type")), parse_bundle_flag(cell("Allow Bundle Check"))
    problems = F.filter(
        F.array(
            F.when(kind.isNull(), "Target Type must be Hardware or Game"),
            F.when(bundle.isNull(), "Allow Bundle Check must be TRUE/FALSE, Yes/No, or 1/0"),
        ),
        lambda v: v.isNotNull(),
    )
    return cells.filter((F.col("ord") > header["ord"]) & (strip_space(cell("Item Name")) != "")).select(
        "ord",
        cell("Item Name").alias("item_name"),
        cell("Category").alias("category"),
        cell("Search Mode", "Category").alias("search_mode"),
        parse_sheet_price(cell("Retail Price (PHP)")).alias("retail_price"),
        parse_sheet_price(cell("Deal Price (PHP)")).alias("deal_price"),
        cell("Keyword for Condition Downsizing").alias("downsizing_keywords"),
        cell("Keyword for Finding Freebies").alias("freebie_keywords"),
        cell("Notes").alias("notes"),
        kind.alias("target_type"),
        bundle.alias("allow_bundle_check"),
        problems.alias("violations"),
    )


def _either(df: DataFrame, *names: str) -> Column:
    """The first spelling that is present and not empty."""
    found = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def _keywords(df: DataFrame, *names: str) -> Column:
    arrays = [n for n in names if n in df.columns and df.schema[n].dataType.typeName() == "array"]
    if arrays:
        lowered = F.transform(F.col(f"`{arrays[0]}`"), lambda k: F.lower(clean_string(k)))
        return F.coalesce(
            F.filter(lowered, lambda k: k != ""), F.array().cast("array<string>")
        )
    return split_keywords(_either(df, *names))


def coerce_targets(df: DataFrame, mode: str = "report") -> DataFrame:
    """Typed catalog rows from either column spelling.

    A missing or zero deal price is a violation ('report') or stops the job ('failfast');
    rows without a name or with a negative price are dropped.
    """
    names = [_either(df, "Deal Price (PHP)"), _either(df, "deal_price")]
    prices = [F.nullif(as_double(n), F.lit(0.0)) for n in names]
    deal = F.coalesce(*prices)
    missing = F.concat(
        F.lit("Target '"), clean_string(_either(df, "Item Name", "item_name")),
        F.lit("' is missing required deal_price."),
    )
    if mode == "failfast":
        deal = F.coalesce(deal, F.raise_error(missing).cast("double"))
    kind = parse_target_type(_either(df, "Target Type", "target_type"))
    bundle = parse_bundle_flag(_either(df, "Allow Bundle Check", "allow_bundle_check"))
    problems = F.filter(
        F.array(
            F.when(deal.isNull(), missing),
            F.when(kind.isNull(), "Target Type must be Hardware or Game"),
            F.when(bundle.isNull(), "Allow Bundle Check must be TRUE/FALSE, Yes/No, or 1/0"),
        ),
        lambda v: v.isNotNull(),
    )
    typed = df.select(
        "ord",
        clean_string(_either(df, "Item Name", "item_name")).alias("item_name"),
        clean_string(_either(df, "Category", "category")).alias("category"),
        deal.alias("deal_price"),
        F.nullif(as_double(_either(df, "Retail Price (PHP)", "retail_price")), F.lit(0.0))
        .alias("retail_price"),
        _keywords(df, "Keyword for Condition Downsizing", "downsizing_keywords")
        .alias("downsizing_keywords"),
        _keywords(df, "Keyword for Finding Freebies", "freebie_keywords").alias("freebie_keywords"),
        strip_space(_either(df, "Notes", "notes")).alias("notes"),
        kind.alias("target_type"),
        bundle.alias("allow_bundle_check"),
        problems.alias("violations"),
    )
    return typed.filter((F.col("item_name") != "") & (F.coalesce("deal_price", F.lit(1.0)) > 0))


def category_aliases(categories: DataFrame) -> DataFrame:
    """(alias, category, url): canonical name, '&' as 'and', and the URL slug without its id."""
    slug = F.split_part(F.regexp_extract("url", "^(?:.*?/categories/)?(.*)$", 1), F.lit("/"), F.lit(1))
    bare = F.regexp_replace(slug, "-[^-]*$", "")
    names = F.array_distinct(F.array(
        F.lower("category"), F.lower(F.replace("category", F.lit("&"), F.lit("and"))), F.lower(bare)
    ))
    return (
        categories.select("ord", "category", "url", F.explode(names).alias("alias"))
        .groupBy("alias")
        .agg(F.min_by(F.struct("category", "url"), F.col("ord")).alias("c"))
        .select("alias", "c.category", "c.url")
    )


def resolve_category(df: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """Adds ``resolved_category`` and ``category_url``; null when nothing matches."""
    aliases = category_aliases(categories).select(
        F.col("alias").alias("_alias"), F.col("category").alias("resolved_category"),
        F.col("url").alias("category_url"),
    )
    return (
        df.withColumn("_alias", F.lower(clean_string(F.col(column))))
        .join(aliases, "_alias", "left").drop("_alias")
    )


def percent_encode(col: Column) -> Column:
    """RFC 3986 encoding; the built-in encodes for forms, which differs in three characters."""
    encoded = F.url_encode(col)
    for form, plain in [("+", "%20"), ("*", "%2A"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def build_search_url(item_name: Column, base_url: str) -> Column:
    """The recent-first search page of an item name; null for a blank name."""
    query = F.lower(clean_string(item_name))
    return F.when(query != "", F.concat(
        F.lit(base_url + "/search/"), percent_encode(query), F.lit(R.SEARCH_SUFFIX)
    ))


def _search_mode(col: Column) -> Column:
    mode = F.lower(clean_string(col))
    return F.when(mode.isin("", "category"), "Category").when(mode == "item name", "Item Name")


def validate_catalog(cat: DataFrame, categories: DataFrame) -> DataFrame:
    """(row_number, item_name, problem): everything that makes a plan unsafe; rows count from 2."""
    named = cat.withColumn("item_name", clean_string(F.col("item_name"))).filter("item_name <> ''")
    # First sighting per name by aggregation: a window would sort a hot name in one task.
    firsts = named.groupBy(F.lower("item_name").alias("_name")).agg(F.min("ord").alias("_first"))
    seen = named.withColumn("_name", F.lower("item_name")).join(firsts, "_name")
    mode = _search_mode(F.col("search_mode"))
    bundle = parse_bundle_flag(F.col("allow_bundle_check").cast("string"))
    checked = resolve_category(seen, "category", categories)
    problems = F.filter(
        F.array(
            F.when(F.col("ord") > F.col("_first"), "duplicate item name"),
            F.when(mode.isNull(), "invalid search mode"),
            F.when((mode == "Category") & F.col("resolved_category").isNull(), "unknown category"),
            F.when(
                bundle.isNull() | (bundle & F.col("deal_price").isNull()), "invalid bundle settings"
            ),
        ),
        lambda p: p.isNotNull(),
    )
    return checked.select(
        (F.col("ord") + 1).alias("row_number"), "item_name", F.explode(problems).alias("problem")
    )


def plan_sources(cat: DataFrame, categories: DataFrame, base_url: str) -> DataFrame:
    """One row per distinct page address, with the targets that its listings may match."""
    named = cat.withColumn("item_name", clean_string(F.col("item_name"))).filter("item_name <> ''")
    rows = resolve_category(
        named.withColumn("mode", _search_mode(F.col("search_mode"))), "category", categories
    )
    by_item = F.col("mode") == "Item Name"
    bundle = F.coalesce(parse_bundle_flag(F.col("allow_bundle_check").cast("string")), F.lit(False))
    planned = rows.select(
        "ord", "item_name", "mode",
        F.when(by_item, build_search_url(F.col("item_name"), base_url))
        .otherwise(F.col("category_url")).alias("url"),
        F.when(by_item, F.lit("")).otherwise(F.col("resolved_category")).alias("category"),
        F.when(by_item, F.col("item_name")).otherwise(F.lit("")).alias("query"),
        bundle.alias("bundle"),
        F.when(bundle, F.greatest(F.col("deal_price") * R.CEILING_RATIO, F.lit(0.0)))
        .alias("ceiling"),
    )
    first = {c: F.min_by(c, F.col("ord")).alias(c) for c in ("mode", "category", "query")}
    return planned.groupBy("url").agg(
        F.min("ord").alias("source_ord"), *first.values(),
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "item_name"))), lambda x: x["item_name"]
        ).alias("target_items"),
        F.bool_or("bundle").alias("fetch_details"),
        F.max("ceiling").alias("price_ceiling"),
    )
