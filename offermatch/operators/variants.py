"""Variant families of similarly named catalog items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.similarity import ratio
from offermatch.functions.text import tokens, words
from offermatch.operators.pairs import letter_pairs, letter_tokens
from offermatch.session import cut_lineage


def distinct_items(cat: DataFrame) -> DataFrame:
    """One row per item name: the position of the first, the values of the last."""
    rest = [c for c in cat.columns if c not in ("ord", "item_name")]
    named = cat.filter(F.trim(F.coalesce("item_name", F.lit(""))) != "")
    last = F.max_by(F.struct(*rest), F.col("ord"))
    return (
        named.groupBy("item_name").agg(F.min("ord").alias("ord"), last.alias("row"))
        .select("ord", "item_name", "row.*")
    )


def family_edges(items: DataFrame, threshold: float = R.FAMILY_MIN) -> DataFrame:
    """(earlier, later) catalog positions whose sorted-token ratio reaches the bound.

    A ratio of r needs r hundredths of the shorter name's letters in common, so the pairs come from a
    similarity join on letters, for a catalog of any size.
    """
    named = items.select("ord", F.array_join(F.array_sort(words(F.lower("item_name"))), " ").alias("sorted"))
    measured = named.withColumns({"letters": letter_tokens(F.col("sorted")), "size": F.length("sorted")})
    other = measured.withColumnsRenamed({"ord": "ord2", "sorted": "sorted2"})
    pairs = letter_pairs(measured, other, threshold / 100).filter("ord < ord2")
    return pairs.filter(ratio(F.col("sorted"), F.col("sorted2")) >= threshold).select(
        F.col("ord").alias("earlier"), F.col("ord2").alias("later"))


def claimed_names(edges: DataFrame) -> DataFrame:
    """(ord) of the names that do not lead a family.

    A name leads once no earlier neighbour is open; its later neighbours are claimed.  Each round decides
    every name without an open earlier neighbour, and only edges between open names go on.
    """
    claimed = None
    frontier = cut_lineage(edges.select("earlier", "later"))
    while frontier.take(1):
        waiting = frontier.select(F.col("later").alias("earlier")).distinct().withColumn("waits", F.lit(True))
        marked = frontier.join(waiting, "earlier", "left")
        taken = marked.filter("waits IS NULL").select("later").distinct()
        decided = cut_lineage(
            marked.join(taken.withColumn("taken", F.lit(True)), "later", "left")
            .join(taken.select(F.col("later").alias("earlier"), F.lit(True).alias("gone")), "earlier", "left")
        )
        found = decided.filter("waits IS NULL").select(F.col("later").alias("ord")).distinct()
        claimed = found if claimed is None else claimed.unionByName(found)
        frontier = decided.filter("waits AND taken IS NULL AND gone IS NULL").select("earlier", "later")
    return edges.select(F.col("later").alias("ord")).limit(0) if claimed is None else claimed


def group_families(cat: DataFrame, threshold: float = R.FAMILY_MIN) -> DataFrame:
    """(ord, item_name, leader): in catalog order an unclaimed name claims all similar later ones."""
    named = cat.filter(F.trim(F.coalesce("item_name", F.lit(""))) != "")
    items = named.groupBy("item_name").agg(F.min("ord").alias("ord"))
    edges = cut_lineage(family_edges(items, threshold))
    claimed = claimed_names(edges)
    followed = (
        edges.join(claimed.select(F.col("ord").alias("earlier")), "earlier", "left_anti")
        .join(claimed.select(F.col("ord").alias("later")), "later", "left_semi")
        .groupBy(F.col("later").alias("ord")).agg(F.min("earlier").alias("leader"))
    )
    return items.join(followed, "ord", "left").select("ord", "item_name", F.coalesce("leader", "ord").alias("leader"))


def variant_tokens(families: DataFrame) -> DataFrame:
    """Own tokens of each name: its tokens minus those that the whole family shares."""
    named = families.select("ord", "item_name", "leader", tokens(F.col("item_name")).alias("tokens"))
    sizes = named.groupBy("leader").agg(F.count("*").alias("members"))
    shared = (
        named.select("leader", F.explode("tokens").alias("token"))
        .groupBy("leader", "token").agg(F.count("*").alias("holders"))
        .join(sizes, "leader")
        .filter(F.col("holders") == F.col("members"))
        .groupBy("leader").agg(F.collect_set("token").alias("shared"))
    )
    own = F.array_except("tokens", F.coalesce("shared", F.array().cast("array<string>")))
    return named.join(shared, "leader", "left").select(
        "ord", "item_name", "leader", "tokens", F.array_sort(own).alias("own_tokens")
    )


def variant_profile(families: DataFrame) -> DataFrame:
    """Everything the compatibility test needs, one row per name."""
    own = variant_tokens(families)
    pooled = own.groupBy("leader").agg(
        F.array_distinct(F.flatten(F.collect_set("own_tokens"))).alias("pool")
    )
    generic = F.array(*[F.lit(t) for t in R.GENERIC_TOKENS])
    return own.join(pooled, "leader").select(
        "ord", "item_name", "leader", "tokens", "own_tokens",
        F.array_sort(F.array_except("pool", "own_tokens")).alias("sibling_tokens"),
        F.array_sort(F.array_except("tokens", generic)).alias("required_tokens"),
    )


def variant_compatible(title_tokens: Column, required: Column, own: Column,
                       siblings: Column) -> Column:
    """All required and own tokens present, no token that only a sibling has."""
    def inside(wanted: Column) -> Column:
        return F.size(F.array_except(wanted, title_tokens)) == 0

    return inside(required) & inside(own) & ~F.arrays_overlap(title_tokens, siblings)
