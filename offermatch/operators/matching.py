"""Best catalog match per listing and the deals that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.predicates import hardware_accessory, packaging_only
from offermatch.functions.prices import accept_local
from offermatch.functions.similarity import word_set_ratio
from offermatch.functions.text import (
    default_process, extract_freebies, override_condition, tokens, words,
)
from offermatch.operators.pairs import every_part, part_of
from offermatch.operators.variants import (
    distinct_items, group_families, variant_compatible, variant_profile,
)

_ANY = "*"


def _match_words(name: str) -> Column:
    """Distinct words of the normalised text, split once per row rather than per pair."""
    return F.array_distinct(words(default_process(F.col(name))))


def match_profile(cat: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Match columns per target plus its ``anchor``: a token every compatible title contains.

    The anchor is the rarest required token, else the rarest own token.  Names made only of
    generic words that are also a family's base have none; their anchor is '*', which every
    listing carries.  There are at most as many of those as sets of generic words.
    """
    items = cat.select("ord", "item_name", "target_type")
    profile = variant_profile(families if families is not None else group_families(cat))
    needed = F.when(F.size("required_tokens") > 0, F.col("required_tokens")).otherwise(
        F.col("own_tokens")
    )
    frequency = (
        profile.select(F.explode("tokens").alias("anchor")).groupBy("anchor")
        .agg(F.count("*").alias("names"))
    )
    anchors = (
        profile.select("ord", F.explode(needed).alias("anchor"))
        .join(frequency, "anchor")
        .groupBy("ord").agg(F.min_by("anchor", F.struct("names", "anchor")).alias("anchor"))
    )
    return (
        items.join(profile.drop("item_name", "leader", "tokens"), "ord")
        .join(anchors, "ord", "left")
        .select(
            "ord", "item_name", "target_type",
            _match_words("item_name").alias("words"),
            "required_tokens", "own_tokens", "sibling_tokens",
            F.coalesce("anchor", F.lit(_ANY)).alias("anchor"),
        )
    )


def _allowed(target_type: Column) -> Column:
    """Accessory rule, from two flags that are computed once per listing."""
    return F.when(target_type == "Game", ~F.col("_packaging")).otherwise(~F.col("_accessory"))


def _with_accessory_flags(listings: DataFrame) -> DataFrame:
    return listings.withColumns({
        "_accessory": hardware_accessory(F.col("title"), F.col("description")),
        "_packaging": packaging_only(F.col("title"), F.col("description")),
    })


def best_match(listings: DataFrame, cat: DataFrame, above: float = R.BEST_MATCH_ABOVE,
               families: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """Listings that have a compatible target scoring above the threshold, with item and score.

    Distinct titles meet the targets whose anchor they contain, in an equi-join; repeated titles
    collapse before it.  Common anchors, '*' among them, and common titles are split into parts, so
    one plan serves a catalog of any size and Spark broadcasts it when its statistics allow.  Ties go
    to the earlier catalog row.  ``distinct`` says that item names are known to be unique.
    """
    profile = match_profile(cat if distinct else distinct_items(cat), families)
    key = ["title", "_accessory", "_packaging"]
    rows = _with_accessory_flags(listings)
    texts = rows.select(*key).distinct().withColumns({
        "_tokens": tokens(F.col("title")), "_words": _match_words("title"),
    })
    pairs = (
        texts.withColumn("anchor", F.explode(F.concat(F.col("_tokens"), F.array(F.lit(_ANY)))))
        .withColumn("_part", part_of(F.col("title")))
        .join(every_part(profile), ["anchor", "_part"])
        .filter(_allowed(F.col("target_type")) & variant_compatible(
            F.col("_tokens"), F.col("required_tokens"), F.col("own_tokens"),
            F.col("sibling_tokens"),
        ))
    )
    best = pairs.groupBy(*key).agg(F.max(F.struct(
        word_set_ratio(F.col("_words"), F.col("words")).alias("score"),
        (-F.col("ord")).alias("tie"), F.col("item_name").alias("item"),
    )).alias("_best"))
    spread_rows = rows.withColumn("_part", part_of(*[F.col(f"`{c}`") for c in listings.columns]))
    matched = spread_rows.join(every_part(best.filter(F.col("_best.score") > above)), [*key, "_part"])
    return matched.select(
        *listings.columns, F.col("_best.item").alias("matched_item"),
        F.col("_best.score").alias("match_score"),
    )


def local_deals(listings: DataFrame, cat: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Offers at or below the deal price of their best match, enriched for output."""
    usable = listings.filter(
        (F.coalesce("title", F.lit("")) != "") & F.col("price").isNotNull()
    )
    cat = distinct_items(cat)
    targets = cat.select(
        F.col("item_name").alias("matched_item"), "deal_price", "downsizing_keywords",
        "freebie_keywords", F.col("category").alias("reference_category"),
    )
    matched = best_match(usable, cat, families=families, distinct=True)
    flag = F.col("price_flag") if "price_flag" in listings.columns else F.lit("normal")
    final = override_condition(F.col("condition"), F.col("description"), F.col("downsizing_keywords"))
    no_freebies = F.array().cast("array<string>")
    return (
        matched.join(targets, "matched_item")
        .filter(F.col("price") <= F.col("deal_price"))
        .withColumn("_final", final)
        .select(
            *listings.columns, "matched_item", "match_score", "deal_price",
            (F.col("deal_price") - F.col("price")).alias("savings"),
            F.col("_final.condition").alias("final_condition"),
            F.col("_final.changed").alias("condition_overridden"),
            F.when(flag == "bundle_candidate", no_freebies).otherwise(
                extract_freebies(F.col("description"), F.col("freebie_keywords"))
            ).alias("bundles"),
            "reference_category",
        )
    )


def accept_local_deals(deals: DataFrame, candidates: DataFrame, cat: DataFrame,
                       reason: str = R.REASON_LOCAL) -> DataFrame:
    """Local deals that a stage-one candidate pair backs and the local gate accepts.

    ``candidates`` carries listing_id, title, item_name, price_flag and ``seq``; of repeated
    pairs the last counts.  Variant families come from the candidate targets, catalog order.
    """
    backed = candidates.groupBy("listing_id", "item_name").agg(
        F.max_by(F.struct("title", "price_flag"), F.col("seq")).alias("c")
    )
    named = candidates.select("item_name").distinct()
    profile = variant_profile(group_families(
        distinct_items(cat).join(named, "item_name", "left_semi")
    )).select(
        F.col("item_name").alias("matched_item"), "required_tokens", "own_tokens", "sibling_tokens"
    )
    backed = backed.select(
        "listing_id", F.col("item_name").alias("matched_item"),
        F.col("c.title").alias("_candidate_title"), F.col("c.price_flag").alias("_flag"),
    ).filter(~F.col("_flag").isin([*R.TRIAGE_FLAGS, "bundle_candidate"]))
    fits = variant_compatible(
        tokens(F.col("_candidate_title")), F.col("required_tokens"), F.col("own_tokens"),
        F.col("sibling_tokens"),
    )
    score = F.col("local_match_score") if "local_match_score" in deals.columns else F.col("match_score")
    kept = F.col("acceptance_reason") if "acceptance_reason" in deals.columns else F.lit(reason)
    plain = [c for c in deals.columns if c not in ("price_flag", "acceptance_reason",
                                                   "local_match_score", "audit_source")]
    return (
        deals.join(backed, ["listing_id", "matched_item"])
        .join(profile, "matched_item")
        .filter(accept_local(score, F.col("price"), F.col("deal_price"), fits))
        .select(
            *plain, F.col("_flag").alias("price_flag"), F.lit(R.LOCAL_SOURCE).alias("audit_source"),
            score.alias("local_match_score"),
            F.lit(None).cast("int").alias("model_confidence"),
            F.lit(None).cast("boolean").alias("specs_matched"),
            F.col("price").alias("offer_price"),
            F.coalesce(kept, F.lit(reason)).alias("acceptance_reason"),
        )
    )
