"""Stage one: every plausible (listing, target) pair, nothing dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.predicates import (
    hardware_accessory, has_bundle_cues, packaging_only,
)
from offermatch.functions.prices import (
    below_ceiling, price_eligible, quoted_amounts, recover_from, triage_recovered,
)
from offermatch.functions.similarity import partial_ratio, token_set_ratio
from offermatch.functions.text import expand_aliases, let, text_or_empty, tokens, words
from offermatch.operators.pairs import every_part, letter_pairs, letter_tokens, over_all_tasks, part_of
from offermatch.operators.variants import distinct_items
from offermatch.session import cut_lineage

# Share of the smaller text's letters that any pair without a common word shares whose token-set score is at
# least 50 or whose partial score is at least 65.  The least case is a stretch cut off at an end of the text.
LETTER_SHARE = 0.48


def core_tokens(target_name: Column) -> Column:
    """Alternative token sets that suffice for recall; empty for other targets."""
    branch = None
    for name, sets in R.CORE_TOKENS.items():
        value = F.array(*[F.array(*[F.lit(t) for t in s]) for s in sets])
        branch = F.when(target_name == name, value) if branch is None else branch.when(
            target_name == name, value
        )
    return branch.otherwise(F.array().cast("array<array<string>>"))


def core_token_match(text: Column, target_name: Column) -> Column:
    """Whether one of the target's token sets is contained in the alias-expanded text."""
    return let(recall_tokens(text), lambda have: holds_core(have, target_name))


def recall_tokens(text: Column) -> Column:
    """Tokens of the alias-expanded text: a column of its own where a text meets several targets."""
    return tokens(recall_text(text))


def holds_core(have: Column, target_name: Column) -> Column:
    """:func:`core_token_match` on the text's :func:`recall_tokens`."""
    return F.exists(core_tokens(target_name), lambda s: F.size(F.array_except(s, have)) == 0)


def _holds_core(recalled: Column, target_name: Column) -> Column:
    return let(tokens(recalled), lambda have: holds_core(have, target_name))


def recall_text(col: Column) -> Column:
    return F.lower(expand_aliases(col))


def eligible_pairs(listings: DataFrame, cat: DataFrame, keep: list[str]) -> DataFrame:
    """Listing x target, limited to ``eligible_target_names``; null means every target.

    Names are exploded and equi-joined.  Listings open to every target meet the catalog in parts, so that
    neither side is held whole by a task.
    """
    cat = distinct_items(cat)
    limited = F.col("eligible_target_names").isNotNull()
    named = listings.filter(limited).select(
        *keep, F.explode(F.array_distinct("eligible_target_names")).alias("item_name")
    ).join(cat, "item_name")
    opened = listings.filter(~limited).select(*keep).withColumn(
        "_part", part_of(*[F.col(f"`{c}`") for c in keep])
    ).join(every_part(cat), "_part").drop("_part")
    return named.unionByName(opened)


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Adds the letters of a text and the size that bounds what a similar text must share."""
    size = F.length(F.array_join(F.array_distinct(words(F.col(text))), " "))
    return df.withColumns({"letters": letter_tokens(F.col(text)), "size": size})


def recalled_pairs(pairs: DataFrame) -> DataFrame:
    """(_text, item_name, token_set, partial) of the pairs that recall accepts; ``pairs`` has _name too."""
    scored = pairs.withColumn("token_set", token_set_ratio(F.col("_text"), F.col("_name"))).withColumn(
        "partial", partial_ratio(F.col("_text"), F.col("_name")))
    # The one-element explode keeps the scores from being computed again for the filter.
    kept = F.filter(F.array(F.struct("token_set", "partial")), lambda s: (
        (s["token_set"] >= R.TOKEN_SET_MIN) | (s["partial"] >= R.PARTIAL_MIN)
        | _holds_core(F.col("_text"), F.col("item_name"))))
    return scored.select("_text", "item_name", F.explode(kept).alias("_s")).select("_text", "item_name", "_s.*")


def similar_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (_text, item_name, _name) that recall can accept, of ``texts`` (_text) and every name.

    Texts meet the names that they share a word with, those that they share many letters with, and those
    whose core tokens they hold, in three equi-joins.
    """
    texts = over_all_tasks(texts.distinct(), "_text")
    columns = ["_text", "item_name", "_name"]
    part = part_of(F.col("_text"))
    worded = texts.withColumns({"_token": F.explode(F.array_distinct(words(F.col("_text")))), "_part": part}).join(
        every_part(names.withColumn("_token", F.explode(F.array_distinct(words(F.col("_name")))))), ["_token", "_part"])
    core = names.withColumn("_set", F.explode(core_tokens(F.col("item_name")))).withColumn("_token", F.get("_set", F.lit(0)))
    held = texts.withColumn("_have", tokens(F.col("_text"))).withColumns({"_token": F.explode("_have"), "_part": part}).join(
        every_part(core), ["_token", "_part"]).filter(F.size(F.array_except("_set", "_have")) == 0)
    near = letter_pairs(_measured(texts, "_text"), _measured(names, "_name"), LETTER_SHARE)
    found = near.select(*columns).unionByName(worded.select(*columns)).unionByName(held.select(*columns))
    return over_all_tasks(found, *columns).distinct()


_POST = ["_title", "_description"]


def read_posts(posts: DataFrame) -> DataFrame:
    """What each distinct (_title, _description) says by itself, one row for each way of reading it.

    _accessory, _packaging and _amounts belong to the post, _scope and _text to the reading.  A post with bundle
    cues is read with its description by bundle targets only, and amounts are never taken from the
    description of a post that lists several items.
    """
    title, description = F.col("_title"), F.col("_description")
    kind = F.struct(
        hardware_accessory(title, description).alias("_accessory"),
        packaging_only(title, description).alias("_packaging"), has_bundle_cues(title, description).alias("_cues"))
    # A plain filter would go below the grouping that made the posts distinct and read every listing's text.
    flagged = posts.withColumn("_kind", F.explode(F.filter(
        F.array(kind), lambda k: ~(k["_accessory"] & k["_packaging"])))).select(*posts.columns, "_kind.*")
    scopes = F.when(
        F.col("_cues"),
        F.array(
            F.struct(title.alias("text"), F.lit("single").alias("scope")),
            F.struct(
                F.concat(title, F.lit("\n"), description).alias("text"),
                F.lit("bundle").alias("scope"),
            ),
        ),
    ).otherwise(F.array(F.struct(title.alias("text"), F.lit("all").alias("scope"))))
    amounts = quoted_amounts(title, F.when(F.col("_cues"), F.lit("")).otherwise(description)).cast(
        "struct<short:array<double>,marked:array<double>>")  # names of a lambda's struct do not outlive its plan
    return flagged.withColumns({"_amounts": amounts, "_read": F.explode(scopes)}).select(
        *posts.columns, "_accessory", "_packaging", "_amounts", F.col("_read.scope").alias("_scope"),
        recall_text(F.col("_read.text")).alias("_text"),
    )


def post_hits(reads: DataFrame, recalled: DataFrame, cat: DataFrame) -> DataFrame:
    """Posts times the targets that one of their readings recalls and that their kind allows.

    _recovered is the amount that the post quotes near the target's deal price; listings that repeat a post share it.
    """
    targets = cat.select("ord", "item_name", "target_type", "deal_price", "allow_bundle_check")
    return (
        reads.withColumn("_part", part_of(*[F.col(c) for c in _POST]))
        .join(every_part(recalled), [*(c for c in recalled.columns if c in reads.columns), "_part"])
        .join(targets, "item_name")
        .filter(
            ((F.col("_scope") == "all") | ((F.col("_scope") == "bundle") == F.col("allow_bundle_check")))
            & F.when(F.col("target_type") == "Game", ~F.col("_packaging")).otherwise(~F.col("_accessory"))
        )
        .select(*_POST, "ord", "item_name", "deal_price", "token_set", "partial",
                recover_from(F.col("_amounts"), F.col("deal_price"))["price"].alias("_recovered"),
                (F.col("_scope") == "bundle").alias("_bundle"))
    )


def find_candidates(listings: DataFrame, cat: DataFrame, keep: list[str]) -> DataFrame:
    """Candidate pairs with effective price, lexical score and price flag.

    ``listings`` needs title, description and price; ``keep`` names the listing columns to carry along.
    Distinct posts are read once, into a checkpoint that four joins use.  Eligibility comes before scores:
    a listing with ``eligible_target_names`` meets only those, in an equi-join; one without, or with null,
    meets the catalog in a similarity join.  Distinct (text, name) pairs are scored and joined back, in parts, so
    that a post shared by a third of all listings is no hot spot.
    """
    cat = cat.filter(F.trim(F.coalesce("item_name", F.lit(""))) != "")
    names = distinct_items(cat).select("item_name", recall_text(F.col("item_name")).alias("_name"))
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    limit = F.col("eligible_target_names") if "eligible_target_names" in listings.columns else F.lit(None).cast("array<string>")
    rows = listings.filter(below_ceiling(F.col("price"), cat.agg(F.max("deal_price")).scalar())).select(
        *kept, F.col("price").cast("double").alias("_price"), text_or_empty(F.col("title")).alias("_title"),
        text_or_empty(F.col("description")).alias("_description"), limit.alias("_eligible"))
    opened, limited = rows.filter("_eligible IS NULL"), rows.filter("_eligible IS NOT NULL")
    posts = rows.groupBy(*_POST).agg(F.bool_or(F.col("_eligible").isNull()).alias("_open"))
    reads = cut_lineage(read_posts(over_all_tasks(posts, *_POST)))
    any_target = recalled_pairs(similar_pairs(reads.filter("_open").select("_text"), names))
    hits = post_hits(reads.filter("_open").drop("_open"), any_target, cat)

    def spread(side: DataFrame) -> DataFrame:
        return side.drop("_eligible").withColumn("_part", part_of(*[F.col(c) for c in side.columns if c != "_eligible"]))

    pairs = spread(opened).join(every_part(hits), [*_POST, "_part"])
    if "eligible_target_names" in listings.columns:
        named = limited.withColumn("item_name", F.explode(F.array_distinct("_eligible")))
        asked = reads.drop("_open").join(named.select(*_POST, "item_name").distinct(), _POST)
        wanted = over_all_tasks(asked.select("_text", "item_name").distinct(), "_text", "item_name")
        few = post_hits(asked, recalled_pairs(wanted.join(names, "item_name")), cat)
        pairs = pairs.unionByName(spread(named).join(every_part(few), [*_POST, "item_name", "_part"]))
    pairs = pairs.filter(below_ceiling(F.col("_price"), F.col("deal_price")))
    triaged = F.when(
        F.col("_bundle"),
        F.struct(
            F.coalesce("_price", F.lit(0.0)).alias("price"),
            F.lit("bundle_candidate").alias("flag"),
        ),
    ).otherwise(triage_recovered(F.col("_price"), F.col("_recovered"), F.col("deal_price")))
    # Only comparisons are left per pair; unlike amounts they may be computed for the filter and for the output.
    usable = pairs.filter((triaged["flag"] == "bundle_candidate") | price_eligible(
        triaged["price"], F.col("deal_price"), triaged["flag"]))
    return usable.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "ord", "item_name", "deal_price",
        F.coalesce(triaged["price"], F.lit(0.0)).alias("effective_price"),
        F.greatest("token_set", "partial").alias("lexical_score"),
        triaged["flag"].alias("price_flag"),
    )


def flag_priority(flag: Column) -> Column:
    branch = None
    for name, rank in R.FLAG_PRIORITY.items():
        branch = F.when(flag == name, rank) if branch is None else branch.when(flag == name, rank)
    return branch.otherwise(0)


def annotate_listings(listings: DataFrame, candidates: DataFrame, order: list[str]) -> DataFrame:
    """Every listing once, with its highest-priority candidate flag and any recovered price.

    ``order`` fixes which of equal candidates came first (then catalog position).  The
    candidates are reduced to one row per id before the join.
    """
    best = candidates.groupBy("listing_id").agg(
        F.min_by(
            F.struct("price_flag", "effective_price"),
            F.struct((-flag_priority(F.col("price_flag"))).alias("_p"), *order, "ord"),
        ).alias("_pick"),
    )
    default = F.col("price_flag") if "price_flag" in listings.columns else F.lit(None).cast("string")
    flag = F.coalesce(F.col("_pick.price_flag"), default, F.lit("normal"))
    recovered = F.col("_pick.price_flag") == "text_recovered"
    columns = [c for c in listings.columns if c not in ("price", "price_flag")]
    return listings.join(best, "listing_id", "left").select(
        *columns,
        F.when(recovered, F.col("_pick.effective_price")).otherwise(F.col("price").cast("double"))
        .alias("price"),
        flag.alias("price_flag"),
    )


def candidate_lookup(candidates: DataFrame, seq: list[str]) -> DataFrame:
    """One candidate per (listing id, target); of repeated pairs the last in ``seq`` order.

    ``seq`` orders the rows as the leading fields of the one struct that moves, so it moves once.
    """
    keys = ["listing_id", "item_name"]
    lead = [c for c in seq if c not in keys]
    rest = [c for c in candidates.columns if c not in keys and c not in lead]
    return candidates.groupBy(*keys).agg(F.max(F.struct(*lead, *rest)).alias("_last")).select(
        *keys, *[f"_last.{c}" for c in candidates.columns if c not in keys])
