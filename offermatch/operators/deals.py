"""From judgements and candidates to deal rows: verification, acceptance, assembly, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.predicates import packaging_note
from offermatch.functions.prices import accept_model, as_double, is_finite
from offermatch.functions.text import (
    clean_for_audit, clean_string, downgraded, expand_aliases, let, override_condition,
    one_decimal, strip_space, text_or_empty, two_decimals, unicode_regex,
)
from offermatch.operators.audits import _STRINGS
from offermatch.operators.candidates import candidate_lookup
from offermatch.operators.pairs import likely_among
from offermatch.session import stored

_WORDS = rf"{R.WORD}+"


def _word_set(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(expand_aliases(text)), F.lit(_WORDS), 0)
    )


def _evidence_lines(description: Column, evidence: Column) -> Column:
    """Cleaned description lines that contain the quote between boundaries."""
    quoted = F.concat(
        F.lit(rf"(?U)(?<!{R.WORD})\Q"), F.replace(evidence, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
        F.lit(r"\E(?![\p{L}\p{N}_.,])"),
    )
    lines = F.transform(F.split(clean_for_audit(description), "\n"), clean_string)
    return F.filter(lines, lambda line: F.rlike(line, quoted))


def _asking_prices(evidence: Column, target_words: Column) -> Column:
    """Amounts in the quote, without bare model numbers of the target name."""
    def extract(group: int) -> Column:
        return F.regexp_extract_all(evidence, F.lit(unicode_regex(R.EVIDENCE_AMOUNT)), group)

    amounts = F.transform(
        F.arrays_zip(extract(1).alias("n"), extract(2).alias("k")),
        lambda a: as_double(F.replace(a["n"], F.lit(","), F.lit("")))
        * F.when(a["k"] != "", 1000.0).otherwise(1.0),
    )
    numbers = F.transform(
        F.filter(target_words, lambda w: w.rlike(r"^\p{Nd}+$")), lambda w: as_double(w)
    )
    return F.filter(amounts, lambda a: ~F.array_contains(numbers, a))


def verified_price(is_bundle: Column, effective: Column, listing_price: Column, title: Column,
                   description: Column, item_name: Column, deal_price: Column, allow: Column,
                   available: Column, price: Column, evidence: Column) -> Column:
    """The price a judgement may be accepted at; null when a bundle's quote does not hold.

    A bundle needs a current, separate asking price: quoted on one line of the description, with
    all target words, no stale or conditional wording, and exactly the one claimed amount.
    """
    quote = clean_string(evidence)
    ignored = F.array(*[F.lit(w) for w in R.EVIDENCE_IGNORED])
    basic = (
        allow & available & is_finite(price) & (price > 0) & (price <= deal_price)
        & (text_or_empty(evidence) != "")
        & (listing_price.isNull() | (
            is_finite(listing_price) & (listing_price <= deal_price * R.CEILING_RATIO)
        ))
    )
    post = F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(description))
    splittable = ~post.rlike(unicode_regex(R.NO_SPLIT_TERMS))

    def backed(parts: Column) -> Column:
        lines, words = parts["lines"], parts["words"]
        current = ~F.array_join(lines, "\n").rlike(unicode_regex(R.STALE_PRICE_TERMS))
        named = (F.size(words) > 0) & (F.size(F.array_except(words, _word_set(quote))) == 0)
        return (
            (F.size(lines) > 0) & current & named
            & (_asking_prices(quote, words) == F.array(price))
        )

    parts = F.struct(
        _evidence_lines(description, quote).alias("lines"),
        F.array_except(_word_set(item_name), ignored).alias("words"),
    )
    holds = F.coalesce(basic, F.lit(False)) & F.coalesce(splittable, F.lit(False))
    return F.when(~is_bundle, effective).otherwise(
        F.when(holds, F.when(let(parts, backed), price.cast("double")))
    )


def condition_after_audit(condition: Column, title: Column, description: Column,
                          target_type: Column, keywords: Column, downgrade: Column,
                          issues: Column) -> Column:
    """struct(condition, changed): text clues first, then the judgement's downgrade.

    For games, packaging remarks are no defect; ``changed`` after a judgement's downgrade
    compares with the raw condition text.
    """
    game = target_type == "Game"
    remark = unicode_regex(R.PACKAGING_NOTE_TERMS)
    read = F.when(game, F.regexp_replace(text_or_empty(description), remark, "")).otherwise(
        text_or_empty(description)
    )
    only_packaging = game & packaging_note(title, description) & F.forall(
        issues, lambda i: i.rlike(remark)
    )

    def decide(local: Column) -> Column:
        stepped = downgraded(condition, local["condition"])
        return F.when(
            downgrade & ~local["changed"] & ~only_packaging,
            F.struct(stepped.alias("condition"), (stepped != condition).alias("changed")),
        ).otherwise(local)

    return let(override_condition(condition, read, keywords), decide)


def accept_audited(audits: DataFrame, candidates: DataFrame, cat: DataFrame,
                   audit_order: list[str]) -> DataFrame:
    """Accepted judgements joined with their candidate and target, one per listing.

    ``candidates`` carries the listing columns, item_name, effective_price, price_flag and seq.  Judgements that no price
    makes acceptable go first; what is left is written, and candidates that it does not name are not moved.
    """
    any_price = F.lit(1.0)
    audits = stored(audits.filter(F.col("matched_item").isNotNull() & accept_model(
        F.col("matched_item"), F.col("specs_matched"), F.col("is_accessory"), F.col("confidence"), any_price, any_price,
    )), "acceptable")
    named = likely_among(candidates, audits.withColumnRenamed("matched_item", "item_name"), "listing_id", "item_name")
    picked = candidate_lookup(named, ["seq"]).withColumnRenamed("item_name", "matched_item")
    picked = picked.filter(~F.col("price_flag").isin(R.TRIAGE_FLAGS))
    targets = cat.select(
        F.col("item_name").alias("matched_item"), F.col("deal_price").alias("target_deal_price"),
        "retail_price", "target_type", "allow_bundle_check", "downsizing_keywords",
    )
    joined = (
        audits.join(picked.drop("deal_price", "ord"), ["listing_id", "matched_item"])
        .join(targets, "matched_item")
    )
    price = verified_price(
        F.col("is_bundle"), F.col("effective_price"), F.col("price"), F.col("title"),
        F.col("description"), F.col("matched_item"), F.col("target_deal_price"),
        F.col("allow_bundle_check"), F.col("separately_available"), F.col("individual_price"),
        F.col("price_evidence"),
    )
    gate = F.filter(F.array(price), lambda p: p.isNotNull() & accept_model(
        F.col("matched_item"), F.col("specs_matched"), F.col("is_accessory"),
        F.col("confidence"), p, F.col("target_deal_price"),
    ))
    passed = joined.withColumn("verified_price", F.explode(gate)).withColumnRenamed(
        "target_deal_price", "deal_price"
    )
    rest = [c for c in passed.columns if c != "listing_id"]
    return passed.groupBy("listing_id").agg(
        F.min_by(F.struct(*rest), F.struct(*audit_order)).alias("_a")
    ).select("listing_id", "_a.*")


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def build_deals(accepted: DataFrame) -> DataFrame:
    """The full deal record of accepted judgements, with provenance kept apart from scores."""
    bundle = F.col("is_bundle")
    none = F.array().cast(_STRINGS)
    note = (F.col("target_type") == "Game") & packaging_note(F.col("title"), F.col("description"))
    final = condition_after_audit(
        F.col("condition"), F.col("title"), F.col("description"), F.col("target_type"),
        F.col("downsizing_keywords"), F.col("downgrade_condition"), F.col("issues"),
    )
    before, after = R.REASON_SPLIT.replace("%%", "%").split("%s")
    shown = two_decimals(F.coalesce("price", F.lit(0.0)).cast("double"))
    freebies = F.when(bundle, none).otherwise(F.col("freebies"))
    return accepted.withColumn("_final", F.explode(F.array(final))).select(
        "listing_id", "title",
        F.col("verified_price").alias("offer_price"), "matched_item", "deal_price",
        (F.col("deal_price") - F.col("verified_price")).alias("savings"),
        _or_null(accepted, "link", "string"), _or_null(accepted, "seller", "string"),
        _or_null(accepted, "category", "string"),
        F.col("condition").alias("original_condition"),
        F.col("_final.condition").alias("final_condition"),
        F.col("_final.changed").alias("condition_overridden"),
        freebies.alias("bundles"), freebies.alias("freebies"),
        F.array_distinct(F.concat(
            "issues", F.when(note, F.array(F.lit(R.PACKAGING_NOTE))).otherwise(none)
        )).alias("issues"),
        "retail_price",
        _or_null(accepted, "thumbnail_url", "string"), _or_null(accepted, "seller_rating", "double"),
        _or_null(accepted, "seller_rating_count", "int"), _or_null(accepted, "like_count", "int"),
        _or_null(accepted, "location", "string"), _or_null(accepted, "listing_timestamp", "string"),
        "price_flag", F.lit(R.MODEL_SOURCE).alias("audit_source"),
        F.col("confidence").cast("int").alias("model_confidence"), "specs_matched",
        F.lit(None).cast("double").alias("local_match_score"),
        F.when(bundle, F.concat(F.lit(before), shown, F.lit(after)))
        .otherwise(R.REASON_MODEL).alias("acceptance_reason"),
        badge(F.lit(R.MODEL_SOURCE), F.col("confidence"), F.col("specs_matched"),
              F.lit(None).cast("double")).alias("match_score"),
        F.col("verified_price").alias("price"), F.col("listing_id").alias("id"),
        _or_null(accepted, "category", "string").alias("reference_category"),
        F.col("price").alias("original_listing_price"), "is_bundle",
        F.when(bundle, F.col("individual_price")).alias("individual_price"),
        F.when(bundle, F.col("price_evidence")).alias("price_evidence"),
    )


def badge(source: Column, confidence: Column, specs_matched: Column, score: Column) -> Column:
    """Display text that never mixes model confidence with lexical score."""
    status = F.when(specs_matched, "Specs Matched").otherwise("Specs Warning")
    model = F.concat(F.lit(R.MODEL_LABEL + " "), confidence.cast("string"), F.lit("% ("), status,
                     F.lit(")"))
    local = F.concat(F.lit("Local Match "), one_decimal(score), F.lit("% (Lexical)"))
    return F.when(source == R.MODEL_SOURCE, model).otherwise(local)


def deal_violations(deals: DataFrame) -> DataFrame:
    """Adds ``violations`` of the source-specific rules; mirrors bundles and freebies."""
    model, local = F.col("audit_source") == R.MODEL_SOURCE, F.col("audit_source") == R.LOCAL_SOURCE
    confidence, score = F.col("model_confidence"), F.col("local_match_score")
    problems = F.filter(
        F.array(
            F.when(model & (confidence.isNull() | F.col("specs_matched").isNull()),
                   "model deal must define confidence and specs_matched"),
            F.when(model & ~confidence.between(0, 100), "model confidence: outside 0 to 100"),
            F.when(local & score.isNull(), "local deal must define local_match_score"),
            F.when(local & ~score.between(0.0, 100.0), "local_match_score out of range [0.0, 100.0]"),
        ),
        lambda v: v.isNotNull(),
    )
    empty = F.array().cast(_STRINGS)
    bundles, freebies = F.coalesce("bundles", empty), F.coalesce("freebies", empty)
    return deals.withColumns({
        "bundles": F.when(F.size(bundles) > 0, bundles).otherwise(freebies),
        "freebies": F.when(F.size(freebies) > 0, freebies).otherwise(bundles),
        "violations": problems,
    })


def _text_list(df: DataFrame, *names: str) -> Column:
    """Arrays or comma strings as trimmed string arrays; the first non-empty spelling."""
    found = []
    for name in names:
        if name not in df.columns:
            continue
        raw = F.col(name)
        if df.schema[name].dataType.typeName() != "array":
            raw = F.split(text_or_empty(raw), ",")
        items = F.filter(F.transform(raw, strip_space), lambda x: x != "")
        found.append(F.when(F.size(items) > 0, items))
    return F.coalesce(*found, F.array().cast(_STRINGS))


def deal_from_record(df: DataFrame) -> DataFrame:
    """Deal rows from loosely named records; comma strings become lists."""
    def either(*names: str, kind: str = "string") -> Column:
        found = [F.col(n) for n in names if n in df.columns]
        if kind == "string":
            found = [F.nullif(clean_string(c), F.lit("")) for c in found]
            return F.coalesce(*found, F.lit(""))
        return F.coalesce(*[c.try_cast(kind) for c in found], F.lit(None).cast(kind))

    def raw(name: str, kind: str = "string") -> Column:
        return either(name, kind=kind) if kind != "string" else (
            F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        )

    freebies = _text_list(df, "freebies", "bundles")
    return df.select(
        either("listing_id", "id").alias("listing_id"), either("title").alias("title"),
        either("price", "offer_price", kind="double").alias("offer_price"),
        either("matched_item").alias("matched_item"),
        F.coalesce(either("deal_price", kind="double"), F.lit(0.0)).alias("deal_price"),
        F.coalesce(either("savings", kind="double"), F.lit(0.0)).alias("savings"),
        strip_space(raw("link")).alias("link"), either("seller").alias("seller"),
        either("category", "reference_category").alias("category"),
        either("original_condition", "condition").alias("original_condition"),
        either("final_condition", "condition").alias("final_condition"),
        F.coalesce(either("condition_overridden", kind="boolean"), F.lit(False))
        .alias("condition_overridden"),
        freebies.alias("bundles"), freebies.alias("freebies"),
        _text_list(df, "issues").alias("issues"),
        raw("retail_price", "double").alias("retail_price"),
        raw("thumbnail_url").alias("thumbnail_url"),
        raw("seller_rating", "double").alias("seller_rating"),
        raw("seller_rating_count", "int").alias("seller_rating_count"),
        raw("like_count", "int").alias("like_count"), raw("location").alias("location"),
        raw("listing_timestamp").alias("listing_timestamp"),
        F.coalesce(F.nullif(either("price_flag", "price_status"), F.lit("")), F.lit("Normal"))
        .alias("price_flag"),
        F.coalesce(raw("audit_source"), F.lit(R.MODEL_SOURCE)).alias("audit_source"),
        raw("model_confidence", "int").alias("model_confidence"),
        raw("specs_matched", "boolean").alias("specs_matched"),
        raw("local_match_score", "double").alias("local_match_score"),
        text_or_empty(raw("acceptance_reason")).alias("acceptance_reason"),
    )
