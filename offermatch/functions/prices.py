"""Price parsing, recovery from text, triage and acceptance rules as Column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.text import let, text_or_empty, unicode_regex


def as_double(col: Column) -> Column:
    return col.try_cast("double")


def parse_sheet_price(col: Column) -> Column:
    """First signed number after removing thousands commas, else null."""
    bare = F.replace(text_or_empty(col), F.lit(","), F.lit(""))
    return as_double(F.nullif(F.regexp_extract(bare, R.SHEET_PRICE, 0), F.lit("")))


ENTITY = r"&(?:#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]*;)"


def _entity(found: Column) -> Column:
    """The character of one entity, or the entity itself when it names none."""
    body = F.regexp_replace(found, "[&#;xX]", "")
    named = F.try_element_at(
        F.create_map(*[F.lit(v) for pair in sorted(name2codepoint.items()) for v in pair]),
        F.regexp_replace(found, "[&;]", ""),
    )
    point = (
        F.when(found.rlike("^&#[xX]"), F.conv(body, 16, 10).try_cast("long"))
        .when(F.startswith(found, F.lit("&#")), body.try_cast("long"))
        .otherwise(named.cast("long"))
    )
    usable = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return F.when(point.isNull(), found).when(usable, letter).otherwise("\ufffd")


def unescape_entities(col: Column) -> Column:
    """Decimal, hexadecimal and named character entities, each decoded once."""
    gaps, found = F.split(col, ENTITY, -1), F.regexp_extract_all(col, F.lit(ENTITY), F.lit(0))
    letters = F.concat(F.transform(found, _entity), F.array(F.lit("")))
    decoded = F.array_join(F.zip_with(gaps, letters, lambda gap, letter: F.concat(gap, letter)), "")
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def normalize_price(col: Column) -> Column:
    """Displayed price text such as ``PHP 15,000`` to a double, null when there is none."""
    text = F.replace(unescape_entities(text_or_empty(col)), F.lit(" "), F.lit(" "))
    found = F.regexp_extract(text, unicode_regex("(?i)" + R.DISPLAY_PRICE), 1)
    return as_double(F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")))


def _amounts(text: Column, pattern: str, scale: float) -> Column:
    found = F.regexp_extract_all(text, F.lit(unicode_regex("(?i)" + pattern)), 1)
    return F.transform(
        found, lambda x: as_double(F.replace(x, F.lit(","), F.lit(""))) * F.lit(scale)
    )


def _first_in_range(amounts: Column, deal_price: Column) -> Column:
    usable = F.filter(
        amounts,
        lambda v: v.isNotNull() & (
            deal_price.isNull()
            | v.between(deal_price * R.RECOVERY_LOW, deal_price * R.RECOVERY_HIGH)
        ),
    )
    return F.get(usable, F.lit(0))


def quoted_amounts(title: Column, description: Column) -> Column:
    """struct(short, marked): every ``15k``-style and every currency-marked amount in the text."""
    text = F.concat(text_or_empty(title), F.lit(" \n "), text_or_empty(description))
    return let(text, lambda t: F.struct(
        _amounts(t, R.K_PRICE, 1000.0).alias("short"),
        _amounts(t, R.CURRENCY_PRICE, 1.0).alias("marked"),
    ))


def recover_from(amounts: Column, deal_price: Column) -> Column:
    """struct(price, source): the first amount near the deal price, ``15k`` forms first."""
    picked = F.struct(
        _first_in_range(amounts["short"], deal_price).alias("short"),
        _first_in_range(amounts["marked"], deal_price).alias("marked"),
    )
    return let(picked, lambda p: F.struct(
        F.coalesce(p["short"], p["marked"]).alias("price"),
        F.when(p["short"].isNotNull(), "k_notation")
        .when(p["marked"].isNotNull(), "currency_notation").otherwise("none").alias("source"),
    ))


def recover_price(title: Column, description: Column, deal_price: Column) -> Column:
    return recover_from(quoted_amounts(title, description), deal_price)


def needs_recovery(price: Column, deal_price: Column) -> Column:
    return price.isNull() | (price < F.greatest(deal_price * R.LOW_PRICE_RATIO, F.lit(0.0))) | (
        price <= 0
    )


def triage_recovered(price: Column, recovered: Column, deal_price: Column) -> Column:
    """struct(price, flag): trust the price, take the one recovered from the text, or flag it."""
    missing = price.isNull() | (price <= 0)
    low = price.isNotNull() & (price > 0) & (price < deal_price * R.LOW_PRICE_RATIO)
    return F.when(
        (missing | low) & recovered.between(deal_price * R.LOW_PRICE_RATIO, deal_price),
        F.struct(recovered.alias("price"), F.lit("text_recovered").alias("flag")),
    ).otherwise(F.struct(
        F.when(missing, F.lit(0.0)).otherwise(price).alias("price"),
        F.when(missing, "placeholder_zero").when(low, "suspiciously_low").otherwise("normal")
        .alias("flag"),
    ))


def triage_amounts(price: Column, amounts: Column, deal_price: Column) -> Column:
    """:func:`triage_recovered` with the first amount of the text near the deal price, sought where it is needed."""
    missing = price.isNull() | (price <= 0)
    low = price.isNotNull() & (price > 0) & (price < deal_price * R.LOW_PRICE_RATIO)
    recovered = F.when(missing | low, recover_from(amounts, deal_price)["price"])
    return let(recovered, lambda r: triage_recovered(price, r, deal_price))


def triage_price(price: Column, title: Column, description: Column, deal_price: Column) -> Column:
    return triage_amounts(price, quoted_amounts(title, description), deal_price)


def is_finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) < float("inf"))


def below_ceiling(price: Column, deal_price: Column) -> Column:
    """Unknown prices pass; known ones must be finite and at most three deal prices."""
    return price.isNull() | (is_finite(price) & (price <= deal_price * R.CEILING_RATIO))


def price_eligible(effective: Column, deal_price: Column, flag: Column) -> Column:
    in_range = effective.between(deal_price * R.LOW_PRICE_RATIO, deal_price)
    return F.coalesce(in_range, F.lit(False)) | flag.isin(R.TRIAGE_FLAGS)


def accept_model(audit_item: Column, specs_matched: Column, is_accessory: Column,
                 confidence: Column, price: Column, deal_price: Column,
                 minimum: int = R.MODEL_CONFIDENCE_MIN) -> Column:
    gate = (
        is_finite(price) & (price > 0) & (price <= deal_price)
        & (F.coalesce(audit_item, F.lit("")) != "") & specs_matched & ~is_accessory
        & (confidence >= minimum)
    )
    return F.coalesce(gate, F.lit(False))


def accept_local(score: Column, price: Column, deal_price: Column, variant_ok: Column,
                 minimum: float = R.LOCAL_SCORE_MIN) -> Column:
    return F.coalesce((price <= deal_price) & variant_ok & (score >= minimum), F.lit(False))
