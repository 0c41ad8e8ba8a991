"""Row predicates over listing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions.text import text_or_empty, unicode_regex


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(unicode_regex(pattern))


def sale_text(title: Column, description: Column) -> Column:
    # The space also stands next to an empty part, which no word pattern can notice.
    return F.concat_ws(" ", text_or_empty(title), text_or_empty(description))


def hardware_accessory(title: Column, description: Column) -> Column:
    text = sale_text(title, description)
    return _has(text, R.ACCESSORY_TERMS) & ~_has(text, R.COMPLETE_UNIT_TERMS)


def packaging_only(title: Column, description: Column) -> Column:
    return _has(sale_text(title, description), R.PACKAGING_ONLY_TERMS)


def is_accessory_only(title: Column, description: Column, target_type: Column) -> Column:
    """A listing that clearly sells only an add-on (hardware) or only packaging (game)."""
    return F.when(target_type == "Game", packaging_only(title, description)).otherwise(
        hardware_accessory(title, description)
    )


def has_bundle_cues(title: Column, description: Column) -> Column:
    title, description = text_or_empty(title), text_or_empty(description)
    both = F.concat(title, F.lit("\n"), description)
    itemised = F.regexp_count(description, F.lit(unicode_regex(R.ITEMISED_LINE)))
    return (
        _has(both, R.BUNDLE_WORDS)
        | _has(title, R.BUNDLE_TITLE_MARKS)
        | (itemised >= R.ITEMISED_LINES_MIN)
    )


def match_text(title: Column, description: Column, cues: Column, allow_bundle: Column) -> Column:
    long_text = F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(description))
    return F.when(cues & allow_bundle, long_text).otherwise(text_or_empty(title))


def packaging_note(title: Column, description: Column) -> Column:
    text = F.concat(text_or_empty(title), F.lit("\n"), text_or_empty(description))
    return _has(text, R.PACKAGING_NOTE_TERMS)
