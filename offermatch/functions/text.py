"""Text operators as Column expressions.

Everything here stays inside the JVM; regexes carry ``(?U)`` because offers are not ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermatch import rules as R

_NOT_WORD_TOKEN = r"[\p{L}\p{N}_']+"
_MARK = "\ue000"


NOT_SPACE = "[^" + R.SPACE[1:]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Lambda bodies are interpreted without common-subexpression elimination.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unicode_regex(pattern: str) -> str:
    return "(?U)" + pattern


def rewrite(col: Column, steps: Iterable[tuple[str, str]]) -> Column:
    """Apply ordered regex rewrites; each one sees the output of the one before."""
    for pattern, replacement in steps:
        col = F.regexp_replace(col, unicode_regex(pattern), replacement)
    return col


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def clean_string(col: Column) -> Column:
    """Collapse every run of whitespace to one space, trim, null to ''."""
    spaced = F.regexp_replace(text_or_empty(col), unicode_regex(R.SPACE + "+"), " ")
    return F.trim(spaced)


def strip_space(col: Column) -> Column:
    """Trim all Unicode whitespace at both ends; null becomes ''.

    What lies between is taken in one stride; a search for the white space at the end would try at every letter.
    """
    return F.regexp_extract(text_or_empty(col), unicode_regex(rf"(?s)\A{R.SPACE}*+(.*{NOT_SPACE})"), 1)


def is_blank(col: Column) -> Column:
    """Whether nothing is left of :func:`strip_space`; looks no further than the first other letter."""
    return ~text_or_empty(col).rlike(unicode_regex(NOT_SPACE))


def words(col: Column) -> Column:
    """Whitespace-separated words, in order, without blanks."""
    parts = F.split(text_or_empty(col), unicode_regex(R.SPACE + "+"))
    return F.filter(parts, lambda w: w != "")


def tokens(col: Column) -> Column:
    """Distinct ``[a-z0-9]+`` tokens of the lower-cased text."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit("[a-z0-9]+"), 0)
    )


def default_process(col: Column) -> Column:
    """Lower case, every non-word character to a space, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text_or_empty(col), r"[^\p{L}\p{N}_]", " ")))


def title_case(col: Column) -> Column:
    """Upper-case the first letter of each run of cased letters, lower-case the others."""
    runs = F.regexp_extract_all(
        text_or_empty(col), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0
    )
    cased = F.transform(
        runs,
        lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.right(r, F.length(r) - 1))),
    )
    return F.array_join(cased, "")


def expand_aliases(col: Column) -> Column:
    return rewrite(text_or_empty(col), [("(?i)" + p, r) for p, r in R.ALIASES])


def strip_noise(col: Column) -> Column:
    return clean_string(rewrite(text_or_empty(col), [(p, "") for p in R.NOISE]))


def redact_pii(col: Column) -> Column:
    return rewrite(text_or_empty(col), R.PERSONAL_DATA)


def redact_secrets(col: Column) -> Column:
    return rewrite(col, R.CREDENTIALS)


def sanitize_untrusted(col: Column) -> Column:
    """Drop control characters, disarm structural tags and code fences."""
    bare = F.regexp_replace(text_or_empty(col), R.CONTROL_CHARS, "")
    disarmed = F.regexp_replace(bare, unicode_regex(R.STRUCTURAL_TAGS), R.TAG_MARKER)
    return F.replace(disarmed, F.lit("```"), F.lit("'''"))


def compress_text(col: Column, max_chars: int = 250) -> Column:
    """One-line text cut to ``max_chars``, at the last space when that lies beyond 70 %."""
    flat = clean_string(col)
    head = F.left(flat, F.lit(max_chars))
    tail_gap = F.locate(" ", F.reverse(head))
    last_space = F.when(tail_gap > 0, F.lit(max_chars) - tail_gap).otherwise(F.lit(-1))
    cut = F.when(last_space > int(max_chars * 0.7), F.left(head, last_space)).otherwise(head)
    return F.when(F.length(flat) <= max_chars, flat).otherwise(
        F.concat(F.rtrim(cut, F.lit(" ,.-")), F.lit("..."))
    )


def clean_for_audit(col: Column, max_chars: int = R.AUDIT_TEXT_CHARS) -> Column:
    """Redacted, disarmed, line-wise de-cluttered text without a partial last word."""
    safe = sanitize_untrusted(redact_pii(col))
    lines = F.transform(F.split(safe, r"\r\n|[\n\r\u0085\u2028\u2029]"), strip_noise)
    joined = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    head = F.left(joined, F.lit(max_chars))
    next_char = F.substring(joined, max_chars + 1, 1)
    whole_words = F.when(
        next_char.rlike(unicode_regex(R.SPACE)), head
    ).otherwise(F.regexp_replace(head, r"(?dU)\S+$", ""))
    trimmed = F.regexp_replace(whole_words, unicode_regex(R.SPACE + r"+\z"), "")
    return F.when(F.length(joined) <= max_chars, joined).otherwise(trimmed)


def _escape_markup(col: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quotes:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    for raw, escaped in pairs:
        col = F.replace(col, F.lit(raw), F.lit(escaped))
    return col


def two_decimals(col: Column) -> Column:
    # format_number with a pattern rounds the exact binary value half-even; %.2f does not.
    return F.call_function("format_number", col, F.lit("0.00"))


def one_decimal(col: Column) -> Column:
    return F.call_function("format_number", col, F.lit("0.0"))


def audit_block(listing_id: Column, title: Column, price: Column, description: Column,
                max_chars: int = R.AUDIT_TEXT_CHARS) -> Column:
    """The escaped text block that presents one listing as passive data."""
    safe_id = _escape_markup(sanitize_untrusted(listing_id), quotes=True)
    safe_title = _escape_markup(sanitize_untrusted(redact_pii(strip_space(title))))
    safe_text = _escape_markup(clean_for_audit(description, max_chars))
    shown = F.coalesce(two_decimals(price), F.lit("0.00"))
    return F.concat(
        F.lit('<listing_untrusted_data id="'), safe_id, F.lit('">\n  <title>'), safe_title,
        F.lit("</title>\n  <price>"), shown, F.lit("</price>\n  <description>"), safe_text,
        F.lit("</description>\n</listing_untrusted_data>"),
    )


# --- keywords and negation -------------------------------------------------------------------

def split_keywords(col: Column) -> Column:
    """Comma list to trimmed lower-case phrases, blanks dropped; null gives an empty array."""
    parts = F.transform(F.split(text_or_empty(col), ","), lambda p: F.lower(strip_space(p)))
    return F.filter(parts, lambda p: p != "")


def _phrase_regex(keyword: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(keyword, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(rf"(?iU)(?<!{R.WORD})"), quoted, F.lit(rf"(?!{R.WORD})"))


def keyword_hits(description: Column, keyword: Column) -> Column:
    """How often the phrase occurs without touching a word character on either side."""
    return F.regexp_count(text_or_empty(description), _phrase_regex(keyword))


def _segments_before_hits(description: Column, keyword: Column) -> Column:
    """Text pieces that end right before each hit; concatenating the first i gives prefix i."""
    safe = F.replace(text_or_empty(description), F.lit(_MARK), F.lit(" "))
    marked = F.regexp_replace(safe, _phrase_regex(keyword), F.lit(_MARK + "$0"))
    return let(F.split(marked, _MARK), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))


def _last_tokens(prefix: Column, window: int) -> Column:
    found = F.regexp_extract_all(F.lower(prefix), F.lit(_NOT_WORD_TOKEN), 0)
    return F.slice(F.reverse(found), 1, window)


def _has_negation(prefix: Column, window: int) -> Column:
    negations = F.array(*[F.lit(w) for w in R.NEGATIONS])
    return F.arrays_overlap(_last_tokens(prefix, window), negations)


def is_negated(description: Column, keyword: Column, window: int = R.NEGATION_WINDOW) -> Column:
    """Whether a negation word is among the tokens right before the first hit."""
    before = _segments_before_hits(description, strip_space(keyword))
    first = F.get(before, F.lit(0))
    return F.coalesce(_has_negation(first, window), F.lit(False))


def has_live_keyword(description: Column, keyword: Column) -> Column:
    """Whether any hit of the phrase has no negation among the four tokens before it.

    One pass over the pieces between hits: the state keeps only the text from the last four
    tokens on, so the cost does not grow with the number of hits times the text length.
    """
    tail = rf"(?:{_NOT_WORD_TOKEN}[^\p{{L}}\p{{N}}_']*){{0,{R.NEGATION_WINDOW}}}\z"

    def step(state: Column, piece: Column) -> Column:
        return let(F.concat(state["tail"], piece), lambda prefix: F.struct(
            F.regexp_extract(prefix, tail, 0).alias("tail"),
            (state["live"] | ~_has_negation(prefix, R.NEGATION_WINDOW)).alias("live"),
        ))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("live"))
    folded = F.aggregate(
        _segments_before_hits(description, keyword), start, step, lambda s: s["live"]
    )
    # The cheap containment test spares the fold for almost every row.
    maybe = F.contains(F.lower(text_or_empty(description)), F.lower(keyword))
    return F.when(maybe, folded).otherwise(F.lit(False))


def extract_freebies(description: Column, phrases: Column) -> Column:
    """Short phrases after an enabled trigger, distinct, in first-seen order."""
    text = text_or_empty(description)
    found = []
    for trigger, pattern in R.FREEBIE_TRIGGERS:
        name = F.lit(trigger)
        enabled = F.exists(phrases, lambda p: F.contains(name, p) | F.contains(p, name))
        items = F.transform(
            F.regexp_extract_all(text, F.lit(unicode_regex(pattern)), 1),
            lambda x: F.trim(x, F.lit(" -:\t")),
        )
        short = F.filter(
            items, lambda x: (x != "") & (F.size(words(x)) <= R.FREEBIE_MAX_WORDS)
        )
        found.append(F.when(enabled, short).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*found))


def normal_condition(col: Column) -> Column:
    return F.lower(clean_string(col))


def downgraded(col: Column, otherwise: Column) -> Column:
    norm = normal_condition(col)
    branch = None
    for source, target in R.DOWNGRADES.items():
        test = norm == source
        branch = F.when(test, target) if branch is None else branch.when(test, target)
    return branch.otherwise(otherwise)


def override_condition(condition: Column, description: Column, keywords: Column) -> Column:
    """struct(condition, changed): one step down when some keyword is live in the text."""
    target = downgraded(condition, F.lit(None).cast("string"))
    changed = F.when(target.isNull(), F.lit(False)).otherwise(
        F.exists(keywords, lambda k: has_live_keyword(description, k))
    )
    return let(changed, lambda down: F.struct(
        F.when(down, target).otherwise(title_case(clean_string(condition))).alias("condition"),
        F.coalesce(down, F.lit(False)).alias("changed"),
    ))
