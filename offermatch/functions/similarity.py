"""Similarity scorers as Column expressions.

The base is the longest common subsequence, computed bit-parallel (Hyyro 2004) as a fold over
characters.  The shorter string becomes the bit pattern, in words of 62 bits, which is what a signed
bigint adds without overflow; additions carry from word to word.  Patterns of one word, nearly all, fold
over plain numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offermatch.functions.text import let, text_or_empty, words

_BITS = 62


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def _chars(col: Column) -> Column:
    """Code points, each as a string."""
    return F.regexp_extract_all(col, F.lit("(?s)."), F.lit(0))


def _placed(letters: Column, of: Callable[[Column], Column]) -> Column:
    """Map from each different letter to ``of`` that letter."""
    distinct = F.array_distinct(letters)
    return F.map_from_arrays(distinct, F.transform(distinct, of))


def _mask(letters: Column, letter: Column) -> Column:
    """Bits of the places where at most 62 letters equal one."""
    return F.aggregate(
        F.transform(letters, lambda c, i: F.when(c == letter, _bit(i)).otherwise(_zero())),
        _zero(), lambda m, b: m.bitwiseOR(b),
    )


def _step(state: Column, mask: Column, full: Column) -> Column:
    hit = state.bitwiseAND(mask)
    return (state + hit).bitwiseOR(state - hit).bitwiseAND(full)


class _OneWord:
    """A pattern of at most 62 letters: masks and states are numbers."""

    @staticmethod
    def masks(pattern: Column) -> Column:
        return let(_chars(pattern), lambda letters: _placed(letters, lambda c: _mask(letters, c)))

    @staticmethod
    def hits(text: Column, masks: Column) -> Column:
        return F.transform(_chars(text), lambda c: F.coalesce(F.try_element_at(masks, c), _zero()))

    @staticmethod
    def lcs(hits: Column, size: Column, full: Column) -> Column:
        final = F.aggregate(hits, full, lambda state, m: F.when(m == 0, state).otherwise(_step(state, m, full)))
        return size - F.bit_count(final)

    @staticmethod
    def full(size: Column) -> Column:
        return _bit(size) - 1


class _Words:
    """A pattern of any length: masks and states are arrays of 62-bit words, lowest first."""

    @staticmethod
    def masks(pattern: Column) -> Column:
        def words_of(letters: Column, letter: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(letters), F.lit(_BITS))
            return F.transform(starts, lambda at: _mask(F.slice(letters, at, F.lit(_BITS)), letter))

        return let(_chars(pattern), lambda letters: _placed(letters, lambda c: words_of(letters, c)))

    @staticmethod
    def hits(text: Column, masks: Column) -> Column:
        return F.transform(_chars(text), lambda c: F.try_element_at(masks, c))

    @staticmethod
    def full(size: Column) -> Column:
        starts = F.sequence(F.lit(0), size - 1, F.lit(_BITS))
        return F.transform(starts, lambda at: _bit(F.least(size - at, F.lit(_BITS))) - 1)

    @staticmethod
    def lcs(hits: Column, size: Column, full: Column) -> Column:
        def add(state: Column, mask: Column) -> Column:
            """One step over all words; what a word's sum exceeds 62 bits by goes to the next word."""
            begin = F.struct(F.array().cast("array<bigint>").alias("words"), _zero().alias("carry"))

            def word(acc: Column, at: Column) -> Column:
                own = F.get(state, at)
                hit = own.bitwiseAND(F.get(mask, at))
                total = own + hit + acc["carry"]
                kept = total.bitwiseOR(own - hit).bitwiseAND(F.get(full, at))
                return F.struct(
                    F.concat(acc["words"], F.array(kept)).alias("words"),
                    F.call_function("shiftrightunsigned", total, F.lit(_BITS)).alias("carry"),
                )

            return F.aggregate(F.sequence(F.lit(0), F.size(full) - 1), begin, word)["words"]

        final = F.aggregate(hits, full, lambda state, m: F.when(m.isNull(), state).otherwise(add(state, m)))
        return size - F.aggregate(final, F.lit(0), lambda n, w: n + F.bit_count(w))


def _folded(pattern: Column, text: Column, result: Callable[[type, Column, Column], Column]) -> Column:
    """``result(kind, hits of the text's letters, full)`` for a pattern that is not empty."""
    def with_words(kind: type) -> Column:
        return let(
            F.struct(kind.masks(pattern).alias("masks"), kind.full(F.length(pattern)).alias("full")),
            lambda v: let(kind.hits(text, v["masks"]), lambda hits: result(kind, hits, v["full"])),
        )

    return F.when(F.length(pattern) <= _BITS, with_words(_OneWord)).otherwise(with_words(_Words))


def _short_and_long(a: Column, b: Column) -> Column:
    return F.struct(
        F.when(F.length(a) <= F.length(b), a).otherwise(b).alias("short"),
        F.when(F.length(a) <= F.length(b), b).otherwise(a).alias("long"),
    )


def lcs_length(a: Column, b: Column) -> Column:
    return let(
        _short_and_long(text_or_empty(a), text_or_empty(b)),
        lambda p: F.when(F.length(p["short"]) == 0, F.lit(0))
        .when(p["short"] == p["long"], F.length(p["short"]))
        .otherwise(_folded(p["short"], p["long"], lambda kind, hits, full: kind.lcs(
            hits, F.length(p["short"]), full).cast("int"))),
    )


def indel_distance(a: Column, b: Column) -> Column:
    return F.length(text_or_empty(a)) + F.length(text_or_empty(b)) - 2 * lcs_length(a, b)


def ratio(a: Column, b: Column) -> Column:
    """Normalised insert/delete similarity in percent; two empty texts are equal."""
    total = (F.length(text_or_empty(a)) + F.length(text_or_empty(b))).cast("double")
    return F.when(total == 0, F.lit(100.0)).otherwise(
        (F.lit(1.0) - indel_distance(a, b) / total) * 100.0
    )


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(F.array_join(F.array_sort(words(a)), " "), F.array_join(F.array_sort(words(b)), " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio over the shared words and the shared words plus either rest."""
    return let(
        F.struct(F.array_distinct(words(a)).alias("a"), F.array_distinct(words(b)).alias("b")),
        lambda both: word_set_ratio(both["a"], both["b"]),
    )


def word_set_ratio(left: Column, right: Column) -> Column:
    """:func:`token_set_ratio` of two arrays of distinct words."""
    return let(
        F.struct(
            F.array_intersect(left, right).alias("shared"),
            F.array_except(left, right).alias("left"),
            F.array_except(right, left).alias("right"),
        ),
        lambda parts: F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .when(
            (F.size(parts["shared"]) > 0)
            & ((F.size(parts["left"]) == 0) | (F.size(parts["right"]) == 0)),
            F.lit(100.0),
        )
        .otherwise(_rest_score(parts)),
    )


def _rest_score(parts: Column) -> Column:
    measured = F.struct(
        F.length(F.array_join(parts["shared"], " ")).alias("s"),
        F.array_join(F.array_sort(parts["left"]), " ").alias("x"),
        F.array_join(F.array_sort(parts["right"]), " ").alias("y"),
    )

    def percent(distance: Column, total: Column) -> Column:
        return F.lit(100.0) - F.lit(100.0) * distance / total

    def score(v: Column) -> Column:
        s, x, y = v["s"], F.length(v["x"]), F.length(v["y"])
        gap = F.when(s > 0, 1).otherwise(0)
        sx, sy = s + gap + x, s + gap + y
        rests = percent(indel_distance(v["x"], v["y"]), sx + sy)
        # greatest() skips nulls, so without shared words only the rests count
        return F.greatest(
            rests,
            F.when(s > 0, percent(gap + x, s + sx)),
            F.when(s > 0, percent(gap + y, s + sy)),
        )

    return let(measured, score)


def _best_window(pattern: Column, text: Column) -> Column:
    """Best ratio of the pattern with the stretches of its length of a text that is not shorter; at both ends
    of the text they are cut off.

    A stretch whose first letter the pattern lacks is no better than the one a letter further on, and one cut
    off at the text's begin whose last letter it lacks no better than the one a letter shorter: both are passed over.
    """
    size, length = F.length(pattern), F.length(text)

    def windows(kind: type, hits: Column, full: Column) -> Column:
        def best(v: Column) -> Column:
            m, n = v["m"], v["n"]

            def worth(begin: Column) -> Column:
                hit = F.get(hits, F.when(begin < 0, begin + m - 1).otherwise(begin))
                return hit.isNotNull() & (hit != 0) if kind is _OneWord else hit.isNotNull()

            def score(begin: Column) -> Column:
                start = F.greatest(begin, F.lit(0))
                return let(F.least(begin + m, n) - start, lambda width: (
                    F.lit(1.0) - (m + width - 2 * kind.lcs(F.slice(hits, start + 1, width), m, full)) / (m + width)) * 100.0)

            begins = F.filter(F.sequence(1 - m, n - 1), worth)
            return F.coalesce(F.array_max(F.transform(begins, score)), F.lit(0.0))

        return let(F.struct(size.alias("m"), length.alias("n")), best)

    return _folded(pattern, text, windows)


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter text with a stretch of the longer one; texts of one length go both ways."""
    def ways(p: Column) -> Column:
        back = F.struct(p["long"].alias("short"), p["short"].alias("long"))
        both = F.when(F.length(p["short"]) == F.length(p["long"]), F.array(p, back)).otherwise(F.array(p))
        return F.array_max(F.transform(both, lambda w: _best_window(w["short"], w["long"])))

    return let(
        _short_and_long(text_or_empty(a), text_or_empty(b)),
        lambda p: F.when(F.length(p["long"]) == 0, F.lit(100.0))
        .when(F.length(p["short"]) == 0, F.lit(0.0))
        .when(F.contains(p["long"], p["short"]), F.lit(100.0))
        .otherwise(ways(p)),
    )
