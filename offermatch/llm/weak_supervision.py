"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies (operator 5).

The features and votes are Column expressions over whole texts.  Votes are counted by pattern; with eight
rules there are at most 3**8 patterns whatever the number of documents.  Expectation-maximisation finds
how often each rule votes good, votes bad or abstains on good and on bad documents, which is its accuracy
on either kind.  It runs as Spark aggregations over those patterns, one row of sums coming back each time,
and the posterior probability of good quality decides in place of having to pass every rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch.functions.text import let
from offermatch.llm.common import WHITE, WORD, stored

WINDOW = 8
ROUNDS = 20
PRIOR = 0.7  # where EM starts: the share of good documents, and votes (bad, abstain, good) on either kind
ON_GOOD, ON_BAD = (0.02, 0.6, 0.38), (0.4, 0.35, 0.25)
# Bounds on accuracies, without which EM may call one kind of junk good: a rule that votes bad on more
# than one good document in a hundred, or on fewer than one bad one in ten, is held to that.
FALSE_ALARMS, HITS = 0.01, 0.1
THRESHOLD = 0.5
RULES = ["symbols", "shouting", "capitals", "lines", "repeats", "lengths", "variety", "endings"]


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.

    Hashes of pairs are paired to hashes of four and of eight words; equal ones become neighbours by
    sorting, and the windows' starts, in order, give the words they cover.
    """

    def pair(hashes: Column, apart: int) -> Column:
        # Bound by a lambda, hashes are computed once; named three times they would be three times at each level.
        return let(hashes, lambda found: F.zip_with(
            found, F.slice(found, F.lit(apart + 1), F.size(found)), lambda a, b: F.xxhash64(a, b)))

    def cover(windows: Column) -> Column:
        numbered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = F.element_at(F.transform(F.array(numbered), lambda s: F.flatten(F.zip_with(
            s, F.slice(s, F.lit(2), F.size(s)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))), 1)
        starts = F.array_sort(F.array_distinct(twins))
        return F.element_at(F.transform(F.array(starts), lambda s: F.aggregate(
            F.zip_with(s, F.slice(s, F.lit(2), F.size(s)),
                       lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, n: total + n)), 1)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    eights = F.slice(pair(pair(pair(hashed, 1), 2), 4), F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))
    bound = F.transform(F.array(eights), lambda e: F.when(F.size(F.array_distinct(e)) < F.size(e), cover(e)))
    return F.coalesce(F.element_at(bound, 1), F.lit(0)).cast("long")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that the rules look at; a null text has no words."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    split = source.withColumn("words", F.filter(F.split("t", f"[{WHITE}]+"), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split("t", "\n"), lambda line: line.rlike(WORD)))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    n_words = F.size("words").cast("long")
    return split.select(
        "doc_id", n_words.alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(f"[{WHITE}]"))).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), count("[!?]").alias("n_marks"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("lines", lambda line: line.rlike(rf"[.!?][{WHITE}]*$"))).cast("long").alias("n_ended"))


def votes(f: DataFrame) -> DataFrame:
    """One column for each rule: 1 good, -1 bad, 0 abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def rule(name: str, bad: Column, good: Column | None = None) -> Column:
        vote = F.when(n == 0, -1).when(bad, -1)
        return (vote if good is None else vote.when(good, 1)).otherwise(0).alias(f"vote_{name}")

    return f.select(
        "*",
        rule("symbols", 10 * F.col("n_symbols") > n),
        rule("shouting", 2 * F.col("n_marks") > n),
        rule("capitals", 10 * F.col("n_capitals") > 4 * chars),
        rule("lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 4 * F.col("n_lines"))),
        rule("repeats", 100 * F.col("n_repeat_words") > 25 * n),
        rule("lengths", (chars > 12 * n) | (2 * chars < 5 * n), (chars >= 3 * n) & (chars <= 8 * n)),
        rule("variety", (n >= 50) & (10 * F.col("n_distinct") < 3 * n), 2 * F.col("n_distinct") >= n),
        rule("endings", (F.col("n_lines") >= 3) & (10 * F.col("n_ended") < 3 * F.col("n_lines")), 10 * F.col("n_ended") >= 8 * F.col("n_lines")))


class Model(NamedTuple):
    prior: float
    on_good: list[tuple[float, float, float]]  # for each rule: how often it votes bad, abstains, votes good
    on_bad: list[tuple[float, float, float]]

    def accuracies(self) -> dict[str, tuple[float | None, float | None]]:
        """Of each rule: share of right votes among its votes on good and on bad documents."""
        share = lambda right, wrong: right / (right + wrong) if right + wrong else None
        return {r: (share(g[2], g[0]), share(b[0], b[2])) for r, g, b in zip(RULES, self.on_good, self.on_bad)}


def posterior(model: Model) -> Column:
    """Probability of good quality, given the votes that were cast.

    Abstentions are left out of the likelihood, here as in the E-step: most rules abstain on almost every
    document, and counted as evidence for good those would outvote the one rule that sees what is wrong.
    The bounds of ``likeliest`` see to it that a vote never counts for the other side.
    """
    log_odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, good, bad in zip(RULES, model.on_good, model.on_bad):
        vote = F.col(f"vote_{name}")
        log_odds += F.when(vote == -1, math.log(good[0] / bad[0])).when(vote == 1, math.log(good[2] / bad[2])).otherwise(0.0)
    return 1 / (1 + F.exp(-log_odds))


def likeliest(good: list[float], bad: list[float]) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """Shares of (bad, abstain, good) votes on good and on bad documents, from their expected counts.

    The likeliest ones that sum to 1 within the bounds: where a bound holds a share, the others keep their
    proportion in what is left; where more bad documents than good ones got good votes, both get the
    share of all.
    """
    def shares(counts: list[float], clamp: Callable[[float], float]) -> tuple[float, float, float]:
        against, silent, favour = (c / sum(counts) for c in counts)
        held = clamp(against)
        rest = (1 - held) / (silent + favour)
        return held, silent * rest, favour * rest

    on_good = shares(good, lambda share: min(share, FALSE_ALARMS))
    on_bad = shares(bad, lambda share: min(max(share, HITS), 1 - FALSE_ALARMS))
    if on_good[2] < on_bad[2]:
        both = (on_good[2] * sum(good) + on_bad[2] * sum(bad)) / (sum(good) + sum(bad))
        on_good, on_bad = ((held, 1 - held - both, both) for held in (on_good[0], on_bad[0]))
    return on_good, on_bad


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> Model:
    """The share of good documents and the rules' behaviour, by EM; an empty table leaves the start."""
    columns = [f"vote_{r}" for r in RULES]
    patterns = stored(voted.groupBy(*columns).agg(F.count("*").alias("n")), "votes")
    model = Model(PRIOR, [ON_GOOD] * len(RULES), [ON_BAD] * len(RULES))
    p, n = F.col("p"), F.col("n")
    sums = [F.sum(n).alias("all"), F.sum(n * p).alias("good")]
    for c in columns:
        for value in (-1, 0, 1):
            sums += [F.sum(F.when(F.col(c) == value, n * p).otherwise(0.0)).alias(f"{c}_good_{value}"),
                     F.sum(F.when(F.col(c) == value, n * (1 - p)).otherwise(0.0)).alias(f"{c}_bad_{value}")]
    for _ in range(rounds):
        row = patterns.withColumn("p", posterior(model)).agg(*sums).first()
        if not row["all"]:
            break
        # One document's worth of the start keeps every share above zero.
        found = [likeliest(*([row[f"{c}_{side}_{v}"] + s for v, s in zip((-1, 0, 1), start)]
                             for side, start in (("good", ON_GOOD), ("bad", ON_BAD)))) for c in columns]
        model = Model(min(0.99, max(0.01, row["good"] / row["all"])), [g for g, _ in found], [b for _, b in found])
    return model


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts, base_failed, votes, quality (0..1), kept.

    A null or empty text has no words: it fails the base rules.  Repeated rows are judged each; other
    columns are not looked at; an empty table gives no rows.  Texts are read once, their counts are
    written to the shared folder, and estimating and judging use those.
    """
    voted = stored(votes(features(docs, doc_id, text)), "features")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", posterior(estimate(voted))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))
