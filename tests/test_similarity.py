"""Scorers against a textbook dynamic program."""

import random

from pyspark.sql import functions as F

from offermatch.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    total = len(a) + len(b)
    return 100.0 if not total else (1 - (total - 2 * lcs(a, b)) / total) * 100


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0

    def windows(p, t):
        return max(ratio(p, t[max(s, 0):s + len(p)]) for s in range(1 - len(p), len(t)))

    return max(windows(a, b), windows(b, a)) if len(a) == len(b) else windows(a, b)


def samples():
    rng = random.Random(7)

    def text():
        return " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
                        for _ in range(rng.randint(0, rng.choice([2, 4, 18]))))

    return [(text(), text()) for _ in range(150)] + [
        ("", ""), ("", "a"), ("a b", "b a"), ("a a b", "a"), ("ab" * 40, "ba" * 45), ("abc", "xyz"),
        ("x" * 70, "x" * 80), ("red ring", "the red ring"),
    ]


def plain_token_set(a, b):
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(left & right)
    if both and (left <= right or right <= left):
        return 100.0
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    gap, s = bool(both), len(both)
    sx, sy = s + gap + len(x), s + gap + len(y)
    best = 100.0 - 100.0 * (len(x) + len(y) - 2 * lcs(x, y)) / (sx + sy)
    return max(best, 100.0 - 100.0 * (gap + len(x)) / (s + sx), 100.0 - 100.0 * (gap + len(y)) / (s + sy)) if s else best


def test_scorers_agree_with_plain(spark):
    pairs = samples()
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", S.ratio(a, b).alias("r"), S.token_set_ratio(a, b).alias("ts"),
        S.token_sort_ratio(a, b).alias("so"), S.partial_ratio(a, b).alias("part"),
    ).collect()
    for r in got:
        assert r.r == ratio(r.a, r.b)
        assert r.so == ratio(" ".join(sorted(r.a.split())), " ".join(sorted(r.b.split())))
        assert abs(r.ts - plain_token_set(r.a, r.b)) < 1e-9
        assert abs(r.part - partial(r.a, r.b)) < 1e-9


def test_long_patterns(spark):
    """Patterns of one, two and several words, at and around the word borders, beyond the basic plane too."""
    rng = random.Random(11)
    sizes = [1, 61, 62, 63, 123, 124, 125, 190, 300]
    pairs = [("".join(rng.choice("ab\n😀é") for _ in range(n)), "".join(rng.choice("ab\n😀é") for _ in range(n + extra)))
             for n in sizes for extra in (0, 1, 40)]
    pairs += [("a" * 124, "a" * 300), ("ab" * 62, "ba" * 62), ("a" * 63, "b" * 90)]
    got = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", S.lcs_length(F.col("a"), F.col("b")).alias("l"), S.partial_ratio(F.col("a"), F.col("b")).alias("part")).collect()
    for r in got:
        assert r.l == lcs(r.a, r.b)
        if len(r.a) < 130:
            assert abs(r.part - partial(r.a, r.b)) < 1e-9


def test_token_set_corners(spark):
    rows = [("", "a", 0.0), ("a b", "a", 100.0), ("a b c", "c b a", 100.0), ("ab", "cd", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for r in df.select("want", S.token_set_ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want
