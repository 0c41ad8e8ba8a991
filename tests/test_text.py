"""Golden rows for the text rules, including what SQL cannot express."""

import pytest
from pyspark.sql import functions as F

from offermatch.functions import predicates as D, prices as P, text as X


def values(spark, fn, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_clean_string_collapses_unicode_space(spark):
    assert values(spark, X.clean_string, [" a  　 b\n", None, "\x1c"]) == ["a b", "", ""]


def test_aliases_see_earlier_output(spark):
    got = values(spark, X.expand_aliases, ["switch oled", "PS5 disc", "éps5", "xm5", None])
    assert got == [
        "nintendo nintendo switch oled", "ps5 playstation 5 slim disc", "éps5",
        "sony wh-1000xm5", "",
    ]


def test_noise_ends_at_comma_dot_newline_or_end(spark):
    got = values(spark, X.strip_noise, [
        "good #été gcash only, box", "rfs upgrade", "cod\nkeep", "meet up at noon. ok",
    ])
    assert got == ["good , box", "", "keep", ". ok"]


def test_pii_order_and_kinds(spark):
    got = values(spark, X.redact_pii, [
        "a@b.co", "gcash: 09171234567", "1234-5678-9012-3456", "+63 917-123-4567", "555-123-4567",
    ])
    assert got == ["[EMAIL REDACTED]", "[PAYMENT REDACTED]", "[PAYMENT REDACTED]",
                   "[PHONE REDACTED]", "[PHONE REDACTED]"]


def test_sanitize(spark):
    got = values(spark, X.sanitize_untrusted, ["a\x00<System x>b</script >", "```c"])
    assert got == ["a[TAG DISARMED]b[TAG DISARMED]", "'''c"]


def test_secrets_keep_the_key_name(spark):
    got = values(spark, X.redact_secrets, [
        "AIzaSy" + "a" * 33, "x?API_KEY=abc&y", "Bearer " + "t" * 20, '"private_key": "zz"',
        "-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----",
    ])
    assert got[0] == "AIzaSy***[REDACTED_API_KEY]***"
    assert got[1] == "x?API_KEY=***[REDACTED]***&y"
    assert got[2] == "Bearer ***[REDACTED_TOKEN]***"
    assert got[3] == '"private_key": "***[REDACTED]***"'
    assert "ab" not in got[4]


def test_audit_text_drops_a_partial_last_word(spark):
    fn = lambda c: X.clean_for_audit(c, 10)
    assert values(spark, fn, ["price 10000 php", "0123456789 x", "a\n\nb", "12345678 9"]) == [
        "price", "0123456789", "a\nb", "12345678 9",
    ]


def test_audit_block_rounds_the_exact_binary_value(spark):
    row = spark.range(1).select(X.audit_block(
        F.lit('a"<1'), F.lit(" <b> & "), F.lit(1.005), F.lit("x > y")
    ).alias("v")).first().v
    assert row == (
        '<listing_untrusted_data id="a&quot;&lt;1">\n  <title>&lt;b&gt; &amp;</title>\n'
        "  <price>1.00</price>\n  <description>x &gt; y</description>\n</listing_untrusted_data>"
    )


@pytest.mark.parametrize("text, negated, live", [
    ("no scratch", True, False),
    ("not a single tiny scratch", True, False),
    ("not one two three four scratch", False, True),
    ("no scratch but scratch and some other scratch", True, True),
    ("isn't it a scratch", True, False),
    ("scratches", False, False),
    ("'scratch", False, True),
    ("", False, False),
])
def test_negation(spark, text, negated, live):
    row = spark.createDataFrame([(text,)], "t string").select(
        X.is_negated(F.col("t"), F.lit(" scratch ")).alias("n"),
        X.has_live_keyword(F.col("t"), F.lit("scratch")).alias("l"),
    ).first()
    assert (row.n, row.l) == (negated, live)


def test_live_keyword_over_many_hits_matches_plain_python(spark):
    import random
    import re

    rng = random.Random(5)
    words = ["no", "never", "issue", "issues", "a", "b,", "isn't", "issue.", "", "it's"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    bad = {"no", "not", "without", "never", "isn't", "wasn't", "hasn't", "none"}

    def plain(text):
        for m in re.finditer(r"(?<!\w)issue(?!\w)", text, re.I):
            if not bad & set(re.findall(r"[\w']+", text[: m.start()].lower())[-4:]):
                return True
        return False

    got = values(spark, lambda c: X.has_live_keyword(c, F.lit("issue")), texts)
    assert got == [plain(t) for t in texts]


def test_condition_override(spark):
    rows = [("brand  NEW", "has issue"), ("like-new", "issue"), ("Lightly used", "no issue"),
            ("heavily used", "issue")]
    df = spark.createDataFrame(rows, "c string, d string")
    got = df.select(
        X.override_condition(F.col("c"), F.col("d"), F.array(F.lit("issue"))).alias("v")
    ).collect()
    assert [(r.v.condition, r.v.changed) for r in got] == [
        ("Lightly Used", True), ("Like-New", False), ("Lightly Used", False), ("Heavily Used", False),
    ]


def test_freebies_keep_order_and_length(spark):
    fn = lambda c: X.extract_freebies(c, F.array(F.lit("free"), F.lit("comes with")))
    assert values(spark, fn, [
        "free case. comes with box, free a b c d e f g, Free case", "includes x", "bundled with y",
    ]) == [["box", "case"], [], []]


def test_price_recovery_prefers_k_and_range(spark):
    df = spark.createDataFrame(
        [("rush 15.5k", "php 9,000", 16000.0), ("x", "₱ 1,200.50", 1000.0), ("90k", "", 1000.0),
         ("90k", "", None)], "t string, d string, p double")
    got = [(r.v.price, r.v.source) for r in df.select(
        P.recover_price(F.col("t"), F.col("d"), F.col("p")).alias("v")).collect()]
    assert got == [(15500.0, "k_notation"), (1200.5, "currency_notation"), (None, "none"),
                   (90000.0, "k_notation")]


def test_triage_and_ceiling(spark):
    df = spark.createDataFrame(
        [(None, "for 900"), (0.0, "only 0.9k"), (50.0, "x"), (500.0, "x"), (50.0, "php 1,400")],
        "p double, t string")
    got = [(r.v.price, r.v.flag) for r in df.select(
        P.triage_price(F.col("p"), F.col("t"), F.lit(""), F.lit(1000.0)).alias("v")).collect()]
    assert got == [(0.0, "placeholder_zero"), (900.0, "text_recovered"), (50.0, "suspiciously_low"),
                   (500.0, "normal"), (50.0, "suspiciously_low")]
    prices = spark.createDataFrame([(3000.0,), (3000.1,), (float("nan"),), (float("inf"),), (None,)],
                                   "p double")
    kept = [r.k for r in prices.select(P.below_ceiling(F.col("p"), F.lit(1000.0)).alias("k")).collect()]
    assert kept == [True, False, False, False, True]


def test_accessory_rules(spark):
    df = spark.createDataFrame(
        [("case for x", "", "Hardware"), ("console with case", "", "Hardware"), ("", "", "Hardware"),
         ("zelda no case", "", "Game"), ("no cartridge", "", "Game"), ("no cartridge case", "", "Game"),
         ("Showcase", "", "Hardware")], "t string, d string, k string")
    got = [r.v for r in df.select(
        D.is_accessory_only(F.col("t"), F.col("d"), F.col("k")).alias("v")).collect()]
    assert got == [True, False, False, False, True, False, False]


def test_bundle_cues(spark):
    df = spark.createDataFrame(
        [("pouch, case", ""), ("ps5, case", ""), ("10,000 ps5", ""), ("a + b", ""),
         ("x", "a 100 - b\nc 2k: d"), ("x", "a 100 - b"), ("x", "lot of 3")], "t string, d string")
    got = [r.v for r in df.select(D.has_bundle_cues(F.col("t"), F.col("d")).alias("v")).collect()]
    assert got == [True, False, False, True, True, False, True]


def test_blank_and_stripped_texts(spark):
    texts = ["", " ", "\x1c\u2003\n", " a \u00a0", "\u2028a b\n\nc\x1f ", "\U0001f600 ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", X.strip_space(F.col("t")).alias("s"), X.is_blank(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r.s for r in rows] == ["", "", "", "a", "a b\n\nc", "\U0001f600", ""]
    assert [r.b for r in rows] == [True, True, True, False, False, False, True]
