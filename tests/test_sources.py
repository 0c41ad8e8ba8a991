"""Page fixtures, catalog reading, merging."""

import json
import os

import pytest
from pyspark.sql import functions as F

from offermatch.functions.prices import unescape_entities
from offermatch.sources import catalog as C, listings as L, pages as P

SITE = "https://market.example"
CARD = {"id": "7", "title": " Red ring ", "price": {"formatted": "PHP 1,250.50"},
        "belowFold": [{"label": "Condition", "value": "like new"}], "details": "fine",
        "seller": {"name": "ann"}, "url": "/p/red-7/"}


def extract(spark, html, **kw):
    df = spark.createDataFrame([(SITE + "/s/x", html)], "url string, html string")
    return P.pages_to_listings(df, SITE, **kw).orderBy("pos").collect()


@pytest.mark.parametrize("wrap", [
    lambda d: json.dumps(d),
    lambda d: "window.S = " + json.dumps(d) + ";",
    lambda d: "s(JSON.parse(" + json.dumps(json.dumps(d)) + "))",
])
def test_structured_cards(spark, wrap):
    doc = {"a": [{"listingCards": [CARD, CARD, {"id": "8"}, {"title": "no id", "price": 5, "id": 9}]}]}
    rows = extract(spark, "<html><script>" + wrap(doc) + "</script></html>")
    assert [r.title for r in rows] == ["Red ring", "no id"]
    first = rows[0]
    assert (first.listing_id, first.price, first.condition, first.description, first.link, first.seller) == (
        "7", 1250.5, "Like New", "fine", SITE + "/p/red-7/", "ann")
    assert rows[1].listing_id == "9" and rows[1].link == SITE + "/p/no-id-9/"
    assert {r.extract_status for r in rows} == {"structured"}


def test_strict_ids(spark):
    html = "<script>" + json.dumps({"listing_cards": [{"title": "x", "id": 9}]}) + "</script>"
    assert extract(spark, html, strict_ids=True)[0].listing_id == ""


def test_empty_list_is_valid_and_nothing_is_an_error(spark):
    assert extract(spark, '<script>{"listingCards": []}</script>')[0].extract_status == "empty"
    row = extract(spark, "<p>hi<script>var x = 1</script>")[0]
    assert row.extract_status == "structure_error" and row.title is None


def test_rendered_cards(spark):
    html = ('<div data-testid="listing-card-1" data-id="5"><a href="q?x=1"><h2>Blue <b>rod</b></h2></a>'
            '<br><span class="price">₱ 90</span><i data-testid="card-condition">Well used</i>'
            '<p class="seller">bob</p></div><div data-testid="other-listing-card"><h2>no</h2></div>')
    rows = extract(spark, html)
    assert len(rows) == 1
    r = rows[0]
    assert (r.listing_id, r.title, r.price, r.condition, r.link, r.seller, r.extract_status) == (
        "5", "Blue rod", 90.0, "Well Used", SITE + "/s/q?x=1", "bob", "html")


def test_detail_pages(spark):
    node = {"id": "5", "description": " by id "}
    product = {"@type": "Product", "description": "a &amp; b"}
    pages = [("u", "5", json.dumps([product, product, node])), ("v", "6", json.dumps([product])),
             ("w", "6", json.dumps([product, product]))]
    df = spark.createDataFrame([(u, i, f"<script>{b}</script>") for u, i, b in pages],
                               "url string, listing_id string, html string")
    got = {r.url: (r.description, r.status) for r in P.detail_descriptions(df).collect()}
    assert got == {"u": ("by id", "by_id"), "v": ("a & b", "only_product"), "w": (None, "structure_error")}


def test_catalog_header_is_found_by_content(spark):
    required = ["Deal Price (PHP)", "Item Name", "Category", "Retail Price (PHP)", "Notes",
                "Keyword for Condition Downsizing", "Keyword for Finding Freebies"]
    rows = [(0, ["title"]), (1, required), (2, ["1,000", " a ", "c"]), (3, ["5", " "])]
    got = C.read_catalog(spark.createDataFrame(rows, "ord long, cells array<string>")).collect()
    assert len(got) == 1
    assert (got[0].item_name, got[0].deal_price, got[0].retail_price, got[0].search_mode,
            got[0].target_type, got[0].allow_bundle_check) == (" a ", 1000.0, None, "Category", "Hardware", False)
    with pytest.raises(ValueError):
        C.read_catalog(spark.createDataFrame(rows[:1], "ord long, cells array<string>"))


def test_zero_deal_price_is_missing(spark):
    df = spark.createDataFrame([(1, "a", "0"), (2, "b", "-1"), (3, "c", "9")],
                               "ord long, item_name string, deal_price string")
    got = {r.item_name: (r.deal_price, len(r.violations)) for r in C.coerce_targets(df).collect()}
    assert got == {"a": (None, 1), "c": (9.0, 0)}
    with pytest.raises(Exception, match="missing required deal_price"):
        C.coerce_targets(df, mode="failfast").collect()


def test_csv_catalog(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("x\n" + ",".join(f'"{h}"' for h in C.R.CATALOG_HEADERS) + '\n'
                    '"a, b",Cat,Item Name,"1,000",900,k,f,n,Game,yes\n')
    row = C.read_catalog(C.read_csv_cells(spark, str(path))).first()
    assert (row.item_name, row.retail_price, row.target_type, row.allow_bundle_check) == (
        "a, b", 1000.0, "Game", True)


def test_merge_takes_first_truthy_and_ordered_union(spark):
    rows = [(1, "7", "", "t", 0.0, ["b"]), (2, "7", "", "u", 5.0, ["a", "b"]), (3, "", "", "T", None, ["x"]),
            (4, "", "", "t", None, ["y"])]
    df = spark.createDataFrame(
        rows, "o int, listing_id string, link string, title string, price double, source_urls array<string>"
    ).repartition(3)
    got = {r.identity_key: (r.title, r.price, r.source_urls) for r in
           L.merge_listings(df, ["o"], ["title", "price"], ["source_urls"]).collect()}
    assert got == {"7": ("t", 5.0, ["b", "a"]), "t": ("T", None, ["x", "y"])}


def test_price_and_link_corners(spark):
    df = spark.createDataFrame([("//h.example/a",), ("b",), ("?q",), ("http://x.example/y",)], "l string")
    got = [r.v for r in df.select(P.resolve_link(F.lit(SITE + "/s/t?page=1"), F.col("l")).alias("v")).collect()]
    assert got == ["https://h.example/a", SITE + "/s/b", SITE + "/s/t?q", "http://x.example/y"]


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("a,b\n" + ",".join(f"c{i}" for i in range(70)) + '\n"x,1","two\nlines"\n')
    cells = [r.cells for r in C.read_csv_cells(spark, str(path)).orderBy("ord").collect()]
    assert cells == [["a", "b"], [f"c{i}" for i in range(70)], ["x,1", "two\nlines"]]


def test_nested_prices_and_entities(spark):
    cards = [('{"price":{"amount":{"value":5}}}', 5.0), ('{"price":["PHP 7"]}', 7.0), ('{"price":"&#x20B1;1,200"}', 1200.0),
             ('{"price":"&#8369;900&nbsp;"}', 900.0), ('{"price":{"x":1},"amount":"&yen;3"}', 3.0), ('{"price":null}', None)]
    df = spark.createDataFrame(cards, "card string, want double")
    got = df.select(P.card_price(F.try_parse_json("card")).alias("price"), "want").collect()
    assert [r.price for r in got] == [r.want for r in got]
    texts = spark.createDataFrame([("&lt;&amp;lt; &#x41;&#66; &bogus; &#xD800; plain",)], "t string")
    assert texts.select(unescape_entities(F.col("t")).alias("t")).first().t == "<&lt; AB &bogus; \ufffd plain"


def test_deep_json_is_an_error_row(spark):
    deep = "<script>" + '{"a":' * 100_000 + "1" + "}" * 100_000 + "</script>"
    nested = '<script>{"listingCards":[{"title":"t","x":' + "[" * 900 + "]" * 900 + "}]}</script>"
    df = spark.createDataFrame([("u", deep, "1"), ("v", nested, "1")], "url string, html string, listing_id string")
    assert {r.url: r.extract_status for r in P.page_cards(df).collect()}["u"] == "structure_error"
    assert [r.status for r in P.detail_descriptions(df).collect()] == ["structure_error"] * 2


def test_price_of_any_depth(spark):
    def nested(depth, inner):
        return '{"price":' + '{"amount":' * depth + inner + "}" * depth + "}"

    rows = [(nested(0, "5"), 5.0), (nested(1, '"PHP 1,200"'), 1200.0), (nested(10, "7"), 7.0), (nested(40, '"8"'), 8.0),
            (nested(9, "null"), None), ('{"price":{"amount":{"x":1},"value":{"price":{"formatted":"9"}}}}', 9.0)]
    df = spark.createDataFrame(rows, "card string, want double").withColumn("c", F.try_parse_json("card"))
    for r in df.select("want", P.card_price(F.col("c")).alias("got")).collect():
        assert r.got == r.want


def test_scripts_of_a_page():
    """Comments, quoted attributes, open ends, several values and quoted values."""
    def stated(html):
        return [list(P._stated(script)) for script in P._scripts(html)]

    assert stated('<!-- <script>{"a": 1}</script> --><SCRIPT data-x="a>b">{"b": 2}</Script >') == [[{"b": 2}]]
    assert stated('<script>x = {"a": {"b": 1}}; y: {"c": 2}') == [[{"a": {"b": 1}}, {"b": 1}, {"c": 2}]]
    quoted = json.dumps(json.dumps({"k": "é"}))
    assert stated(f"<script>JSON.parse({quoted})</script>") == [[{"k": "é"}]]
    assert stated('<script>a = "no json"; b = {broken; c = {"d": [1, 2]}</script>') == [[{"d": [1, 2]}]]
    assert stated("<script></script><script>  </script><!-- open <script>{}</script>") == [[], []]
    assert stated("<scripts>{}</scripts>") == []
    assert [stated(part * 50_000) for part in ("<script", "<script '", "<script>", "<!-- ")] == [[[]], [[]], [[]], []]


def test_deep_prices_ask_for_no_schema_by_level(spark):
    """Schemas of all that lies below were once asked for at each level, twice."""
    card = P.card_price(F.col("c"))
    opening = card._jc.toString().split("levels")[0] if hasattr(card, "_jc") else str(card)
    assert opening.count("schema_of_variant") <= 6
    rows = [('{"price":{"value":null,"price":{"amount":[{"value":3}],"value":5}}}', None), ('{"price":{"value":null,"price":{"value":5}}}', 5.0),
            ('{"price":' + '{"value":' * 60 + '7' + '}' * 60 + "}", 7.0), ('{"price":{"x":1},"amount":2.5}', 2.5), ('{"price":null,"amount":"PHP 4"}', 4.0)]
    df = spark.createDataFrame(rows, "c string, want double").withColumn("c", F.try_parse_json("c"))
    for r in df.select("want", P.card_price(F.col("c")).alias("got")).collect()[1:]:
        assert r.got == r.want


def test_plan_sources_broadcasts_no_table_as_long_as_part(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = entry.queries()["plan_sources"](spark, "/root/testdata/sf0.001")
    shown = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint" not in shown
