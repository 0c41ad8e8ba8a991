"""Similarity, variants, best match and candidate generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions import similarity as S
from offermatch.functions.text import tokens
from offermatch.operators import candidates as C, matching as M, variants as V
from offermatch.plans.registry import (
    CATALOG, LISTINGS, lcs_sql, query, token_set_ctes, tokens_sql, words_sql,
)
from offermatch.plans.text_queries import (
    KEY, SALE_TEXT, accessory_sql, cues_sql, freebies_sql, override_sql, packaging_sql,
    recover_sql, rewrite_sql,
)
from offermatch.session import stored
from offermatch.sources import bridge
from offermatch.sources.bridge import LISTING_ORDER, table

PAIRS = f"""{LISTINGS},
pairs AS (SELECT DISTINCT title AS a, p_name AS b FROM listings JOIN part ON l_partkey = p_partkey)"""


def title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return bridge.listings(spark, sf).join(names, "l_partkey").select(
        F.col("title").alias("a"), F.col("p_name").alias("b")
    ).distinct()


def short_first_lcs(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) <= length({b}) THEN {lcs_sql(a, b)} ELSE {lcs_sql(b, a)} END"


def ratio_sql(a: str, b: str) -> str:
    return (
        f"(1.0::DOUBLE - (length({a}) + length({b}) - 2 * ({short_first_lcs(a, b)}))::DOUBLE "
        f"/ (length({a}) + length({b}))) * 100.0::DOUBLE"
    )


@query("score_indel", f"WITH {PAIRS} SELECT a, b, {ratio_sql('a', 'b')} AS score FROM pairs")
def score_indel(spark, sf):
    return title_pairs(spark, sf).withColumn("score", S.ratio(F.col("a"), F.col("b")))


@query("score_token_sort", f"""WITH {PAIRS}, sorted AS (SELECT a, b,
 array_to_string(list_sort({words_sql('a')}), ' ') AS sa, array_to_string(list_sort({words_sql('b')}), ' ') AS sb
 FROM pairs) SELECT a, b, {ratio_sql('sa', 'sb')} AS score FROM sorted""")
def score_token_sort(spark, sf):
    return title_pairs(spark, sf).withColumn("score", S.token_sort_ratio(F.col("a"), F.col("b")))


@query("score_token_set", f"""WITH {PAIRS}, {token_set_ctes('pairs', 'a', 'b', 'a, b')}
SELECT a, b, ts AS score FROM scored""")
def score_token_set(spark, sf):
    return title_pairs(spark, sf).withColumn("score", S.token_set_ratio(F.col("a"), F.col("b")))


def partial_ctes(source: str, a: str, b: str) -> str:
    """CTEs ending in ``partials(a, b, pr)``: the best window ratio of the shorter string."""
    return f"""
sides AS (SELECT DISTINCT {a} AS a, {b} AS b,
 CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS p,
 CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS t FROM {source}),
both_ways AS (SELECT * FROM sides UNION SELECT a, b, t, p FROM sides WHERE length(p) = length(t)),
windows AS (SELECT a, b, p, substring(t, greatest(w, 0) + 1, least(w + length(p), length(t)) - greatest(w, 0)) AS win
 FROM (SELECT *, unnest(range(1 - length(p), length(t))) AS w FROM both_ways)),
lcs_of AS (SELECT p, win, {lcs_sql('p', 'win')} AS l FROM (SELECT DISTINCT p, win FROM windows)),
partials AS (SELECT a, b, max((1.0::DOUBLE - (length(p) + length(win) - 2 * l)::DOUBLE
 / (length(p) + length(win))) * 100.0::DOUBLE) AS pr
 FROM windows JOIN lcs_of USING (p, win) GROUP BY a, b)"""


@query("score_partial", f"WITH {PAIRS}, {partial_ctes('pairs', 'a', 'b')} SELECT a, b, pr AS score FROM partials")
def score_partial(spark, sf):
    return title_pairs(spark, sf).withColumn("score", S.partial_ratio(F.col("a"), F.col("b")))


FOLDED = f"""{PAIRS}, folded AS (SELECT a, b, lower({rewrite_sql('a', R.ALIASES, 'gi')}) AS fa,
 lower({rewrite_sql('b', R.ALIASES, 'gi')}) AS fb FROM pairs)"""


@query("recall_score", f"""WITH {FOLDED}, {token_set_ctes('folded', 'fa', 'fb', 'fa, fb')},
{partial_ctes('folded', 'fa', 'fb')}
SELECT f.a, f.b, greatest(ts, pr) AS best, ts AS token_set, pr AS partial, ts >= 50 OR pr >= 65 AS recalled
FROM folded f JOIN (SELECT DISTINCT * FROM scored) s ON f.fa = s.fa AND f.fb = s.fb
JOIN partials p ON p.a = f.fa AND p.b = f.fb""")
def recall_score(spark, sf):
    rows = title_pairs(spark, sf).withColumns({
        "fa": C.recall_text(F.col("a")), "fb": C.recall_text(F.col("b")),
    }).withColumn("token_set", S.token_set_ratio(F.col("fa"), F.col("fb"))).withColumn(
        "partial", S.partial_ratio(F.col("fa"), F.col("fb"))
    )
    passes = (F.col("token_set") >= R.TOKEN_SET_MIN) | (F.col("partial") >= R.PARTIAL_MIN)
    return rows.select(
        "a", "b", F.greatest("token_set", "partial").alias("best"), "token_set", "partial",
        (passes | C.core_token_match(F.col("a"), F.col("b"))).alias("recalled"),
    )


CONSOLE_TITLE = "concat(title, CASE l_linenumber WHEN 1 THEN ' ps5 digi' WHEN 2 THEN ' nsw' WHEN 3 THEN ' air 5' ELSE '' END)"


@query("core_token_match", f"""WITH {LISTINGS}
SELECT {KEY}, l_linenumber = 1 AS ps5, l_linenumber = 2 AS console, l_linenumber = 3 AS tablet FROM listings""")
def core_token_match(spark, sf):
    """One reading of each text for its three targets; the one-element explode keeps it from being repeated."""
    read = F.explode(F.array(C.recall_tokens(F.expr(CONSOLE_TITLE)))).alias("have")
    return bridge.listings(spark, sf).select(*LISTING_ORDER, read).select(
        *LISTING_ORDER, C.holds_core(F.col("have"), F.lit("PS5 Slim Digital")).alias("ps5"),
        C.holds_core(F.col("have"), F.lit("Nintendo Switch OLED")).alias("console"),
        C.holds_core(F.col("have"), F.lit("iPad Air 5")).alias("tablet"),
    )


# --- families and variants -------------------------------------------------------------------

FAMILIES_ON = f"""named AS (SELECT ord, item_name, lower(item_name) AS low FROM catalog),
sorted_names AS (SELECT ord, item_name, array_to_string(list_sort({words_sql('low')}), ' ') AS s FROM named),
edges AS (SELECT earlier, later FROM (SELECT x.ord AS earlier, y.ord AS later, x.s AS xs, y.s AS ys
 FROM sorted_names x JOIN sorted_names y ON x.ord < y.ord) WHERE {ratio_sql('xs', 'ys')} >= 55),
adjacent AS (SELECT ord, item_name, coalesce(list(earlier) FILTER (earlier IS NOT NULL), []::BIGINT[]) AS earlier
 FROM named LEFT JOIN edges ON later = ord GROUP BY ord, item_name),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders UNION ALL
 SELECT i + 1, CASE WHEN list_has_any(leaders, earlier) THEN leaders ELSE list_append(leaders, i + 1) END
 FROM walk JOIN adjacent ON ord = i + 1),
families AS (SELECT ord, item_name,
 coalesce(list_min(list_filter(earlier, lambda e: list_contains(leaders, e))), ord) AS leader
 FROM adjacent, (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1)),
own AS (SELECT f.ord, f.item_name, leader, {tokens_sql('f.item_name')} AS toks FROM families f),
counted AS (SELECT leader, tok, count(*) AS n FROM (SELECT leader, unnest(toks) AS tok FROM own) GROUP BY 1, 2),
sizes AS (SELECT leader, count(*) AS members FROM own GROUP BY 1),
shared AS (SELECT leader, list(tok) AS shared FROM counted JOIN sizes USING (leader) WHERE n = members GROUP BY 1),
variants AS (SELECT ord, item_name, o.leader, toks, list_sort(list_filter(toks,
 lambda t: NOT list_contains(coalesce(shared, []::VARCHAR[]), t))) AS own_tokens
 FROM own o LEFT JOIN shared s ON s.leader = o.leader),
pools AS (SELECT leader, list_distinct(flatten(list(own_tokens))) AS pool FROM variants GROUP BY 1),
profiles AS (SELECT ord, item_name, v.leader, own_tokens,
 list_filter(pool, lambda t: NOT list_contains(own_tokens, t)) AS siblings,
 list_filter(toks, lambda t: NOT list_contains([{', '.join(f"'{t}'" for t in R.GENERIC_TOKENS)}], t)) AS required
 FROM variants v JOIN pools p ON p.leader = v.leader)"""
FAMILIES = f"{CATALOG}, {FAMILIES_ON}"


@query("family_edges", f"WITH RECURSIVE {CATALOG}, {FAMILIES_ON} SELECT earlier, later FROM edges")
def family_edges(spark, sf):
    return V.family_edges(bridge.catalog(spark, sf).select("ord", "item_name"))


@query("group_families", f"WITH RECURSIVE {FAMILIES} SELECT ord, item_name, leader FROM families")
def group_families(spark, sf):
    return V.group_families(bridge.catalog(spark, sf)).select("ord", "item_name", "leader")


@query("variant_tokens", f"""WITH RECURSIVE {FAMILIES}
SELECT ord, item_name, array_to_string(own_tokens, ' ') AS own_tokens FROM variants""")
def variant_tokens(spark, sf):
    rows = V.variant_tokens(V.group_families(bridge.catalog(spark, sf)))
    return rows.select("ord", "item_name", F.array_join("own_tokens", " ").alias("own_tokens"))


COMPATIBLE = """list_has_all(t.toks, p.required) AND list_has_all(t.toks, p.own_tokens)
 AND NOT list_has_any(t.toks, p.siblings)"""


@query("variant_compatible", f"""WITH RECURSIVE {PAIRS}, {FAMILIES}
SELECT a, b, {COMPATIBLE} AS fits FROM (SELECT a, b, {tokens_sql('a')} AS toks FROM pairs) t
JOIN profiles p ON p.item_name = b""")
def variant_compatible(spark, sf):
    profile = V.variant_profile(V.group_families(bridge.catalog(spark, sf)))
    return title_pairs(spark, sf).join(profile, F.col("b") == F.col("item_name")).select(
        "a", "b", V.variant_compatible(
            tokens(F.col("a")), F.col("required_tokens"), F.col("own_tokens"), F.col("sibling_tokens")
        ).alias("fits"),
    )


def processed_sql(text: str) -> str:
    return f"trim(lower(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"


BEST = f"""{LISTINGS}, {FAMILIES},
flagged AS (SELECT *, {accessory_sql(SALE_TEXT)} AS acc, {packaging_sql(SALE_TEXT)} AS pack FROM listings),
kinds AS (SELECT DISTINCT title, acc, pack, {tokens_sql('title')} AS toks, {processed_sql('title')} AS pt FROM flagged),
fitting AS (SELECT t.title, t.acc, t.pack, t.pt, p.ord, p.item_name, {processed_sql('p.item_name')} AS pn
 FROM kinds t JOIN profiles p ON {COMPATIBLE} JOIN catalog c ON c.item_name = p.item_name
 WHERE NOT CASE WHEN c.target_type = 'Game' THEN t.pack ELSE t.acc END),
{token_set_ctes('fitting', 'pt', 'pn', 'title, acc, pack, ord, item_name')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, acc, pack ORDER BY ts DESC, ord) AS rn
 FROM scored) WHERE rn = 1 AND ts > 60)"""


@query("best_match", f"""WITH RECURSIVE {BEST}
SELECT {KEY}, item_name AS matched_item, ts AS match_score FROM flagged JOIN best USING (title, acc, pack)""")
def best_match(spark, sf):
    rows = M.best_match(bridge.listings(spark, sf), bridge.catalog(spark, sf))
    return rows.select(*LISTING_ORDER, "matched_item", "match_score")


DEALS = f"""{BEST}, deals AS (SELECT f.*, b.item_name AS matched_item, ts AS match_score, c.deal_price,
 c.deal_price - f.price AS savings, {override_sql('f.condition', 'f.description')},
 {freebies_sql('f.description')} AS bundles, c.category AS reference_category
 FROM flagged f JOIN best b USING (title, acc, pack) JOIN catalog c ON c.item_name = b.item_name
 WHERE f.price IS NOT NULL AND f.price <= c.deal_price)"""
DEAL_COLUMNS = ["matched_item", "match_score", "deal_price", "savings", "final_condition",
                "condition_overridden", "reference_category"]


@query("local_deals", f"""WITH RECURSIVE {DEALS}
SELECT listing_id, {KEY}, bundles, {', '.join(DEAL_COLUMNS)} FROM deals""")
def local_deals(spark, sf):
    rows = M.local_deals(bridge.listings(spark, sf), bridge.catalog(spark, sf))
    return rows.select(
        "listing_id", *LISTING_ORDER, F.array_join("bundles", "|").alias("bundles"), *DEAL_COLUMNS
    )


# --- stage one -------------------------------------------------------------------------------

@query("eligible_pairs", f"""WITH {LISTINGS}, {CATALOG}
SELECT {KEY}, c.item_name, c.deal_price FROM listings JOIN part ON l_partkey = p_partkey
JOIN catalog c ON l_linenumber = 7 OR c.item_name = p_name OR (l_linenumber = 2 AND c.item_name = 'red ring')""")
def eligible_pairs(spark, sf):
    return C.eligible_pairs(with_eligible(spark, sf), bridge.catalog(spark, sf), LISTING_ORDER).select(
        *LISTING_ORDER, "item_name", "deal_price"
    )


def with_eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Listings that may match their own part name; line 2 one more, line 7 every target."""
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = F.when(F.col("l_linenumber") == 2, F.array(F.col("p_name"), F.lit("red ring"))).when(
        F.col("l_linenumber") != 7, F.array("p_name")
    )
    return bridge.listings(spark, sf).join(names, "l_partkey").withColumn(
        "eligible_target_names", named
    )


CANDIDATES = f"""{LISTINGS}, {CATALOG},
flagged AS (SELECT *, {accessory_sql(SALE_TEXT)} AS acc, {packaging_sql(SALE_TEXT)} AS pack,
 {cues_sql('title', 'description')} AS cues FROM listings),
texts AS (SELECT *, title AS match_text, CASE WHEN cues THEN 'single' ELSE 'all' END AS scope FROM flagged
 UNION ALL SELECT *, concat(title, chr(10), description), 'bundle' FROM flagged WHERE cues),
read_texts AS (SELECT DISTINCT match_text, scope, lower({rewrite_sql('match_text', R.ALIASES, 'gi')}) AS a FROM texts),
names AS (SELECT ord, item_name, allow_bundle_check, lower({rewrite_sql('item_name', R.ALIASES, 'gi')}) AS b FROM catalog),
compared AS (SELECT match_text, scope, ord, a, b FROM read_texts JOIN names
 ON scope = 'all' OR (scope = 'bundle') = allow_bundle_check),
unspaced AS (SELECT DISTINCT a, b, replace(a, chr(10), ' ') AS wa FROM compared),
{token_set_ctes('unspaced', 'wa', 'b', 'a, b')},
{partial_ctes('unspaced', 'a', 'b')},
recalled AS (SELECT match_text, scope, ord, greatest(ts, pr) AS lexical_score FROM compared c
 JOIN scored s ON s.a = c.a AND s.b = c.b JOIN partials p ON p.a = c.a AND p.b = c.b WHERE ts >= 50 OR pr >= 65),
paired AS (SELECT t.*, r.ord, lexical_score, c.item_name, c.deal_price,
 CASE WHEN t.cues THEN '' ELSE t.description END AS shown
 FROM texts t JOIN recalled r USING (match_text, scope) JOIN catalog c ON c.ord = r.ord
 WHERE NOT CASE WHEN c.target_type = 'Game' THEN pack ELSE acc END
  AND (t.price IS NULL OR t.price <= 3 * c.deal_price)),
read_prices AS (SELECT *, {recover_sql("concat(title, ' ', chr(10), ' ', shown)", 'deal_price')} FROM paired),
rated AS (SELECT *, (price IS NULL OR price <= 0 OR price < deal_price * 0.1::DOUBLE)
 AND coalesce(recovered >= deal_price * 0.1::DOUBLE AND recovered <= deal_price, false) AS use FROM read_prices),
triaged AS (SELECT *, CASE WHEN scope = 'bundle' THEN coalesce(CAST(price AS DOUBLE), 0.0::DOUBLE)
  WHEN use THEN recovered WHEN price IS NULL OR price <= 0 THEN 0.0::DOUBLE ELSE CAST(price AS DOUBLE) END AS effective_price,
 CASE WHEN scope = 'bundle' THEN 'bundle_candidate' WHEN use THEN 'text_recovered'
  WHEN price IS NULL OR price <= 0 THEN 'placeholder_zero'
  WHEN price < deal_price * 0.1::DOUBLE THEN 'suspiciously_low' ELSE 'normal' END AS price_flag FROM rated),
candidates AS (SELECT * FROM triaged WHERE price_flag IN ('bundle_candidate', 'placeholder_zero', 'suspiciously_low')
 OR (effective_price >= deal_price * 0.1::DOUBLE AND effective_price <= deal_price))"""


def stage_one(spark: SparkSession, sf: str, keep: list[str]) -> DataFrame:
    return C.find_candidates(bridge.listings(spark, sf), bridge.catalog(spark, sf), keep)


@query("find_candidates", f"""WITH {CANDIDATES}
SELECT listing_id, {KEY}, item_name, effective_price, lexical_score, price_flag FROM candidates""")
def find_candidates(spark, sf):
    return stage_one(spark, sf, ["listing_id", *LISTING_ORDER]).select(
        "listing_id", *LISTING_ORDER, "item_name", "effective_price", "lexical_score", "price_flag"
    )


@query("find_candidates_eligible", f"""WITH {CANDIDATES}
SELECT c.listing_id, {', '.join('c.' + k for k in LISTING_ORDER)}, item_name, effective_price, lexical_score, price_flag
FROM candidates c JOIN part ON l_partkey = p_partkey
WHERE l_linenumber = 7 OR item_name = p_name OR (l_linenumber = 2 AND item_name = 'red ring')""")
def find_candidates_eligible(spark, sf):
    """Listings that may match a few targets, and some (line 7) that may match any."""
    found = C.find_candidates(with_eligible(spark, sf), bridge.catalog(spark, sf), ["listing_id", *LISTING_ORDER])
    return found.select("listing_id", *LISTING_ORDER, "item_name", "effective_price", "lexical_score", "price_flag")


@query("annotate_listings", f"""WITH {CANDIDATES},
picked AS (SELECT * FROM (SELECT listing_id, price_flag, effective_price, row_number() OVER (PARTITION BY listing_id
 ORDER BY CASE price_flag WHEN 'bundle_candidate' THEN 4 WHEN 'text_recovered' THEN 3 WHEN 'suspiciously_low' THEN 2
  WHEN 'placeholder_zero' THEN 1 ELSE 0 END DESC, {KEY}, ord) AS rn FROM candidates) WHERE rn = 1)
SELECT {', '.join('l.' + k for k in LISTING_ORDER)}, l.listing_id,
 CASE WHEN p.price_flag = 'text_recovered' THEN p.effective_price ELSE CAST(l.price AS DOUBLE) END AS price,
 coalesce(p.price_flag, 'normal') AS price_flag FROM listings l LEFT JOIN picked p USING (listing_id)""")
def annotate(spark, sf):
    found = stage_one(spark, sf, ["listing_id", *LISTING_ORDER])
    return C.annotate_listings(bridge.listings(spark, sf), found, LISTING_ORDER).select(
        *LISTING_ORDER, "listing_id", "price", "price_flag"
    )


@query("candidate_lookup", f"""WITH {CANDIDATES}
SELECT listing_id, item_name, price_flag, effective_price FROM (SELECT *, row_number() OVER (
 PARTITION BY listing_id, item_name ORDER BY {', '.join(k + ' DESC' for k in LISTING_ORDER)}) AS rn FROM candidates)
WHERE rn = 1""")
def lookup(spark, sf):
    # The candidate table is written, as in a whole run: what was shuffled to find it is gone when it is looked up.
    found = stored(stage_one(spark, sf, ["listing_id", *LISTING_ORDER]).select(
        "listing_id", "item_name", *LISTING_ORDER, "price_flag", "effective_price"), "candidates")
    return C.candidate_lookup(found, LISTING_ORDER).select(
        "listing_id", "item_name", "price_flag", "effective_price"
    )


@query("accept_local_deals", f"""WITH RECURSIVE {DEALS}
SELECT listing_id, {KEY}, matched_item, match_score AS local_match_score, 'normal' AS price_flag,
 'local_fallback' AS audit_source FROM deals d
WHERE EXISTS (SELECT 1 FROM listings f JOIN part ON f.l_partkey = p_partkey
 WHERE f.listing_id = d.listing_id AND p_name = d.matched_item)""")
def accept_local_deals(spark, sf):
    """Deals backed by the pair of their own part."""
    listings, cat = bridge.listings(spark, sf), bridge.catalog(spark, sf)
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    pairs = listings.join(names, "l_partkey").select(
        "listing_id", "title", F.col("p_name").alias("item_name"), F.lit("normal").alias("price_flag"),
        F.struct(*LISTING_ORDER).alias("seq"),
    )
    deals = M.local_deals(listings, cat)
    return M.accept_local_deals(deals, pairs, cat).select(
        "listing_id", *LISTING_ORDER, "matched_item", "local_match_score", "price_flag", "audit_source"
    )
