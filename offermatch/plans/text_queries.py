"""Text operators and price rules over whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.functions import predicates as D, prices as P, text as X
from offermatch.plans.registry import LISTINGS, query, tokens_sql
from offermatch.sources import bridge
from offermatch.sources.bridge import LISTING_ORDER, table

KEY = ", ".join(LISTING_ORDER)


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def rewrite_sql(text: str, steps, flags: str = "g") -> str:
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{_quoted(pattern)}', '{_quoted(replacement)}', '{flags}')"
    return text


def documents(spark, sf):
    return table(spark, sf, "documents")


# Titles in the vocabulary of the rewrites, one per line item.
SLANG = """concat(CASE l_linenumber WHEN 1 THEN 'PS5 disc ' WHEN 2 THEN 'switch oled ' WHEN 3 THEN 'totk nsw '
 WHEN 4 THEN 'ip15pm ' WHEN 5 THEN 'play station 5 ' WHEN 6 THEN 'xm5 air 5 ' ELSE 'mba m1 botw ' END,
 CAST(CAST(l_quantity AS INT) AS STRING), 'k')"""


@query("expand_aliases", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {rewrite_sql(SLANG, R.ALIASES, 'gi')} AS expanded FROM lineitem""")
def expand_aliases(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.expand_aliases(F.expr(SLANG)).alias("expanded")
    )


def _noise_sql(text: str) -> str:
    """The noise rules without lookaround: a word's edges and what ends a stretch are put back.

    Neighbouring stretches share the character between them, so each rule runs twice.
    """
    letter = r"\p{L}\p{M}\p{N}_"
    tags = f"regexp_replace({text}, '#[\\p{{L}}\\p{{N}}_]+', '', 'g')".replace("\\\\", "\\")
    for names in (r"gcash|maya|bpi|bdo|bank\s*transfer|cod|meet\s*up|lalamove|grab|j&t|shipping",
                  r"rfs|reason\s*for\s*selling"):
        rule = rf"(?i)(^|[^{letter}])(?:{names})(?:[^{letter},.\n][^,.\n]*|([,.\n]|$))"
        for _ in range(2):
            tags = f"regexp_replace({tags}, '{rule}', '\\1\\2', 'g')".replace("\\\\", "\\")
    return f"trim(regexp_replace({tags}, '\\s+', ' ', 'g'))".replace("\\\\", "\\")


@query("strip_noise", f"SELECT doc_id, {_noise_sql('text')} AS plain FROM documents")
def strip_noise(spark, sf):
    return documents(spark, sf).select("doc_id", X.strip_noise(F.col("text")).alias("plain"))


@query("strip_noise_listings", f"""WITH {LISTINGS}
SELECT {KEY}, trim(regexp_replace(regexp_replace(description, '#\\w+', '', 'g'), '\\s+', ' ', 'g')) AS plain
FROM listings""")
def strip_noise_listings(spark, sf):
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, X.strip_noise(F.col("description")).alias("plain")
    )


@query("redact_pii", f"""
SELECT doc_id, {rewrite_sql('text', R.PERSONAL_DATA)} AS redacted FROM documents""")
def redact_pii(spark, sf):
    return documents(spark, sf).select("doc_id", X.redact_pii(F.col("text")).alias("redacted"))


@query("redact_pii_listings", f"""WITH {LISTINGS}
SELECT {KEY}, {rewrite_sql('description', R.PERSONAL_DATA)} AS redacted FROM listings""")
def redact_pii_listings(spark, sf):
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, X.redact_pii(F.col("description")).alias("redacted")
    )


@query("sanitize_untrusted", f"""
SELECT page_id, replace(regexp_replace(regexp_replace(html, '{R.CONTROL_CHARS}', '', 'g'),
 '{R.STRUCTURAL_TAGS}', '{R.TAG_MARKER}', 'g'), '```', '''''''') AS safe FROM pages""")
def sanitize(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", X.sanitize_untrusted(F.col("html")).alias("safe")
    )


@query("compress_text", """
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
cut AS (SELECT *, left(t, 250) AS h,
 CASE WHEN strpos(reverse(left(t, 250)), ' ') > 0 THEN 250 - strpos(reverse(left(t, 250)), ' ') ELSE -1 END AS sp FROM flat)
SELECT doc_id, CASE WHEN length(t) <= 250 THEN t
 ELSE concat(rtrim(CASE WHEN sp > 175 THEN left(h, sp) ELSE h END, ' ,.-'), '...') END AS short FROM cut""")
def compress(spark, sf):
    return documents(spark, sf).select("doc_id", X.compress_text(F.col("text")).alias("short"))


@query("clean_for_audit", f"""
WITH safe AS (SELECT doc_id, replace(regexp_replace(regexp_replace({rewrite_sql('text', R.PERSONAL_DATA)},
 '{R.CONTROL_CHARS}', '', 'g'), '{R.STRUCTURAL_TAGS}', '{R.TAG_MARKER}', 'g'), '```', '''''''''') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '\\r\\n|[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))) AS line,
 generate_subscripts(string_split(regexp_replace(t, '\\r\\n|[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)), 1) AS n
 FROM safe),
plain AS (SELECT doc_id, n, {_noise_sql('line')} AS line FROM lines),
joined AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE line <> ''), '') AS t FROM plain
 GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(t) <= {R.AUDIT_TEXT_CHARS} THEN t
 ELSE rtrim(CASE WHEN regexp_matches(substring(t, {R.AUDIT_TEXT_CHARS} + 1, 1), '\\s') THEN left(t, {R.AUDIT_TEXT_CHARS})
  ELSE regexp_replace(left(t, {R.AUDIT_TEXT_CHARS}), '\\S+\\n?$', '') END, ' ' || chr(10)) END AS plain FROM joined""")
def clean_for_audit(spark, sf):
    return documents(spark, sf).select("doc_id", X.clean_for_audit(F.col("text")).alias("plain"))


BLOCK_CLEAN = f"""trim(regexp_replace({rewrite_sql("regexp_replace(description, '#.*$', '')", R.PERSONAL_DATA)},
 '\\s+', ' ', 'g')) AS d"""
BLOCK = """concat('<listing_untrusted_data id="', listing_id, '">', chr(10), '  <title>', title, '</title>', chr(10),
 '  <price>', coalesce(printf('%.2f', CAST(price AS DOUBLE)), '0.00'), '</price>', chr(10), '  <description>', d,
 '</description>', chr(10), '</listing_untrusted_data>')"""


@query("audit_block", f"WITH {LISTINGS}, c AS (SELECT *, {BLOCK_CLEAN} FROM listings) SELECT {KEY}, {BLOCK} AS block FROM c")
def audit_block(spark, sf):
    return bridge.listings(spark, sf).select(*LISTING_ORDER, X.audit_block(
        F.col("listing_id"), F.col("title"), F.col("price"), F.col("description")
    ).alias("block"))


@query("redact_secrets", f"""
SELECT doc_id, {rewrite_sql('text', [(p, r.replace('$1', chr(92) + '1')) for p, r in R.CREDENTIALS])} AS redacted
FROM documents""")
def redact_secrets(spark, sf):
    return documents(spark, sf).select("doc_id", X.redact_secrets(F.col("text")).alias("redacted"))


def recover_sql(text: str, deal: str) -> str:
    """Two columns' SQL: recovered price and source."""
    def first(pattern: str, scale: str) -> str:
        return (
            f"list_filter(list_transform(regexp_extract_all({text}, '(?i){_quoted(pattern)}', 1), "
            f"lambda x: CAST(replace(x, ',', '') AS DOUBLE) * {scale}), "
            f"lambda v: v >= {deal} * 0.1::DOUBLE AND v <= {deal} * 1.5::DOUBLE)[1]"
        )

    short, marked = first(R.K_PRICE, "1000.0"), first(R.CURRENCY_PRICE, "1.0")
    return (
        f"coalesce({short}, {marked}) AS recovered, CASE WHEN {short} IS NOT NULL THEN 'k_notation' "
        f"WHEN {marked} IS NOT NULL THEN 'currency_notation' ELSE 'none' END AS source"
    )


LISTING_TEXT = "concat(title, ' ', chr(10), ' ', description)"


@query("recover_price", f"""WITH {LISTINGS}
SELECT {KEY}, {recover_sql(LISTING_TEXT, '(100.0::DOUBLE * l_linenumber)')} FROM listings""")
def recover_price(spark, sf):
    found = X.let(
        P.recover_price(F.col("title"), F.col("description"), F.col("l_linenumber") * 100.0), lambda s: s
    )
    rows = bridge.listings(spark, sf).withColumn("_r", F.explode(F.array(found)))
    return rows.select(*LISTING_ORDER, F.col("_r.price").alias("recovered"), "_r.source")


@query("tokens", f"""
SELECT doc_id, array_to_string(list_sort({tokens_sql('text')}), ' ') AS tokens FROM documents""")
def tokens(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(F.array_sort(X.tokens(F.col("text"))), " ").alias("tokens")
    )


@query("default_process", """
SELECT doc_id, trim(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]', ' ', 'g'))) AS processed FROM documents""")
def default_process(spark, sf):
    return documents(spark, sf).select("doc_id", X.default_process(F.col("text")).alias("processed"))


# Keyword rules in SQL: a hit is a split point between two non-word characters.
def _hits_sql(text: str, kw: str) -> str:
    parts = f"string_split(lower({text}), {kw})"
    return (
        f"list_filter(range(1, len({parts})), lambda i: "
        f"NOT regexp_matches({parts}[i], '[a-z0-9_]$') AND NOT regexp_matches({parts}[i + 1], '^[a-z0-9_]'))"
    )


def _negated_sql(text: str, kw: str, i: str) -> str:
    prefix = f"array_to_string(string_split(lower({text}), {kw})[1:{i}], {kw})"
    words = f"regexp_extract_all({prefix}, '[a-z0-9_'']+')"
    return (
        f"list_has_any({words}[-4:], ['no', 'not', 'without', 'never', 'isn''t', 'wasn''t', "
        f"'hasn''t', 'none'])"
    )


def live_sql(text: str, kw: str) -> str:
    return (
        f"len(list_filter({_hits_sql(text, kw)}, lambda h: NOT {_negated_sql(text, kw, 'h')})) > 0"
    )


def override_sql(condition: str, description: str) -> str:
    """Two columns: final condition and whether it changed, for the bridge keywords."""
    norm = f"lower(trim({condition}))"
    live = " OR ".join(f"({live_sql(description, q)})" for q in ("'issue'", "'defect'", "'scratch'"))
    title = (
        f"CASE {norm} WHEN 'brand new' THEN 'Brand New' WHEN 'like new' THEN 'Like New' ELSE 'Well Used' END"
    )
    step = f"CASE {norm} WHEN 'brand new' THEN 'Lightly Used' WHEN 'like new' THEN 'Well Used' END"
    return (
        f"CASE WHEN ({step}) IS NOT NULL AND ({live}) THEN {step} ELSE {title} END AS final_condition, "
        f"coalesce(({step}) IS NOT NULL AND ({live}), false) AS condition_overridden"
    )


# Longer texts with repeated, negated and embedded keywords, derived from the listings.
REMARK = """concat(description, ' ', CASE l_linenumber WHEN 1 THEN 'scratches? no scratch here'
 WHEN 2 THEN 'one issue, two issue' WHEN 3 THEN 'never a defect. it has one defect though' ELSE 'ok' END)"""


@query("keyword_hits", f"""WITH {LISTINGS}
SELECT {KEY}, len({_hits_sql(REMARK, "'scratch'")}) AS scratch, len({_hits_sql(REMARK, "'issue'")}) AS issue
FROM listings""")
def keyword_hits(spark, sf):
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, X.keyword_hits(F.expr(REMARK), F.lit("scratch")).cast("long").alias("scratch"),
        X.keyword_hits(F.expr(REMARK), F.lit("issue")).cast("long").alias("issue"),
    )


def _first_negated(kw: str) -> str:
    hits = _hits_sql(REMARK, kw)
    return f"coalesce(len({hits}) > 0 AND {_negated_sql(REMARK, kw, f'{hits}[1]')}, false)"


@query("is_negated", f"""WITH {LISTINGS}
SELECT {KEY}, {_first_negated("'scratch'")} AS scratch, {_first_negated("'defect'")} AS defect FROM listings""")
def is_negated(spark, sf):
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, X.is_negated(F.expr(REMARK), F.lit(" scratch ")).alias("scratch"),
        X.is_negated(F.expr(REMARK), F.lit("defect")).alias("defect"),
    )


@query("has_live_keyword", f"""WITH {LISTINGS}
SELECT {KEY}, {live_sql(REMARK, "'scratch'")} AS scratch, {live_sql(REMARK, "'defect'")} AS defect,
 {live_sql(REMARK, "'issue'")} AS issue FROM listings""")
def live_keyword(spark, sf):
    return bridge.listings(spark, sf).select(*LISTING_ORDER, *[
        X.has_live_keyword(F.expr(REMARK), F.lit(k)).alias(k) for k in ("scratch", "defect", "issue")
    ])


@query("override_condition", f"""WITH {LISTINGS}
SELECT {KEY}, {override_sql('condition', 'description')} FROM listings""")
def override(spark, sf):
    words = F.array(*[F.lit(k) for k in ("issue", "defect", "scratch")])
    rows = bridge.listings(spark, sf).withColumn("_c", F.explode(F.array(
        X.override_condition(F.col("condition"), F.col("description"), words)
    )))
    return rows.select(
        *LISTING_ORDER, F.col("_c.condition").alias("final_condition"),
        F.col("_c.changed").alias("condition_overridden"),
    )


def freebies_sql(text: str) -> str:
    """Joined freebies for the bridge phrases, which enable the first three triggers."""
    lists = ", ".join(
        f"list_filter(list_transform(regexp_extract_all({text}, '{_quoted(p)}', 1), "
        f"lambda x: trim(x, ' -:' || chr(9))), lambda x: x <> '' AND len(string_split(x, ' ')) <= 6)"
        for _, p in R.FREEBIE_TRIGGERS[:3]
    )
    items = f"flatten([{lists}])"
    return (
        f"array_to_string(list_filter({items}, lambda x, i: list_position({items}, x) = i), '|')"
    )


@query("extract_freebies", f"""WITH {LISTINGS}
SELECT {KEY}, {freebies_sql(REMARK)} AS freebies FROM listings""")
def freebies(spark, sf):
    phrases = F.array(*[F.lit(k) for k in ("comes with", "free", "includes")])
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, F.array_join(X.extract_freebies(F.expr(REMARK), phrases), "|").alias("freebies")
    )


# --- predicates and price rules --------------------------------------------------------------

def accessory_sql(text: str) -> str:
    return (
        f"regexp_matches({text}, '{R.ACCESSORY_TERMS}') AND NOT regexp_matches({text}, '{R.COMPLETE_UNIT_TERMS}')"
    )


def packaging_sql(text: str) -> str:
    # RE2 has no lookahead: drop the excluded phrase first.
    bare = f"regexp_replace({text}, '(?i)\\bno\\s+(game|cartridge)\\s+case', '', 'g')"
    pattern = R.PACKAGING_ONLY_TERMS.replace(r"(?!\s+case)", "")
    return f"regexp_matches({bare}, '{pattern}')"


SALE_TEXT = "concat(title, ' ', description)"


@query("is_accessory_only", f"""WITH {LISTINGS}
SELECT {KEY}, {accessory_sql(SALE_TEXT)} AS hardware, {packaging_sql(SALE_TEXT)} AS game FROM listings""")
def accessory(spark, sf):
    title, text = F.col("title"), F.col("description")
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, D.is_accessory_only(title, text, F.lit("Hardware")).alias("hardware"),
        D.is_accessory_only(title, text, F.lit("Game")).alias("game"),
    )


def cues_sql(title: str, description: str) -> str:
    """Commas between non-digits: pad, so that the edges count as non-digits."""
    return (
        f"(regexp_matches(concat({title}, chr(10), {description}), '{R.BUNDLE_WORDS}') "
        f"OR regexp_matches(concat(' ', {title}, ' '), '[^0-9],[^0-9]|[+&/]') "
        f"OR len(regexp_extract_all({description}, '{R.ITEMISED_LINE.replace('(?md)', '(?m)')}')) >= 2)"
    )


@query("has_bundle_cues", f"""WITH {LISTINGS}
SELECT {KEY}, {cues_sql('title', REMARK)} AS cues FROM listings""")
def cues(spark, sf):
    return bridge.listings(spark, sf).select(
        *LISTING_ORDER, D.has_bundle_cues(F.col("title"), F.expr(REMARK)).alias("cues")
    )


def triage_sql(source: str, deal: str, description: str) -> str:
    """CTE text: adds effective and flag to a table."""
    text = f"concat(title, ' ', chr(10), ' ', {description})"
    return f"""
found AS (SELECT *, {recover_sql(text, deal)} FROM {source}),
usable AS (SELECT *, (price IS NULL OR price <= 0 OR price < {deal} * 0.1::DOUBLE)
 AND coalesce(recovered >= {deal} * 0.1::DOUBLE AND recovered <= {deal}, false) AS use FROM found),
triaged AS (SELECT *, CASE WHEN use THEN recovered WHEN price IS NULL OR price <= 0 THEN 0.0::DOUBLE
  ELSE CAST(price AS DOUBLE) END AS effective,
 CASE WHEN use THEN 'text_recovered' WHEN price IS NULL OR price <= 0 THEN 'placeholder_zero'
  WHEN price < {deal} * 0.1::DOUBLE THEN 'suspiciously_low' ELSE 'normal' END AS flag FROM usable)"""


@query("triage_price", f"""WITH {LISTINGS}, {triage_sql('listings', '400.0::DOUBLE', 'description')}
SELECT {KEY}, effective, flag FROM triaged""")
def triage(spark, sf):
    rows = bridge.listings(spark, sf).withColumn("_t", F.explode(F.array(P.triage_price(
        F.col("price"), F.col("title"), F.col("description"), F.lit(400.0)
    ))))
    return rows.select(*LISTING_ORDER, F.col("_t.price").alias("effective"), F.col("_t.flag").alias("flag"))


@query("price_ceiling", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_discount = 0 OR l_extendedprice <= 3 * l_quantity * 500""")
def ceiling(spark, sf):
    price = F.expr("CASE WHEN l_discount = 0 THEN NULL WHEN l_tax < 0 THEN double('inf') ELSE l_extendedprice END")
    return table(spark, sf, "lineitem").filter(
        P.below_ceiling(price, F.col("l_quantity") * 500)
    ).select(*LISTING_ORDER)


@query("price_eligible", f"""WITH {LISTINGS}, {triage_sql('listings', '400.0::DOUBLE', 'description')}
SELECT {KEY}, flag FROM triaged WHERE (effective >= 40 AND effective <= 400)
 OR flag IN ('placeholder_zero', 'suspiciously_low')""")
def eligible(spark, sf):
    kept = F.filter(
        F.array(P.triage_price(F.col("price"), F.col("title"), F.col("description"), F.lit(400.0))),
        lambda t: P.price_eligible(t["price"], F.lit(400.0), t["flag"]),
    )
    rows = bridge.listings(spark, sf).withColumn("_t", F.explode(kept))
    return rows.select(*LISTING_ORDER, F.col("_t.flag").alias("flag"))


@query("accept_model", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_extendedprice > 0 AND l_extendedprice <= 40000 AND l_returnflag <> 'N' AND l_linestatus = 'O'
 AND l_linenumber <> 3 AND CAST(l_quantity AS INT) + 50 >= 80""")
def accept_model(spark, sf):
    item = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return table(spark, sf, "lineitem").filter(P.accept_model(
        item, F.col("l_linestatus") == "O", F.col("l_linenumber") == 3,
        F.col("l_quantity").cast("int") + 50, F.col("l_extendedprice"), F.lit(40000.0),
    )).select(*LISTING_ORDER)


@query("accept_local", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_extendedprice <= 40000 AND l_linestatus = 'O' AND l_quantity * 2 >= 60""")
def accept_local(spark, sf):
    return table(spark, sf, "lineitem").filter(P.accept_local(
        F.col("l_quantity") * 2, F.col("l_extendedprice"), F.lit(40000.0), F.col("l_linestatus") == "O"
    )).select(*LISTING_ORDER)


@query("match_text", f"""WITH {LISTINGS}
SELECT {KEY}, CASE WHEN {cues_sql('title', 'description')} AND l_linenumber % 2 = 0
 THEN concat(title, chr(10), description) ELSE title END AS text FROM listings""")
def match_text(spark, sf):
    title, text = F.col("title"), F.col("description")
    return bridge.listings(spark, sf).select(*LISTING_ORDER, D.match_text(
        title, text, D.has_bundle_cues(title, text), F.col("l_linenumber") % 2 == 0
    ).alias("text"))
