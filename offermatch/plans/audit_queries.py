"""Audit requests and judgements.  Responses are derived from the candidates themselves, with every
kind of defect at a known position in the candidate order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offermatch import rules as R

from offermatch.operators import audits as A, deals as D
from offermatch.plans import cascade as P
from offermatch.plans.match_queries import BEST, CANDIDATES, COMPATIBLE, DEALS, FAMILIES_ON
from offermatch.plans.registry import CATALOG, LISTINGS, query, tokens_sql
from offermatch.plans.text_queries import BLOCK, BLOCK_CLEAN, override_sql
from offermatch.session import stored
from offermatch.sources import bridge
from offermatch.sources.bridge import LISTING_ORDER, table

KEY = ", ".join(LISTING_ORDER)

# Candidates: every listing with its own part name; repeated ids keep their first row.
CANDS_ON = f"""pairs AS (SELECT l.*, p_name AS item_name, CASE WHEN l_linenumber % 7 = 5 AND price > 0 THEN 'bundle_candidate'
 WHEN price IS NULL OR price <= 0 THEN 'placeholder_zero' ELSE 'normal' END AS price_flag
 FROM listings l JOIN part ON l_partkey = p_partkey),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {KEY}) AS rn FROM pairs)
 WHERE rn = 1),
chunks AS (SELECT *, row_number() OVER (ORDER BY {KEY}) AS seq,
 (row_number() OVER (ORDER BY {KEY}) - 1) // 20 + 1 AS chunk_number FROM firsts)"""
CANDS = f"{LISTINGS}, {CATALOG}, {CANDS_ON}"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item_name")
    )
    flag = F.expr("""CASE WHEN l_linenumber % 7 = 5 AND price > 0 THEN 'bundle_candidate'
     WHEN price IS NULL OR price <= 0 THEN 'placeholder_zero' ELSE 'normal' END""")
    return bridge.listings(spark, sf).join(names, "l_partkey").withColumn("price_flag", flag)


def chunks(spark: SparkSession, sf: str, *columns: str, found: DataFrame | None = None) -> DataFrame:
    """Numbered candidates with their order, their target and the named columns; no others are sorted or moved.

    The numbering writes them, as the request table stands between the two jobs of a real run.
    ``found`` has the pairs if they are written already.
    """
    found = (pairs(spark, sf) if found is None else found).select("listing_id", *LISTING_ORDER, "item_name", *columns)
    return A.chunk_candidates(A.dedup_candidates(found, LISTING_ORDER), LISTING_ORDER)


# Item kinds by position: 0 good, 1-4 and 10-11 invalid, 5 unknown id, 6 invalid then good,
# 7 good twice, 8 foreign target, 9 left out.
ITEM = """concat('{"id":"', {id}, '","matched_item":"', {item}, '","confidence":', {confidence}, ',', {specs},
 '"issues":["worn"," "],"freebies":["pouch"],"downgrade_condition":', {down}, ',"is_accessory":false,"is_bundle":',
 {bundle}, ',"individual_price":', {price}, ',"separately_available":', {split}, ',"price_evidence":', {evidence}, '}')"""
GOOD = {
    "id": "listing_id", "item": "item_name", "confidence": "CAST(60 + seq % 41 AS STRING)",
    "specs": "'\"specs_matched\":true,'", "down": "CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END",
    "bundle": "'false'", "price": "'null'", "split": "'false'", "evidence": "'null'",
}
LONG_EVIDENCE = "concat('\"', repeat('x', 801), '\"')"


def item_sql(**changes: str) -> str:
    text = ITEM
    for name, value in {**GOOD, **changes}.items():
        text = text.replace("{" + name + "}", value)
    return text


ITEMS = f"""CASE seq % 12
 WHEN 1 THEN {item_sql(confidence="'\"90\"'")} WHEN 2 THEN {item_sql(confidence="'90.5'")}
 WHEN 3 THEN {item_sql(confidence="'101'")} WHEN 4 THEN {item_sql(specs="''")}
 WHEN 5 THEN {item_sql(id="concat(listing_id, '-x')")}
 WHEN 6 THEN concat({item_sql(bundle="'\"no\"'")}, ',', {item_sql()})
 WHEN 7 THEN concat({item_sql()}, ',', {item_sql()})
 WHEN 8 THEN {item_sql(item="'nothing like it'")} WHEN 9 THEN ''
 WHEN 10 THEN {item_sql(price="'5'")}
 WHEN 11 THEN {item_sql(bundle="'true'", evidence=LONG_EVIDENCE)}
 ELSE {item_sql()} END"""


def responses(rows: DataFrame) -> DataFrame:
    """One response per chunk: plain, fenced, inside other text, an HTTP error, not JSON, or no object."""
    # The one-element explode keeps the filter from writing each item a second time.
    items = rows.select("chunk_number", "seq", F.explode(F.array(F.expr(ITEMS))).alias("item"))
    joined = items.filter("item <> ''").groupBy("chunk_number").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]
    ), ",").alias("items"))
    doc = F.concat(F.lit('{"audits":['), "items", F.lit("]}"))
    shape = F.col("chunk_number") % 10
    return joined.select(
        "chunk_number",
        F.when(shape == 3, 500).otherwise(200).alias("http_status"),
        F.when(shape == 3, 4).otherwise(1).alias("attempts"),
        F.when(shape == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("Here: "), doc, F.lit(" Done.")))
        .when(shape == 3, "").when(shape == 4, "no json {here")
        .when(shape == 6, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc).alias("body"),
    )


USABLE = "chunk_number % 10 NOT IN (3, 4, 6)"


@query("dedup_candidates", f"WITH {CANDS} SELECT listing_id, {KEY}, item_name, price_flag FROM firsts")
def dedup_candidates(spark, sf):
    return A.dedup_candidates(pairs(spark, sf), LISTING_ORDER).select(
        "listing_id", *LISTING_ORDER, "item_name", "price_flag"
    )


# A listing one of whose candidates names no target may be judged to be any item of the catalog.
EVERYTHING = "everything AS (SELECT coalesce(string_agg(DISTINCT item_name, '|' ORDER BY item_name), '') AS names FROM catalog)"


@query("allowed_targets_first", f"""WITH {CANDS}, {EVERYTHING}
SELECT listing_id, coalesce(item_name, names) AS allowed, item_name IS NULL AS open FROM firsts, everything""")
def allowed_first(spark, sf):
    found = A.allowed_targets(pairs(spark, sf), LISTING_ORDER, cat=bridge.catalog(spark, sf))
    return found.select("listing_id", F.array_join("allowed", "|").alias("allowed"), "open")


@query("allowed_targets_all", f"""WITH {CANDS}, {EVERYTHING}, named AS (SELECT listing_id, bool_or(item_name IS NULL) AS open,
 string_agg(DISTINCT item_name, '|' ORDER BY item_name) AS allowed FROM pairs GROUP BY 1)
SELECT listing_id, CASE WHEN open THEN names ELSE allowed END AS allowed, open FROM named, everything""")
def allowed_all(spark, sf):
    found = A.allowed_targets(pairs(spark, sf), LISTING_ORDER, "all", bridge.catalog(spark, sf))
    return found.select("listing_id", F.array_join("allowed", "|").alias("allowed"), "open")


UNNAMED = "l_linenumber % 3 = 2"  # candidates without a target


def unnamed(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("item_name", F.when(~F.expr(UNNAMED), F.col("item_name")))


@query("allowed_targets_open", f"""WITH {CANDS}
SELECT listing_id, coalesce(string_agg(DISTINCT item_name, '|' ORDER BY item_name) FILTER (NOT {UNNAMED}), '') AS allowed,
 bool_or({UNNAMED}) AS open FROM pairs GROUP BY 1""")
def allowed_open(spark, sf):
    found = A.allowed_targets(unnamed(pairs(spark, sf)), LISTING_ORDER, "all")
    return found.select("listing_id", F.array_join("allowed", "|").alias("allowed"), "open")


# What is judged here: the own target, one of the catalog's, or none of it.
JUDGED = "CASE l_orderkey % 3 WHEN 0 THEN item_name WHEN 1 THEN 'red ring' ELSE 'nothing like it' END"


@query("whitelist_open", f"""WITH {CANDS}, judged AS (SELECT listing_id, {JUDGED} AS matched_item, {UNNAMED} AS open, item_name FROM firsts)
SELECT listing_id, matched_item, CASE WHEN open THEN matched_item IN (SELECT item_name FROM catalog)
 ELSE matched_item = item_name END AS inside FROM judged""")
def whitelist_open(spark, sf):
    """Listings whose candidate names no target may be judged to be any item of the catalog."""
    # Only first candidates count for both sides, so candidates are moved once; the target's name depends on the order alone.
    firsts = A.dedup_candidates(pairs(spark, sf).select("listing_id", *LISTING_ORDER, "item_name"), LISTING_ORDER)
    judged = firsts.select(
        "listing_id", F.expr(JUDGED).alias("matched_item"), F.lit(1).alias("chunk_number"), F.lit(0).alias("pos"))
    allowed = A.allowed_targets(unnamed(firsts), LISTING_ORDER)
    return A.whitelist_gate(judged, allowed, bridge.catalog(spark, sf))["marked"].select("listing_id", "matched_item", "inside")


@query("chunk_candidates", f"WITH {CANDS} SELECT listing_id, seq, chunk_number FROM chunks")
def chunk_candidates(spark, sf):
    return chunks(spark, sf).select("listing_id", "seq", "chunk_number")


SHOWN = ["title", "price", "description"]  # what a request shows of a candidate
REQUEST = "Catalog: {target_items_json}\nAllowed: {allowed_targets_json}\n{candidate_listings_xml}"
ITEM_JSON = """'{"item_name":' || to_json(c.item_name) || ',"category":' || to_json(category)
 || ',"deal_price":' || to_json(c.deal_price) || ',"retail_price":' || to_json(retail_price) || ',"notes":"","target_type":'
 || to_json(target_type) || ',"allow_bundle_check":' || to_json(allow_bundle_check) || '}'"""


def requests_sql(named: str, opened: str, allowed: str) -> str:
    """Whole request texts; ``named`` and ``opened`` are conditions on a chunk's rows, ``allowed`` a JSON list."""
    return f"""WITH {CANDS}, cleaned AS (SELECT *, {BLOCK_CLEAN} FROM chunks),
blocks AS (SELECT *, {BLOCK} AS block FROM cleaned),
whole AS (SELECT DISTINCT chunk_number FROM chunks WHERE {opened}),
wanted AS (SELECT DISTINCT chunk_number, item_name FROM chunks WHERE {named} AND chunk_number NOT IN (SELECT * FROM whole)
 UNION ALL SELECT chunk_number, item_name FROM whole, catalog),
quoted AS (SELECT chunk_number, string_agg({ITEM_JSON}, ',' ORDER BY c.ord) AS items
 FROM wanted JOIN catalog c USING (item_name) GROUP BY 1),
packed AS (SELECT chunk_number, count(*) AS candidate_count, string_agg(block, chr(10) || chr(10) ORDER BY seq) AS blocks,
 concat('{{', string_agg(concat('"', listing_id, '":["', {allowed}, '"]'), ',' ORDER BY seq), '}}') AS allowed_targets
 FROM blocks GROUP BY 1)
SELECT chunk_number, candidate_count, blocks, allowed_targets,
 'Catalog: [' || items || ']' || chr(10) || 'Allowed: ' || allowed_targets || chr(10) || blocks AS request
FROM packed JOIN quoted USING (chunk_number)"""


@query("audit_requests", requests_sql("true", "false", "item_name"))
def audit_requests(spark, sf):
    cat, rows = bridge.catalog(spark, sf), chunks(spark, sf, *SHOWN)
    return A.audit_requests(rows, A.allowed_targets(rows, ["seq"]), REQUEST, cat)


@query("audit_requests_open", requests_sql(
    "true", f"{UNNAMED} AND chunk_number % 4 = 0",
    f"CASE WHEN {UNNAMED} AND chunk_number % 4 = 0 THEN '*' ELSE item_name END"))
def audit_requests_open(spark, sf):
    """A quarter of the chunks has listings without a target and quotes the whole catalog."""
    cat, rows = bridge.catalog(spark, sf), chunks(spark, sf, *SHOWN)
    opened = F.expr(UNNAMED) & (F.col("chunk_number") % 4 == 0)
    named = rows.withColumn("item_name", F.when(~opened, F.col("item_name")))
    return A.audit_requests(rows, A.allowed_targets(named, ["seq"]), REQUEST, cat)


@query("parse_response", f"""WITH {CANDS}, shown AS (SELECT chunk_number, string_agg(CASE seq % 12 WHEN 5 THEN listing_id || '-x'
 WHEN 9 THEN NULL WHEN 6 THEN listing_id || ',' || listing_id WHEN 7 THEN listing_id || ',' || listing_id ELSE listing_id END,
 ',' ORDER BY seq) AS ids FROM chunks GROUP BY 1)
SELECT chunk_number, {USABLE} AS is_object, CASE WHEN {USABLE} THEN ids END AS ids FROM shown""")
def parse_response(spark, sf):
    """The ids in each parsed response, in order, stand for its content."""
    parsed = responses(chunks(spark, sf)).withColumn("_p", F.explode(F.array(A.parse_response(F.col("body")))))
    items = F.try_variant_get("_p", "$.audits", "array<variant>")
    return parsed.select("chunk_number", F.col("_p").isNotNull().alias("is_object"), F.array_join(
        F.transform(items, lambda i: F.try_variant_get(i, "$.id", "string")), ",").alias("ids"))


EXPLODED = f"""good AS (SELECT chunk_number, seq, listing_id, item_name, 60 + seq % 41 AS confidence, seq % 12 AS kind
 FROM chunks WHERE {USABLE}),
items AS (
 SELECT chunk_number, seq, 0 AS sub, CASE WHEN kind = 5 THEN concat(listing_id, '-x') ELSE listing_id END AS listing_id,
  CASE WHEN kind = 8 THEN 'nothing like it' ELSE item_name END AS matched_item, kind = 11 AS bundle,
  CASE kind WHEN 1 THEN 'confidence: not a whole number' WHEN 2 THEN 'confidence: not a whole number'
   WHEN 3 THEN 'confidence: outside 0 to 100' WHEN 4 THEN 'specs_matched: not true or false'
   WHEN 6 THEN 'is_bundle: not true or false' WHEN 10 THEN 'split price without a bundle'
   WHEN 11 THEN 'price_evidence: neither null nor a quote of 1 to 800 letters' ELSE '' END AS problem
 FROM good WHERE kind <> 9
 UNION ALL SELECT chunk_number, seq, 1, listing_id, item_name, false, '' FROM good WHERE kind IN (6, 7)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chunk_number ORDER BY seq, sub) - 1 AS pos FROM items),
known AS (SELECT * FROM numbered WHERE listing_id NOT LIKE '%-x'),
valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY pos) AS vn FROM known
 WHERE problem = '') WHERE vn = 1)"""


def exploded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = chunks(spark, sf)
    return A.explode_audits(responses(rows)), rows


@query("explode_audits", f"""WITH {CANDS}, {EXPLODED}
SELECT chunk_number, pos, listing_id, matched_item, problem, CASE WHEN bundle THEN '' ELSE 'pouch' END AS freebies,
 'worn' AS issues FROM numbered""")
def explode_audits(spark, sf):
    return exploded(spark, sf)[0].select(
        "chunk_number", F.col("pos").cast("long").alias("pos"), "listing_id", "matched_item",
        F.array_join("violations", "; ").alias("problem"), F.array_join("freebies", "|").alias("freebies"),
        F.array_join("issues", "|").alias("issues"),
    )


@query("reconcile_valid", f"""WITH {CANDS}, {EXPLODED}
SELECT chunk_number, listing_id, matched_item, pos FROM valid""")
def reconcile_valid(spark, sf):
    return A.reconcile_audits(*exploded(spark, sf))["valid"].select(
        "chunk_number", "listing_id", "matched_item", F.col("pos").cast("long").alias("pos")
    )


@query("reconcile_errors", f"""WITH {CANDS}, {EXPLODED}
SELECT k.chunk_number, k.listing_id, k.pos,
 CASE WHEN k.pos > coalesce(v.pos, k.pos) THEN 'duplicate audit entry' ELSE k.problem END AS problem
FROM known k LEFT JOIN valid v ON v.listing_id = k.listing_id
WHERE k.problem <> '' OR k.pos > v.pos""")
def reconcile_errors(spark, sf):
    return A.reconcile_audits(*exploded(spark, sf))["errors"].select(
        "chunk_number", "listing_id", F.col("pos").cast("long").alias("pos"),
        F.array_join("violations", "; ").alias("problem"),
    )


@query("reconcile_missing", f"""WITH {CANDS}, {EXPLODED}
SELECT chunk_number, listing_id FROM chunks WHERE listing_id NOT IN (SELECT listing_id FROM valid)""")
def reconcile_missing(spark, sf):
    return A.reconcile_audits(*exploded(spark, sf))["missing"].select("chunk_number", "listing_id")


@query("reconcile_unknown", f"""WITH {CANDS}, {EXPLODED}
SELECT DISTINCT chunk_number, listing_id FROM numbered WHERE listing_id LIKE '%-x'""")
def reconcile_unknown(spark, sf):
    return A.reconcile_audits(*exploded(spark, sf))["unknown"]


MARKED = ["chunk_number", "pos", "listing_id", "matched_item", "violations"]


def gated(spark: SparkSession, sf: str, *columns: str, marks: bool = False, twice: bool = False,
          found: DataFrame | None = None):
    """Requests with the named columns, judgements by kind, and those inside and outside their whitelist.

    ``twice`` says that judgements are read more than once, for which they are written first, as a job of its own
    would; ``marks`` that their ids, targets and violations are enough.
    """
    rows = chunks(spark, sf, *columns, found=found)
    audits = A.explode_audits(responses(rows))
    audits = audits.select(*MARKED) if marks else audits
    parts = A.reconcile_audits(stored(audits, "judgements") if twice else audits, rows)
    gate = A.whitelist_gate(parts["valid"], A.allowed_targets(rows, ["seq"]), bridge.catalog(spark, sf))
    return rows, parts, gate


@query("whitelist_gate", f"""WITH {CANDS}, {EXPLODED}
SELECT chunk_number, listing_id, matched_item FROM valid WHERE matched_item <> 'nothing like it'""")
def whitelist_gate(spark, sf):
    return gated(spark, sf, marks=True)[2]["valid"].select("chunk_number", "listing_id", "matched_item")


@query("whitelist_errors", f"""WITH {CANDS}, {EXPLODED}
SELECT chunk_number, listing_id FROM valid WHERE matched_item = 'nothing like it'""")
def whitelist_errors(spark, sf):
    return gated(spark, sf, marks=True)[2]["errors"].select("chunk_number", "listing_id")


ROUTED = "listing_id NOT IN (SELECT listing_id FROM valid WHERE matched_item <> 'nothing like it')"


def routed(rows: DataFrame, parts: dict[str, DataFrame], gate: dict[str, DataFrame]) -> DataFrame:
    failed = A.chunk_summary(rows, responses(rows)).filter(~F.col("succeeded"))
    return A.route_fallback(rows, failed, parts["missing"], gate["errors"])


@query("route_fallback", f"""WITH {CANDS}, {EXPLODED}
SELECT chunk_number, listing_id, seq FROM chunks WHERE {ROUTED}""")
def route_fallback(spark, sf):
    return routed(*gated(spark, sf, marks=True, twice=True)).select("chunk_number", "listing_id", "seq")


@query("fallback_deals", f"""WITH RECURSIVE {DEALS}, {CANDS_ON}, {EXPLODED}
SELECT listing_id, {KEY}, d.matched_item, match_score AS local_match_score, savings, 'local_fallback' AS audit_source,
 '{R.REASON_ROUTED}' AS acceptance_reason
FROM deals d JOIN (SELECT listing_id, {KEY} FROM chunks WHERE {ROUTED}) USING (listing_id, {KEY})""")
def fallback_deals(spark, sf):
    """Local matches of the candidates that the audit could not judge."""
    offer = ["title", "description", "condition", "price"]
    rows = routed(*gated(spark, sf, *offer, marks=True, twice=True)).withColumns({
        "effective_price": F.col("price"), "ord": F.lit(0), "deal_price": F.lit(0.0), "lexical_score": F.lit(0.0),
        "price_flag": F.lit("normal"),
    })
    return P.fallback_deals(rows, bridge.catalog(spark, sf)).select(
        "listing_id", *LISTING_ORDER, "matched_item", "local_match_score", "savings", "audit_source", "acceptance_reason"
    )


SUMMARY = f"""summary AS (SELECT chunk_number, count(*) AS candidate_count,
 CASE WHEN chunk_number % 10 = 3 THEN 4 ELSE 1 END AS attempts,
 CASE WHEN chunk_number % 10 = 3 THEN 500 ELSE 200 END AS http_status,
 CASE WHEN chunk_number % 10 = 3 THEN 'Gemini returned HTTP 500.'
  WHEN chunk_number % 10 = 4 THEN '{R.FAILED_NOT_JSON}' WHEN chunk_number % 10 = 6 THEN '{R.FAILED_NOT_OBJECT}' END
  AS failure_reason,
 {USABLE} AS succeeded FROM chunks GROUP BY chunk_number)"""


@query("chunk_summary", f"WITH {CANDS}, {SUMMARY} SELECT * FROM summary")
def chunk_summary(spark, sf):
    rows = chunks(spark, sf)
    return A.chunk_summary(rows, responses(rows))


@query("batch_summary", f"""WITH {CANDS}, {SUMMARY}
SELECT count(*) AS chunks, sum(candidate_count)::BIGINT AS candidates, sum(attempts)::BIGINT AS attempts,
 count_if(succeeded)::BIGINT AS succeeded_chunks, false AS whole_batch_fallback, 200 AS http_status,
 count_if(NOT succeeded)::BIGINT AS failed_chunks, string_agg('chunk ' || chunk_number || ': ' || failure_reason, '; '
  ORDER BY chunk_number) FILTER (WHERE NOT succeeded) AS failure_reason FROM summary""")
def batch_summary(spark, sf):
    rows = chunks(spark, sf)
    return A.batch_summary(A.chunk_summary(rows, responses(rows)))


# Valid JSON without a list of audits, bare, fenced and inside other text; the rest is fine or not JSON at all.
BODY = """CASE l_linenumber WHEN 1 THEN '[1]' WHEN 2 THEN '{"audit":[]}' WHEN 3 THEN '```json\n{"audits":{}}\n```'
 WHEN 4 THEN 'no json' WHEN 5 THEN '```\n{"audits":[3]}\n```' WHEN 6 THEN concat('So: {"audits":', l_quantity, '} there')
 ELSE 'Here: {"audits":[]} ok' END"""


@query("payload_errors", f"""
SELECT l_orderkey * 8 + l_linenumber AS chunk_number, CASE WHEN l_linenumber = 1 THEN '{R.PAYLOAD_NOT_OBJECT}'
 ELSE '{R.PAYLOAD_WITHOUT_AUDITS.replace("'", "''")}' END AS error FROM lineitem
WHERE l_linenumber IN (1, 2, 3, 6) AND l_quantity > 10""")
def payload_errors(spark, sf):
    status = F.when(F.col("l_quantity") > 10, 200).otherwise(500)
    return A.payload_errors(table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunk_number"), status.alias("http_status"),
        F.expr(BODY).alias("body"),
    ))


# --- bundle prices, conditions, deals --------------------------------------------------------

OFFER = """concat('set of tools', chr(10), CASE l_linenumber WHEN 1 THEN concat(item_name, ' - 350')
 WHEN 2 THEN concat(item_name, ' 0.35k each') WHEN 3 THEN concat(item_name, ' was 350')
 WHEN 4 THEN concat(item_name, ' 350 or 340') WHEN 5 THEN concat('other thing 350')
 WHEN 6 THEN concat(item_name, ' - 350. no splitting') ELSE concat(item_name, ' - 350 only') END)"""
QUOTE = """CASE l_linenumber WHEN 1 THEN concat(item_name, ' - 350') WHEN 2 THEN concat(item_name, '  0.35k')
 WHEN 3 THEN concat(item_name, ' was 350') WHEN 4 THEN concat(item_name, ' 350 or 340')
 WHEN 5 THEN 'other thing 350' WHEN 6 THEN concat(item_name, ' - 350') ELSE concat(item_name, ' - 35') END"""


@query("verify_bundle_price", f"""WITH {CANDS}
SELECT {', '.join('p.' + k for k in LISTING_ORDER)}, CASE WHEN p.l_suppkey % 3 = 0 THEN CAST(p.price AS DOUBLE)
 WHEN c.allow_bundle_check AND p.l_linenumber IN (1, 2) THEN 350.0::DOUBLE END AS verified
FROM pairs p JOIN catalog c USING (item_name)""")
def verify_bundle_price(spark, sf):
    rows = pairs(spark, sf).join(bridge.catalog(spark, sf).drop("ord"), "item_name")
    price = D.verified_price(
        F.col("l_suppkey") % 3 != 0, F.col("price").cast("double"), F.col("price"), F.lit("tool lot"),
        F.expr(OFFER), F.col("item_name"), F.col("deal_price"), F.col("allow_bundle_check"), F.lit(True),
        F.lit(350.0), F.expr(QUOTE),
    )
    return rows.select(*LISTING_ORDER, price.alias("verified"))


@query("condition_after_audit", f"""WITH {LISTINGS}, c AS (SELECT *, {override_sql('condition', 'description')} FROM listings)
SELECT {KEY}, CASE WHEN l_linenumber % 2 = 0 AND NOT condition_overridden AND NOT l_linenumber = 4 THEN
  CASE lower(condition) WHEN 'brand new' THEN 'Lightly Used' WHEN 'like new' THEN 'Well Used' ELSE final_condition END
 ELSE final_condition END AS final_condition,
 CASE WHEN l_linenumber % 2 = 0 AND NOT condition_overridden AND NOT l_linenumber = 4
  THEN true ELSE condition_overridden END AS changed FROM c""")
def condition_after_audit(spark, sf):
    rows = bridge.listings(spark, sf)
    packed = F.when(F.col("l_linenumber") == 4, F.lit("cartridge only")).otherwise(F.col("title"))
    issues = F.when(F.col("l_linenumber") == 4, F.array(F.lit("no case"))).otherwise(F.array(F.lit("bent")))
    words = F.array(*[F.lit(k) for k in ("issue", "defect", "scratch")])
    final = D.condition_after_audit(
        F.col("condition"), packed, F.col("description"), F.lit("Game"), words,
        F.col("l_linenumber") % 2 == 0, issues,
    )
    return rows.withColumn("_f", F.explode(F.array(final))).select(
        *LISTING_ORDER, F.col("_f.condition").alias("final_condition"), F.col("_f.changed").alias("changed")
    )


ACCEPTED = f"""{EXPLODED},
accepted AS (SELECT v.chunk_number, v.pos, v.listing_id, v.matched_item, 60 + v.seq % 41 AS confidence, v.seq,
 {', '.join('p.' + k for k in LISTING_ORDER)}, p.title, p.description, p.condition, p.price, p.price_flag, p.seller,
 c.deal_price, c.target_type
 FROM valid v JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, item_name
  ORDER BY {', '.join(k + ' DESC' for k in LISTING_ORDER)}) AS last FROM pairs) WHERE last = 1) p
 ON p.listing_id = v.listing_id AND p.item_name = v.matched_item JOIN catalog c ON c.item_name = v.matched_item
 WHERE p.price_flag <> 'placeholder_zero' AND p.price > 0 AND p.price <= c.deal_price AND 60 + v.seq % 41 >= 80)"""


def pairs_table(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs for a run that reads them more than once."""
    return stored(pairs(spark, sf).drop("listed_at"), "pairs")


def accepted(spark: SparkSession, sf: str, gate: dict[str, DataFrame] | None = None, found: DataFrame | None = None) -> DataFrame:
    found = pairs_table(spark, sf) if found is None else found
    gate = gate or gated(spark, sf, found=found)[2]
    stage_one = found.withColumns({
        "effective_price": F.col("price").cast("double"), "seq": F.struct(*LISTING_ORDER),
        "deal_price": F.lit(0.0), "ord": F.lit(0),
    }).drop(*LISTING_ORDER)
    return D.accept_audited(gate["valid"], stage_one, bridge.catalog(spark, sf), ["chunk_number", "pos"])


@query("accept_audited", f"""WITH {CANDS}, {ACCEPTED}
SELECT listing_id, matched_item, confidence, CAST(price AS DOUBLE) AS verified_price, deal_price FROM accepted""")
def accept_audited(spark, sf):
    return accepted(spark, sf).select(
        "listing_id", "matched_item", "confidence", "verified_price", "deal_price"
    )


BUILT = f"""{ACCEPTED}, text_rule AS (SELECT *, {override_sql('condition', 'description')} FROM accepted),
built AS (SELECT listing_id, title, CAST(price AS DOUBLE) AS offer_price, matched_item, deal_price,
 deal_price - price AS savings, seller,
 CASE WHEN seq % 2 = 0 AND NOT condition_overridden THEN CASE lower(condition) WHEN 'brand new' THEN 'Lightly Used'
  WHEN 'like new' THEN 'Well Used' ELSE final_condition END ELSE final_condition END AS final_condition,
 'pouch' AS freebies, 'worn' AS issues, price_flag, 'gemini' AS audit_source, confidence AS model_confidence,
 concat('Gemini ', CAST(confidence AS STRING), '% (Specs Matched)') AS match_score FROM text_rule)"""
BUILT_COLUMNS = ["listing_id", "title", "offer_price", "matched_item", "deal_price", "savings", "seller",
                 "final_condition", "price_flag", "audit_source", "model_confidence", "match_score"]


@query("build_deals", f"WITH {CANDS}, {BUILT} SELECT {', '.join(BUILT_COLUMNS)}, freebies, issues FROM built")
def build_deals(spark, sf):
    return D.build_deals(accepted(spark, sf)).select(
        *BUILT_COLUMNS, F.array_join("freebies", "|").alias("freebies"),
        F.array_join("issues", "|").alias("issues"),
    )


RECORD = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 CASE WHEN l_linenumber % 2 = 0 THEN 'gemini' ELSE 'local_fallback' END AS audit_source,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity * 3 AS INT) END AS model_confidence,
 true AS specs_matched, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 2.5 END AS local_match_score
FROM lineitem"""


@query("deal_violations", f"""WITH r AS ({RECORD})
SELECT {KEY}, CASE WHEN audit_source = 'gemini' THEN CASE WHEN model_confidence IS NULL
 THEN 'model deal must define confidence and specs_matched' WHEN model_confidence > 100
 THEN 'model confidence: outside 0 to 100' ELSE '' END
 ELSE CASE WHEN local_match_score IS NULL THEN 'local deal must define local_match_score'
 WHEN local_match_score > 100 THEN 'local_match_score out of range [0.0, 100.0]' ELSE '' END END AS problem,
 CASE WHEN l_linenumber < 4 THEN 'pouch' ELSE '' END AS freebies FROM r""")
def deal_violations(spark, sf):
    rows = spark.sql(RECORD.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    none = F.array().cast("array<string>")
    filled = rows.withColumns({
        "bundles": F.when(F.col("l_linenumber") < 4, F.array(F.lit("pouch"))).otherwise(none), "freebies": none,
    })
    return D.deal_violations(filled).select(
        *LISTING_ORDER, F.array_join("violations", "; ").alias("problem"),
        F.array_join("freebies", "|").alias("freebies"),
    )


@query("deal_from_record", f"""WITH {LISTINGS}
SELECT listing_id, {KEY}, CAST(price AS DOUBLE) AS offer_price, concat(seller, '|x') AS freebies, 'a|b' AS issues,
 category, condition AS original_condition, 'Normal' AS price_flag, 'gemini' AS audit_source FROM listings""")
def deal_from_record(spark, sf):
    raw = bridge.listings(spark, sf).select(
        F.concat(F.lit(" "), "listing_id").alias("id"), "price", F.concat("seller", F.lit(" , x,,")).alias("bundles"),
        F.lit("a, b").alias("issues"), F.col("category").alias("reference_category"), "condition",
        F.to_json(F.struct(*LISTING_ORDER)).alias("link"), F.lit("").alias("price_status"),
    )
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"
    return D.deal_from_record(raw).withColumn("k", F.from_json("link", schema)).select(
        "listing_id", "k.*", "offer_price", F.array_join("freebies", "|").alias("freebies"),
        F.array_join("issues", "|").alias("issues"), "category", "original_condition", "price_flag",
        "audit_source",
    )


def full_run(spark: SparkSession, sf: str, include_local: bool = True) -> P.Cascade:
    """Both stages over all listings; chunk responses come from the audited candidates."""
    cat, listings = bridge.catalog(spark, sf), bridge.listings(spark, sf)

    def auditor(candidates: DataFrame, targets: DataFrame) -> P.AuditTables:
        single = A.dedup_candidates(candidates, ["seq"]).drop("seq")
        rows = A.chunk_candidates(single, ["cand_ord", "ord"])
        return P.response_auditor(responses(rows))(candidates, targets)

    return P.cascade(listings, cat, auditor, LISTING_ORDER, include_local)


# The whole run: stage one, its first candidate per listing in chunks, the judgements, and local matches of what
# they leave open, whose variant families come from the routed targets alone.
CASCADE = f"""{LISTINGS}, {CATALOG},
stage_one AS (WITH {CANDIDATES} SELECT * FROM candidates),
chunks AS (SELECT *, row_number() OVER (ORDER BY {KEY}, ord) AS seq, (row_number() OVER (ORDER BY {KEY}, ord) - 1) // 20 + 1
 AS chunk_number FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {KEY}, ord) AS rn FROM stage_one) WHERE rn = 1),
{EXPLODED},
looked_up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, item_name
 ORDER BY {', '.join(k + ' DESC' for k in LISTING_ORDER)}, ord DESC) AS back FROM stage_one) WHERE back = 1),
audited AS (SELECT l.*, {override_sql('l.condition', 'l.description')}, v.seq, 60 + v.seq % 41 AS confidence FROM valid v
 JOIN looked_up l ON l.listing_id = v.listing_id AND l.item_name = v.matched_item
 WHERE l.price_flag NOT IN ('placeholder_zero', 'suspiciously_low') AND l.effective_price > 0
 AND l.effective_price <= l.deal_price AND 60 + v.seq % 41 >= 80),
model_deals AS (SELECT listing_id, item_name AS matched_item, effective_price AS offer_price, deal_price,
 deal_price - effective_price AS savings,
 CASE WHEN seq % 2 = 0 AND NOT condition_overridden THEN CASE lower(condition) WHEN 'brand new' THEN 'Lightly Used'
  WHEN 'like new' THEN 'Well Used' ELSE final_condition END ELSE final_condition END AS final_condition,
 'gemini' AS audit_source, confidence AS model_confidence, NULL::DOUBLE AS local_match_score,
 '{R.REASON_MODEL}' AS acceptance_reason FROM audited),
routed AS (SELECT * FROM chunks WHERE {ROUTED}),
chosen AS (SELECT * FROM catalog WHERE item_name IN (SELECT item_name FROM routed)),
fits AS (WITH RECURSIVE catalog AS (SELECT row_number() OVER (ORDER BY ord) AS ord, * EXCLUDE (ord) FROM chosen), {FAMILIES_ON}
 SELECT * FROM profiles),
best_titles AS (WITH RECURSIVE {BEST} SELECT title, acc, pack, item_name, ts FROM best),
local_deals AS (SELECT r.listing_id, b.item_name AS matched_item, r.effective_price AS offer_price, c.deal_price,
 c.deal_price - r.effective_price AS savings, {override_sql('r.condition', 'r.description')}, ts, {tokens_sql('r.title')} AS toks,
 r.price_flag, r.item_name AS candidate
 FROM routed r JOIN best_titles b USING (title, acc, pack) JOIN catalog c ON c.item_name = b.item_name
 WHERE r.effective_price <= c.deal_price),
all_deals AS (SELECT * FROM model_deals UNION ALL
 SELECT listing_id, matched_item, offer_price, deal_price, savings, final_condition, 'local_fallback', NULL, ts, '{R.REASON_ROUTED}'
 FROM local_deals t JOIN fits p ON p.item_name = t.matched_item
 WHERE t.candidate = t.matched_item AND price_flag NOT IN ('placeholder_zero', 'suspiciously_low', 'bundle_candidate')
 AND {COMPATIBLE} AND ts >= 60 AND listing_id NOT IN (SELECT listing_id FROM model_deals))"""


@query("cascade_deals", f"WITH RECURSIVE {CASCADE} SELECT * FROM all_deals")
def cascade_deals(spark, sf):
    return full_run(spark, sf).deals.select(
        "listing_id", "matched_item", "offer_price", "deal_price", "savings", "final_condition",
        "audit_source", "model_confidence", "local_match_score", "acceptance_reason",
    )
