"""The two stages as one plan, with the auditor as a DataFrame-to-DataFrame callable."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermatch import rules as R
from offermatch.operators import audits as A
from offermatch.operators.candidates import annotate_listings, find_candidates
from offermatch.operators.deals import accept_audited, build_deals
from offermatch.operators.matching import accept_local_deals, local_deals
from offermatch.session import stored


class AuditTables(NamedTuple):
    """What an auditor returns: judgements, and the candidates it could not judge."""

    audits: DataFrame
    fallback: DataFrame
    errors: DataFrame
    unknown: DataFrame
    summary: DataFrame


class Cascade(NamedTuple):
    deals: DataFrame
    candidates: DataFrame
    listings: DataFrame
    audit: AuditTables


Auditor = Callable[[DataFrame, DataFrame], AuditTables]


def response_auditor(responses: DataFrame, size: int = R.AUDIT_CHUNK,
                     whitelist: str = "first") -> Auditor:
    """An auditor over a table of recorded responses, one per chunk of candidates."""
    def audit(candidates: DataFrame, cat: DataFrame) -> AuditTables:
        single = A.dedup_candidates(candidates, ["seq"]).drop("seq")
        # Requests, which their numbering writes, and parsed judgements are each read by several branches.
        chunks = A.chunk_candidates(single, ["cand_ord", "ord"], size)
        allowed = A.allowed_targets(candidates, ["seq"], whitelist)
        parts = A.reconcile_audits(stored(A.explode_audits(responses), "judgements"), chunks)
        gate = A.whitelist_gate(parts["valid"], allowed, cat)
        summary = A.chunk_summary(chunks, responses)
        failed = summary.filter(~F.col("succeeded"))
        fallback = A.route_fallback(chunks, failed, parts["missing"], gate["errors"])
        return AuditTables(
            gate["valid"], fallback, parts["errors"].unionByName(gate["errors"]),
            parts["unknown"], summary,
        )

    return audit


def fallback_deals(fallback: DataFrame, cat: DataFrame, reason: str = R.REASON_ROUTED) -> DataFrame:
    """Local matches of the routed candidates, at their effective price, tagged as fallback."""
    rows = fallback.withColumn("price", F.col("effective_price")).drop(
        "item_name", "ord", "deal_price", "effective_price", "lexical_score"
    )
    found = local_deals(rows, cat)
    return found.withColumns({
        "audit_source": F.lit(R.LOCAL_SOURCE), "local_match_score": F.col("match_score"),
        "acceptance_reason": F.lit(reason),
    })


def cascade(listings: DataFrame, cat: DataFrame, auditor: Auditor, order: list[str],
            include_local: bool = False) -> Cascade:
    """Candidates, annotation, judgements, acceptance; local deals only fill ids still open.

    ``order`` is the total order of the listings.  The candidate table is written because several branches read it;
    a checkpoint would first rewrite every constraint that its long plan implies, which takes the planner hours.
    """
    keep = [c for c in listings.columns if c not in ("eligible_target_names", "price_flag")]
    found = find_candidates(listings, cat, keep)
    found = found.withColumn("cand_ord", F.struct(*order)).withColumn(
        "seq", F.struct("cand_ord", "ord")
    )
    candidates = stored(found, "candidates")
    annotated = annotate_listings(listings, candidates, order)
    audit = auditor(candidates, cat)
    accepted = accept_audited(
        audit.audits, candidates, cat, ["chunk_number", "pos"]
    )
    deals = build_deals(accepted)
    if include_local:
        routed = audit.fallback.withColumn("seq", F.col("cand_ord"))
        local = accept_local_deals(fallback_deals(routed, cat), routed, cat)
        rest = local.join(deals.select("listing_id"), "listing_id", "left_anti")
        deals = deals.unionByName(
            rest.select([c for c in rest.columns if c in deals.columns and c != "match_score"]),
            allowMissingColumns=True,
        )
    return Cascade(deals, candidates, annotated, audit)
