"""Which specialists a deal needs: dictionary matches per chunk, never a joined corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T


def contains_term(body: Column, edged: Column, term: str) -> Column:
    """Word-bounded test after runs of ``_`` and ``-`` became spaces, on both sides;
    ``body`` is ``routing_text`` of the text and ``edged`` its ``word_edges``, computed once per row."""
    return T.has_phrase(body, edged, T.routing_term(term))


def _found(rows: DataFrame, text: str, registry: Sequence[dict], *columns: str) -> DataFrame:
    """``rows`` with the routing terms ``found`` in their texts."""
    terms = [T.routing_term(term) for entry in registry for term in entry["routing_terms"]]
    return rows.select(*columns, T.phrases_found(T.routing_text(F.col(text)), terms).alias("found"))


def _matches(clause_type: Column | None, registry: Sequence[dict]) -> Column:
    """Array of (agent_no, place, match) for one row of ``_found``; a projection, no shuffle."""
    found = []
    for number, entry in enumerate(registry):
        for place, term in enumerate(entry["routing_terms"]):
            hit = F.struct(F.lit(number).alias("agent_no"), F.lit(place).alias("place"), F.lit(term).alias("match"))
            found.append(F.when(F.array_contains("found", T.routing_term(term)), hit))
        if clause_type is None:
            continue
        for place, kind in enumerate(entry["clause_types"], len(entry["routing_terms"])):
            hit = F.struct(F.lit(number).alias("agent_no"), F.lit(place).alias("place"), F.lit(kind).alias("match"))
            found.append(F.when((clause_type == kind) & (clause_type != "general"), hit))
    return F.array_compact(F.array(*found))


def specialists(deal_documents: DataFrame, chunks: DataFrame, registry: Sequence[dict] | None = None) -> DataFrame:
    """(deal, agent, matched_terms, used_fallback): agents with any term or clause-type match;
    a deal without one gets every agent.

    ``deal_documents`` has (deal_id, document_name).  Matches are reduced to distinct
    (document, agent, term) rows first, then per deal, so a hot deal costs at most
    registry-many rows per partition."""
    registry = domains.REGISTRY if registry is None else registry
    spark = chunks.sparkSession
    in_text = _found(chunks, "text", registry, "document_name", "clause_type").select("document_name", F.inline(_matches(F.col("clause_type"), registry)))
    names = _found(deal_documents.select("document_name").distinct(), "document_name", registry, "document_name")
    # A new key, since Spark takes a union of two sides dealt by one key for dealt by it too, and fails where their counts differ.
    in_name = names.select(F.concat("document_name", F.lit("")).alias("document_name"), F.inline(_matches(None, registry)))
    per_document = in_text.unionByName(in_name).distinct()
    per_deal = deal_documents.join(per_document, "document_name").select("deal_id", "agent_no", "place", "match").distinct()
    agents = domains.frame(spark, [(i, r["agent"]) for i, r in enumerate(registry)], "agent_no int, agent string")
    chosen = (
        per_deal.groupBy("deal_id", "agent_no")
        .agg(F.array_sort(F.collect_set(F.struct("place", "match"))).alias("ordered"))
        .join(agents, "agent_no")
        .select(
            "deal_id", "agent", F.array_distinct(F.transform("ordered", lambda x: x["match"])).alias("matched_terms"),
            F.lit(False).alias("used_fallback"),
        )
    )
    return chosen.unionByName(_everyone(deal_documents, per_deal, registry))


def _everyone(deals: DataFrame, matched: DataFrame, registry: Sequence[dict]) -> DataFrame:
    everyone = F.array(*[F.lit(r["agent"]) for r in registry])
    return (
        deals.select("deal_id").distinct().join(matched.select("deal_id").distinct(), "deal_id", "left_anti")
        .select("deal_id", F.explode(everyone).alias("agent"), F.array().cast("array<string>").alias("matched_terms"),
                F.lit(True).alias("used_fallback"))
    )


def suggested(suggestions: DataFrame, deterministic: DataFrame, registry: Sequence[dict] | None = None) -> DataFrame:
    """Known suggested agents per deal; a deal without a known one keeps the deterministic
    plan, flagged as fallback."""
    registry = domains.REGISTRY if registry is None else registry
    known = [r["agent"] for r in registry]
    valid = suggestions.filter(F.col("agent").isin(known)).select("deal_id", "agent").distinct()
    fallback = deterministic.join(valid.select("deal_id").distinct(), "deal_id", "left_anti").select(
        "deal_id", "agent", "matched_terms", F.lit(True).alias("used_fallback")
    )
    return valid.select(
        "deal_id", "agent", F.array().cast("array<string>").alias("matched_terms"), F.lit(False).alias("used_fallback")
    ).unionByName(fallback)


def enrich_findings(findings: DataFrame) -> DataFrame:
    """Default dimension and domain label of the finding's agent."""
    agents = domains.agents(findings.sparkSession).select("agent", F.col("default_dimension"), "domain")
    return findings.join(agents, "agent", "left").select(
        *findings.columns,
        F.coalesce("default_dimension", F.lit("risk_exposure")).alias("dimension"),
        F.coalesce("domain", F.lit("")).alias("domain"),
    )
