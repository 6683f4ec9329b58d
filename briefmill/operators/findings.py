"""Findings: severity, deduplication, dimensions and activation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T


def _any_word(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def assign_severity(findings: DataFrame, confidence: str = "confidence_num") -> DataFrame:
    """Clause-type thresholds give the base; claim keywords lift low ones by rule."""
    limits = domains.clause_types(findings.sparkSession).select("clause_type", "critical_min", "high_min", "medium_min")
    value = F.col(confidence)
    critical, high, medium = domains.DEFAULT_THRESHOLDS
    base = (
        F.when(value >= F.coalesce("critical_min", F.lit(critical)), "critical")
        .when(value >= F.coalesce("high_min", F.lit(high)), "high")
        .when(value >= F.coalesce("medium_min", F.lit(medium)), "medium")
        .otherwise("low")
    )
    claim = F.lower("claim")
    severity = (
        F.when(_any_word(claim, domains.CRITICAL_WORDS),
               F.when(F.col("base").isin("low", "medium"), "high").otherwise(F.col("base")))
        .when(_any_word(claim, domains.HIGH_WORDS) & (F.col("base") == "low"), "medium")
        .otherwise(F.col("base"))
    )
    return (
        findings.join(limits, "clause_type", "left").withColumn("base", base)
        .withColumn("severity", severity).drop("base", "critical_min", "high_min", "medium_min")
    )


KEY = ["deal_id", "section_id", "citation"]


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per (deal, section, citation): highest confidence, earliest on a tie.

    Processing findings in sequence keeps the references of each finding that took the
    lead, and adds the agent of every finding merged away.  There are three confidence
    levels, so at most three findings of a key ever take the lead: the first of a level,
    if nothing as high came before.  That makes the sequence an aggregate with bounded
    state, combined map-side, however many copies a key has."""
    place = F.struct("seq", "finding_id")
    rank = T.rank_of(F.col("confidence"), domains.CONFIDENCE_RANK)
    ranked = findings.withColumn("rank", rank)
    leaders = ranked.groupBy(*KEY, "rank").agg(
        F.min(place).alias("place"),
        F.min_by(F.struct("finding_id", "agent", "confidence", "cross_refs"), place).alias("row"),
    )
    per_key = leaders.groupBy(*KEY).agg(F.collect_list(F.struct("rank", "place", "row")).alias("firsts"))
    took_lead = F.filter(
        "firsts",
        lambda x: ~F.exists("firsts", lambda y: (y["rank"] > x["rank"]) & (y["place"] < x["place"])),
    )
    refs = F.flatten(F.transform(took_lead, lambda x: F.coalesce(x["row"]["cross_refs"], F.array().cast("array<string>"))))
    kept = per_key.select(*KEY, F.array_max("firsts")["row"].alias("kept"), refs.alias("refs"))
    counted = (
        findings.groupBy(*KEY, "agent").agg(F.count("*").alias("n"))
        .groupBy(*KEY).agg(F.collect_list(F.struct("agent", "n")).alias("agents"), F.sum("n").alias("copies"))
    )
    merged = F.transform(
        F.filter("agents", lambda a: a["n"] > F.when(a["agent"] == F.col("kept")["agent"], 1).otherwise(0)),
        lambda a: a["agent"],
    )
    return kept.join(counted, KEY).select(
        *KEY, F.col("kept.finding_id").alias("finding_id"), F.col("kept.agent").alias("agent"),
        F.col("kept.confidence").alias("confidence"), "copies",
        F.array_sort(F.array_distinct(F.concat("refs", merged))).alias("cross_refs"),
    )


def dispatch_summary(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Per deal: findings, unique findings, agents dispatched and failed."""
    counts = (
        findings.groupBy(*KEY).agg(F.count("*").alias("n"))
        .groupBy("deal_id").agg(F.sum("n").alias("total_findings"), F.count("*").alias("unique_findings"))
    )
    per_agent = runs.groupBy("deal_id", "agent").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    dispatched = per_agent.groupBy("deal_id").agg(
        F.count("*").alias("agents_dispatched"), F.count_if("failed").alias("agents_failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(dispatched, "deal_id", "full").select(
        "deal_id", *[zero(c) for c in ("total_findings", "unique_findings", "agents_dispatched", "agents_failed")])


def map_dimension(findings: DataFrame) -> DataFrame:
    """Two-key lookup, then the agent's default, then the finding's own dimension."""
    spark = findings.sparkSession
    lookup = domains.frame(spark, domains.DIMENSION_LOOKUP, "agent string, clause_type string, by_pair string")
    default = domains.agents(spark).select("agent", F.col("default_dimension").alias("by_agent"))
    own = F.col("dimension") if "dimension" in findings.columns else F.lit(None).cast("string")
    return (
        findings.withColumn("_own", own).join(lookup, ["agent", "clause_type"], "left").join(default, "agent", "left")
        .withColumn("dimension", F.coalesce("by_pair", "by_agent", "_own"))
        .drop("by_pair", "by_agent", "_own")
    )


def dimension_gate(deals: DataFrame, findings: DataFrame) -> DataFrame:
    """Every deal with all dimensions: how deep each one is debated."""
    counts = findings.groupBy("deal_id", "dimension").agg(F.count("*").alias("findings_count"))
    names = F.array(*[F.lit(d) for d in domains.DIMENSIONS])
    questions = domains.dimensions(findings.sparkSession).select("dimension", "core_question")
    count = F.coalesce("findings_count", F.lit(0))
    everyone = F.array(*[F.lit(p) for p in domains.PERSONAS])
    few = F.array(*[F.lit(p) for p in domains.LIMITED_PERSONAS])
    is_full, is_limited = count >= domains.FULL_DEBATE_MINIMUM, count >= 1
    return (
        deals.select("deal_id").distinct().withColumn("dimension", F.explode(names))
        .join(counts, ["deal_id", "dimension"], "left").join(questions, "dimension")
        .select(
            "deal_id", "dimension", count.alias("findings_count"),
            F.when(is_full, "full").when(is_limited, "limited").otherwise("skipped").alias("mode"),
            F.when(is_full, everyone).when(is_limited, few).otherwise(F.array().cast("array<string>")).alias("personas"),
            F.when(is_full, domains.MAX_ROUNDS).when(is_limited, 1).otherwise(0).alias("max_rounds"),
            "core_question",
        )
    )


def evidence_gaps(gate: DataFrame) -> DataFrame:
    """Audit rows for dimensions without findings."""
    return gate.filter(F.col("mode") == "skipped").select(
        "deal_id", F.lit("evidence_gap_record").alias("event_type"), F.lit("dimension_gate").alias("actor"),
        F.concat(F.lit("Dimension '"), "dimension", F.lit("' skipped due to insufficient evidence (0 findings).")).alias("description"),
        F.to_json(F.struct("dimension", "findings_count")).alias("raw_payload"),
    )
