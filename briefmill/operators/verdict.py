"""Judge decisions and the verdict report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T
from briefmill.operators import search
from briefmill.session import cut_lineage

PART_LENGTH = 4  # leading characters of an id that make a range of the ranking
OPEN_STATES = ["contested", "unresolved"]
KEY = ["deal_id", "dimension"]


def judge_candidates(findings: DataFrame, states: DataFrame) -> DataFrame:
    """Findings of contested or unresolved dimensions; settled ones never reach the judge."""
    return findings.join(states.filter(F.col("state").isin(OPEN_STATES)).select(*KEY, "state"), KEY)


def with_arguments(candidates: DataFrame, arguments: DataFrame) -> DataFrame:
    columns = ["argument_id", "persona", "round", "stance", "dropout_flag"]
    return candidates.join(arguments.select("finding_id", *columns), "finding_id", "left")


def calibrated_confidence(findings: DataFrame, arguments: DataFrame) -> DataFrame:
    """Mean weight of the arguments that did not drop out; one half without any.

    Weights are added up as whole tenths, so a mean, and any rank by it, does not depend on the order of the rows."""
    tenths = F.round(T.rank_of(F.col("confidence"), domains.CONFIDENCE_WEIGHT).cast("double") * 10).cast("bigint")
    means = arguments.filter(~F.col("dropout_flag")).groupBy("finding_id").agg(F.round(F.sum(tenths) / (10 * F.count(tenths)), 6).alias("mean"))
    return findings.select("finding_id").join(means, "finding_id", "left").select(
        "finding_id", F.coalesce("mean", F.lit(0.5)).alias("calibrated_confidence"))


def evidence_queries(candidates: DataFrame, size: int = 5) -> DataFrame:
    return candidates.filter(F.col("state") == "unresolved").select(
        F.col("finding_id").alias("query_id"),
        F.concat_ws(" ", F.when(F.col("section_id") != "", F.col("section_id")),
                    F.when(F.coalesce("citation", F.lit("")) != "", F.col("citation")).otherwise(F.col("claim"))).alias("text"),
        F.array().cast("array<string>").alias("expanded_terms"), F.lit(None).cast("string").alias("document_name"),
        F.array("clause_type").alias("clause_types"), F.lit(size).alias("size"),
    )


def evidence_missing(candidates: DataFrame, index: search.Index, whole: bool = True) -> DataFrame:
    """Unresolved findings whose section and citation are found nowhere under their clause type.

    With ``whole`` every chunk of the section counts; else its first 50, whatever their types."""
    queries = cut_lineage(evidence_queries(candidates))
    found = search.section_or_bm25(index, queries, whole).select("query_id").distinct()
    return queries.join(found, "query_id", "left_anti").select(F.col("query_id").alias("finding_id"))


def judge(findings: DataFrame, states: DataFrame, missing: DataFrame, decisions: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Status of every finding: settled is confirmed, missing evidence is named, a decision
    counts as given, and no decision is an override to look at."""
    joined = (
        findings.select("finding_id", *KEY).join(states.select(*KEY, "state"), KEY)
        .join(missing.withColumn("is_missing", F.lit(True)), "finding_id", "left")
        .join(decisions, "finding_id", "left").join(calibrated, "finding_id", "left")
    )
    settled, gone = F.col("state") == "settled", F.col("is_missing").isNotNull()
    decided = F.col("status").isNotNull()
    return joined.filter(F.col("state").isin(*OPEN_STATES, "settled")).select(
        "finding_id", *KEY,
        F.when(settled, "confirmed").when(gone, "evidence_not_found").when(decided, F.col("status")).otherwise("overridden").alias("status"),
        F.when(settled | gone, False).when(decided, F.col("judge_override_flag")).otherwise(True).alias("judge_override_flag"),
        F.when(settled, "Finding was already SETTLED.").when(gone, "Evidence not found during final exact-match pass.")
        .when(decided, F.col("synthesis_rationale")).otherwise("LLM failure: no decision").alias("synthesis_rationale"),
        F.when(settled, 0.0).otherwise(F.col("calibrated_confidence")).alias("calibrated_confidence"),
    )


# ---- report ------------------------------------------------------------------------------------


def _with_state(findings: DataFrame, states: DataFrame) -> DataFrame:
    return findings.join(states.select(*KEY, "state"), KEY, "left").withColumn("state", F.coalesce("state", F.lit("active")))


def severity_rank(column: str = "severity") -> Column:
    return T.rank_of(F.lower(column), domains.SEVERITY_RANK)


def brief(findings: DataFrame, states: DataFrame, judged: DataFrame) -> DataFrame:
    """Findings settled or confirmed by the judge with their rank in the deal, worst first.

    Ranks come in two steps, so that no deal is ranked in one task: counts per (deal, severity, confidence,
    part of the id's hash range) give each part its offset, and a row is numbered inside its part only."""
    result = judged.select("finding_id", F.col("status").alias("judge_status"), "calibrated_confidence")
    confirmed = F.coalesce(F.col("judge_status") == "confirmed", F.lit(False))
    rows = (
        _with_state(findings, states).join(result, "finding_id", "left")
        .filter((F.col("state") == "settled") | confirmed)
        .select(
            "deal_id", "finding_id", "claim", "severity", F.coalesce("calibrated_confidence", F.lit(1.0)).alias("confidence"),
            "dimension", F.col("citation").alias("section_citation"), "clause_type",
        )
    )
    return ranked(rows)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` in the deal by severity, confidence and finding id.

    Ids are cut into ranges by their leading characters, which sort as the ids do."""
    place = ["deal_id", "_severity", "_confidence", "_part"]
    keyed = rows.withColumns({
        "_severity": -severity_rank(), "_confidence": -F.col("confidence"),
        "_part": F.substring(F.col("finding_id").cast("string"), 1, PART_LENGTH)})
    counts = keyed.groupBy(*place).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("deal_id").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*place).orderBy(F.col("finding_id").cast("string")))
    return keyed.withColumn("_inside", inside).join(offsets, place).select(
        *rows.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias("rank"))


def escalations(findings: DataFrame, states: DataFrame, arguments: DataFrame, judged: DataFrame) -> DataFrame:
    """Open findings with their arguments by round, contradiction and dropout flags and the
    judge's notes.  A finding has one argument per persona and round, so its list is bounded."""
    item = F.struct("round", "argument_id", "persona", "stance", "argument", F.col("confidence").alias("calibrated_confidence"))
    told = (
        arguments.groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(item)).alias("arguments"), F.bool_or("contradiction_flag").alias("has_contradictions"),
             F.bool_or("dropout_flag").alias("has_dropouts"))
    )
    notes = judged.select("finding_id", F.col("judge_override_flag").alias("judge_override"), F.col("synthesis_rationale").alias("judge_notes"))
    no = F.lit(False)
    return (
        _with_state(findings, states).filter(F.col("state").isin(OPEN_STATES))
        .join(told, "finding_id", "left").join(notes, "finding_id", "left")
        .select(
            "deal_id", "finding_id", "claim", "dimension", "arguments",
            F.coalesce("has_contradictions", no).alias("has_contradictions"), F.coalesce("has_dropouts", no).alias("has_dropouts"),
            F.coalesce("judge_override", no).alias("judge_override"), F.coalesce("judge_notes", F.lit("")).alias("judge_notes"),
        )
    )


def gaps(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """Claims whose evidence was not found, one row each."""
    lost = findings.join(judged.filter(F.col("status") == "evidence_not_found").select("finding_id"), "finding_id", "left_semi")
    return lost.select(*KEY, "finding_id", F.col("claim").alias("missing_claim"))


def gap_summary(gap_rows: DataFrame) -> DataFrame:
    """Per dimension with gaps: how many claims lack evidence, and the fixed remedies."""
    remedies = F.array(*[F.lit(r) for r in domains.GAP_REMEDIES])
    return gap_rows.groupBy(*KEY).agg(F.count("*").alias("missing_claims")).withColumn("suggested_remedies", remedies)


def skipped_dimensions(deals: DataFrame, states: DataFrame) -> DataFrame:
    """Dimensions a deal has no state for."""
    names = F.array(*[F.lit(d) for d in domains.DIMENSIONS])
    return deals.select("deal_id").distinct().withColumn("dimension", F.explode(names)).join(
        states.select(*KEY), KEY, "left_anti")


SECTIONS = ["brief", "escalations", "gaps", "skipped_dimensions"]


def documents(brief_rows: DataFrame, escalation_rows: DataFrame, gap_rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """The verdicts of all deals as item rows: (deal_id, section, position, item_id, item).

    Sections and positions order a deal's rows; ``item`` is JSON.  No cell holds a group."""
    def part(number: int, rows: DataFrame, position: Column, ident: Column, fields: list[str]) -> DataFrame:
        return rows.select(
            "deal_id", F.lit(SECTIONS[number]).alias("section"), position.cast("bigint").alias("position"), ident.alias("item_id"),
            F.to_json(F.struct(*fields)).alias("item"))

    none = F.lit(None)
    return (
        part(0, brief_rows, F.col("rank"), F.col("finding_id"), ["rank", "finding_id", "claim", "severity", "confidence", "dimension", "section_citation", "clause_type"])
        .unionByName(part(1, escalation_rows, none, F.col("finding_id"), [
            "finding_id", "claim", "dimension", "arguments", "has_contradictions", "has_dropouts", "judge_override", "judge_notes"]))
        .unionByName(part(2, gap_rows, none, F.col("finding_id"), ["dimension", "finding_id", "missing_claim"]))
        .unionByName(part(3, skipped, none, F.col("dimension"), ["dimension"]))
    )


def document_counts(deals: DataFrame, document_rows: DataFrame) -> DataFrame:
    """One row per deal: the number of items of each section, 0 included."""
    counts = document_rows.groupBy("deal_id").agg(*(F.count_if(F.col("section") == s).alias(s) for s in SECTIONS))
    return deals.select("deal_id").distinct().join(counts, "deal_id", "left").na.fill(0, SECTIONS)


def document_of(document_rows: DataFrame, deals: DataFrame) -> DataFrame:
    """Nested JSON verdicts of chosen ``deals``; a deal's items meet in one row, so choose few."""
    chosen = document_rows.join(deals.select("deal_id").distinct(), "deal_id", "left_semi")
    items = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("position", "item_id", "item")))), lambda x: x["item"])
    grouped = chosen.groupBy("deal_id").agg(*(items(s).alias(s) for s in SECTIONS))
    listed = lambda s: F.concat(F.lit(f'"{s}":['), F.array_join(s, ","), F.lit("]"))
    return grouped.select("deal_id", F.concat(F.lit("{"), F.concat_ws(",", *map(listed, SECTIONS)), F.lit("}")).alias("verdict"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("deal_id").pivot("severity", domains.SEVERITIES).count().na.fill(0)


def findings_table(findings: DataFrame, dimension: str | None = None) -> DataFrame:
    """Findings by severity, optionally of one dimension."""
    rows = findings if dimension is None else findings.filter(F.col("dimension") == dimension)
    return rows.withColumn("severity_rank", severity_rank()).orderBy(F.desc("severity_rank"), "finding_id")
