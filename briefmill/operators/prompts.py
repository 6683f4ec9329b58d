"""Prompt tables: one row per unit of batch inference, for any scorer that reads a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_block(document: str, section: str, page: str, text: str) -> Column:
    """Text marked as data that must not be followed."""
    return F.concat(
        F.lit('<untrusted_source doc_id="'), F.col(document), F.lit('" section="'), F.col(section), F.lit('" page="'),
        F.col(page).cast("string"), F.lit('">\n'), F.col(text), F.lit("\n</untrusted_source>"))


def analysis_prompts(hits: DataFrame, chunks: DataFrame, agents: DataFrame) -> DataFrame:
    """One prompt per (agent, chunk)."""
    joined = hits.select("agent", "chunk_id").join(chunks, "chunk_id").join(agents.select("agent", "domain"), "agent")
    return joined.select(
        "agent", "chunk_id",
        F.concat(F.lit("Analyze the following passage for "), "domain", F.lit(" issues.\n\n"),
                 source_block("document_name", "section_id", "absolute_page", "text")).alias("prompt"))


def debate_prompts(plan: DataFrame, findings: DataFrame, questions: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One prompt per (persona, finding, round) of a plan, with the compressed earlier rounds."""
    rows = plan.join(findings.select("finding_id", "claim", "citation", "confidence"), "finding_id").join(questions, "dimension")
    if context is None:
        rows = rows.withColumn("previous_context", F.lit(""))
    else:
        rows = rows.join(context, ["deal_id", "dimension", "round"], "left").withColumn(
            "previous_context", F.coalesce("previous_context", F.lit("")))
    earlier = F.when(F.col("previous_context") != "", F.concat(
        F.lit("\n\nPREVIOUS ROUND CONTEXT (compressed):\n"), "previous_context")).otherwise("")
    return rows.select(
        "finding_id", "persona", "round",
        F.concat(
            F.lit("DEBATE DIMENSION: "), "dimension", F.lit("\nCORE QUESTION: "), "core_question", F.lit("\nROUND: "),
            F.col("round").cast("string"), F.lit("\n\nFINDING UNDER DEBATE:\n  Claim: "), "claim", F.lit("\n  Citation: "), "citation",
            F.lit("\n  Current Confidence: "), "confidence", earlier).alias("prompt"))
