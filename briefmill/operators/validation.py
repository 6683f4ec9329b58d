"""Record checks: every rule is a predicate, rejects carry the names of the rules they broke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from briefmill import domains
from briefmill.functions import text as T


def _failed(rules: dict[str, Column]) -> Column:
    """Names of rules that do not hold; an unknown result counts as broken."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()
    ]))


def _filled(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit(""))) >= 1


def check_findings(raw: DataFrame) -> DataFrame:
    """Raw findings with coerced confidence and the list of broken rules."""
    confidence = T.coerce_confidence(F.col("confidence"))
    rules = {name: _filled(name) for name in ("finding_id", "claim", "citation", "citation_chunk_id", "section_id")}
    rules |= {
        "source_agent": F.col("agent").isin(domains.AGENTS),
        "clause_type": F.col("clause_type").isin(domains.CLAUSE_TYPES),
        "dimension": F.col("dimension").isNull() | F.col("dimension").isin(domains.DIMENSIONS),
        "severity": F.col("severity").isNull() | F.col("severity").isin(domains.SEVERITIES),
        "absolute_page": F.col("absolute_page") >= 0,
        "confidence": confidence.isNotNull(),
    }
    return raw.withColumn("failed_rules", _failed(rules)).withColumn("confidence", confidence)


def split_findings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid findings, and one audit row per rejected one."""
    checked = check_findings(raw)
    valid = checked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    audit = checked.filter(F.size("failed_rules") > 0).select(
        "deal_id", F.lit("finding_validation_failure").alias("event_type"), F.lit("findings_aggregator").alias("actor"),
        F.concat(F.lit("Finding schema validation failure in deal "), "deal_id", F.lit(": "),
                 F.array_join("failed_rules", ",")).alias("description"),
        F.to_json(F.struct("finding_id", "claim", "agent", "section_id")).alias("raw_payload"),
        "finding_id",
    )
    return valid, audit


def check_arguments(arguments: DataFrame) -> DataFrame:
    """Arguments with the rules they break: a steelman is mandatory and must not be blank."""
    rules = {name: _filled(name) for name in ("argument_id", "finding_id", "argument")}
    rules |= {
        "steelman": T.strip(F.coalesce("steelman", F.lit(""))) != "",
        "persona": F.col("persona").isin(domains.PERSONAS),
        "round": F.col("round").between(1, domains.MAX_ROUNDS),
        "dimension": F.col("dimension").isin(domains.DIMENSIONS),
        "stance": F.col("stance").isin(domains.STANCES),
        "confidence": T.coerce_confidence(F.col("confidence")).isNotNull(),
    }
    return arguments.withColumn("failed_rules", _failed(rules))


def check_layout(elements: DataFrame) -> DataFrame:
    """Coordinates come all together or not at all, and in order."""
    box = ["x0", "top", "x1", "bottom"]
    present = sum((F.col(c).isNotNull().cast("int") for c in box), F.lit(0))
    rules = {
        "text": _filled("text"),
        "complete": present.isin(0, len(box)),
        "non_negative": ~F.coalesce(F.least(*box) < 0, F.lit(False)),
        "x_order": F.coalesce(F.col("x1") >= F.col("x0"), F.lit(True)),
        "y_order": F.coalesce(F.col("bottom") >= F.col("top"), F.lit(True)),
    }
    return elements.withColumn("failed_rules", _failed(rules))


RESPONSE = t.StructType([
    t.StructField("claim", t.StringType()), t.StructField("citation", t.StringType()),
    t.StructField("confidence", t.DoubleType()), t.StructField("_corrupt", t.StringType()),
])
ERROR_EXCERPT = 500


def parse_responses(responses: DataFrame) -> DataFrame:
    """Model response text to typed columns, with an error for the ones that need repair."""
    parsed = F.from_json("raw_text", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ok = lambda c: F.length(F.coalesce(c, F.lit(""))) >= 1
    error = (
        F.when(F.col("p._corrupt").isNotNull() | F.col("p").isNull(), "invalid json")
        .when(~ok(F.col("p.claim")), "claim is required")
        .when(~ok(F.col("p.citation")), "citation is required")
        .when(~F.coalesce(F.col("p.confidence").between(0.0, 1.0), F.lit(False)), "confidence out of range")
    )
    return responses.withColumn("p", parsed).select(
        "request_id", F.col("p.claim").alias("claim"), F.col("p.citation").alias("citation"),
        F.col("p.confidence").alias("confidence"), error.alias("error"),
        F.when(error.isNotNull(), F.substring("raw_text", 1, ERROR_EXCERPT)).alias("excerpt"),
    )


def keep_relevant(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop a hit only when its verdict is an explicit no; a missing verdict keeps it."""
    rejected = verdicts.filter(~F.col("relevant"))
    return hits.join(rejected, ["agent", "chunk_id"], "left_anti")


def confidence_scale(categories: DataFrame, column: str = "confidence") -> DataFrame:
    """Rank and numeric weight of each category, usable in comparisons."""
    return categories.withColumn("rank", T.rank_of(F.col(column), domains.CONFIDENCE_RANK)).withColumn(
        "weight", T.rank_of(F.col(column), domains.CONFIDENCE_WEIGHT).cast("double"))
