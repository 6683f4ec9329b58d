"""Dictionary classification of chunks: a pure projection, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T

BASE_CONFIDENCE = 0.7
STEP_CONFIDENCE = 0.1
TOP_CONFIDENCE = 0.99
GENERAL = "general"


def classify(
    chunks: DataFrame, taxonomy: Mapping[str, Sequence[str]] | None = None, text: str = "text"
) -> DataFrame:
    """Add clause_type, classification_confidence and matched_terms.

    The type with the most distinct matched terms wins if it leads alone; a tie or no match
    is ``general`` with confidence 0."""
    taxonomy = domains.TAXONOMY if taxonomy is None else taxonomy
    scored = []
    for clause_type, words in taxonomy.items():
        if not words:
            continue
        found = F.array_compact(
            F.array(*[F.when(F.array_contains("_found", word.lower()), F.lit(word)) for word in words])
        )
        scored.append(F.struct(F.lit(clause_type).alias("clause_type"), found.alias("terms")))
    width = lambda x: F.size(x["terms"])
    n_best = F.size(F.col("_leaders")[0]["terms"])
    is_alone = F.size("_leaders") == 1
    return (
        chunks.withColumn("_found", T.phrases_found(F.lower(text), [w for words in taxonomy.values() for w in words]))
        .withColumn("_matches", F.filter(F.array(*scored), lambda x: width(x) > 0))
        .withColumn("_top", F.array_max(F.transform("_matches", width)))
        .withColumn("_leaders", F.filter("_matches", lambda x: width(x) == F.col("_top")))
        .withColumn("clause_type", F.when(is_alone, F.col("_leaders")[0]["clause_type"]).otherwise(GENERAL))
        .withColumn(
            "classification_confidence",
            F.when(is_alone, F.least(BASE_CONFIDENCE + STEP_CONFIDENCE * (n_best - 1), F.lit(TOP_CONFIDENCE)))
            .otherwise(0.0),
        )
        .withColumn(
            "matched_terms",
            F.when(is_alone, F.col("_leaders")[0]["terms"]).otherwise(
                F.array_sort(F.array_distinct(F.flatten(F.transform("_matches", lambda x: x["terms"]))))
            ),
        )
        .drop("_found", "_matches", "_top", "_leaders")
    )


def distribution(chunks: DataFrame) -> DataFrame:
    """Chunks per clause type, largest first."""
    return chunks.groupBy("clause_type").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "clause_type")
