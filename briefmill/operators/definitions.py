"""Defined terms: read them from a definitions section and map them onto chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefmill.functions import text as T

# ---- fixed values: patterns of definition headers and sentences ----
_HEADING = r"(?i)^\s*(?:Section|Article|Appendix)\s*\d*(?:\.\d*)*\s*"
START = _HEADING + r"DEFINITIONS\b"
NEXT_HEADING = _HEADING + r"(?!DEFINITIONS\b)[A-Z0-9]"
_VERB = r"\s+(?:shall\s+)?(?:means?|have\s+the\s+meaning|refers\s+to)\s+([^.;\n]+)"
_MARKS = "\"'“”‘’"
QUOTED = rf"(?i)[{_MARKS}]([^{_MARKS}]{{2,50}})[{_MARKS}]" + _VERB
UNQUOTED = r"(?i)^\s*([A-Z][A-Za-z0-9\s]{1,49})" + _VERB
SHORT_CAPITALS = 40


def definition_lines(lines: DataFrame) -> DataFrame:
    """Lines of each document's first definitions block."""
    order = Window.partitionBy("document_name").orderBy("page_index", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    capitals = (
        (F.upper(line) == line) & (F.lower(line) != line)
        & (F.length(line) < SHORT_CAPITALS) & ~F.upper(line).contains("DEFINITIONS")
    )
    return (
        lines.withColumn("line", T.strip("line")).filter(F.col("line") != "")
        .withColumn("starts", line.rlike(START))
        .withColumn("stops", ~F.col("starts") & (line.rlike(NEXT_HEADING) | capitals))
        .withColumn("started", F.max("starts").over(so_far))
        .withColumn("ended", F.max(F.col("started") & F.col("stops")).over(so_far))
        .filter(F.col("started") & ~F.col("ended"))
        .select("document_name", "page_index", "seq", "line")
    )


def definitions(lines: DataFrame) -> DataFrame:
    """Term and definition per document; the later definition of a term wins."""
    line = F.col("line")
    quoted = F.regexp_extract(line, QUOTED, 1) != ""
    part = lambda n: F.when(quoted, F.regexp_extract(line, QUOTED, n)).otherwise(
        F.regexp_extract(line, UNQUOTED, n)
    )
    return (
        definition_lines(lines)
        .select("document_name", "page_index", "seq", T.strip(part(1)).alias("term"), T.strip(part(2)).alias("definition"))
        .filter(F.length("term") >= 2)
        .groupBy("document_name", "term")
        .agg(F.max_by("definition", F.struct("page_index", "seq")).alias("definition"))
    )


def defined_terms_in_chunks(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk, term, definition) for the document's terms that occur in the chunk,
    case-sensitive and on word boundaries."""
    boundary = F.expr(r"text rlike concat('(?U)\\b\\Q', term, '\\E\\b')")
    return (
        chunks.select("chunk_id", "document_name", "text")
        .join(terms, "document_name")
        .filter(F.col("text").contains(F.col("term")) & boundary)
        .select("chunk_id", "term", "definition")
    )


def defined_terms_map(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """Chunk to map of its defined terms; a group is bounded by one document's terms."""
    return (
        defined_terms_in_chunks(chunks, terms)
        .groupBy("chunk_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "definition")))).alias("defined_terms"))
    )
