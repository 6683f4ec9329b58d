"""Documents to lines to section-aware chunks.

One shuffle by document serves the whole job: the section carry-forward, the run numbers,
the packing and the chunk numbers all need the same clustering.  A group is never larger
than one document, which arrives as one text cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.functions import text as T

ROOT_SECTION = "document_root"
MAX_TOKENS = 500


def pages_of(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per page; explicit page breaks separate pages."""
    keep = [c for c in documents.columns if c != text]
    return documents.select(*keep, F.posexplode(F.split(F.col(text), "\f")).alias("page_index", "text"))


def lines_of(pages: DataFrame) -> DataFrame:
    """Stripped non-blank lines with their position on the page."""
    keep = [c for c in pages.columns if c != "text"]
    exploded = pages.select(*keep, F.posexplode(T.split_lines(F.col("text"))).alias("seq", "line"))
    return exploded.withColumn("line", T.strip("line")).filter(F.col("line") != "")


def _reading_order() -> Window:
    return Window.partitionBy("document_name").orderBy("page_index", "seq")


def carry_sections(lines: DataFrame) -> DataFrame:
    """Section in force on every line: the last header seen in the document, across pages."""
    so_far = _reading_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        lines.withColumn("line", T.strip("line"))
        .filter(F.col("line") != "")
        .withColumn("header", T.section_header(F.col("line")))
        .withColumn("section_id", F.coalesce(F.last("header", ignorenulls=True).over(so_far), F.lit(ROOT_SECTION)))
    )


def clauses_of(lines: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per clause with its section, page and token count."""
    return carry_sections(lines).select(
        "document_name", "page_index", "seq", "section_id",
        F.posexplode(bounded_clauses(F.col("line"), max_tokens)).alias("clause_no", "clause"),
    ).withColumn("tokens", T.count_tokens(F.col("clause")))


def bounded_clauses(line: Column, max_tokens: int) -> Column:
    return F.flatten(F.transform(T.split_clauses(line), lambda c: T.split_oversized(c, max_tokens)))


def pack_starts(sizes: Column, max_tokens: int) -> Column:
    """Positions where a new chunk begins when clauses are packed greedily up to the limit.

    The fold copies its array only when a chunk starts, not per clause."""
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts")
    )

    def step(state: Column, size: Column) -> Column:
        opens = (state["at"] == 0) | (state["total"] + size > max_tokens)
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(opens, size).otherwise(state["total"] + size).alias("total"),
            F.when(opens, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, zero, step, lambda state: state["starts"])


def pack_chunks(lines: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Greedy packing inside each run of equal section and page; text joined by a space."""
    order = _reading_order()
    turned = (
        (F.lag("section_id").over(order) != F.col("section_id"))
        | (F.lag("page_index").over(order) != F.col("page_index"))
    )
    runs = (
        carry_sections(lines)
        .withColumn("turn", F.coalesce(turned, F.lit(False)).cast("int"))
        .withColumn("run", F.sum("turn").over(order))
        .withColumn("clauses", bounded_clauses(F.col("line"), max_tokens))
    )
    packed = (
        runs.groupBy("document_name", "run")
        .agg(
            F.first("section_id").alias("section_id"),
            F.first("page_index").alias("absolute_page"),
            F.array_sort(F.collect_list(F.struct("seq", "clauses"))).alias("ordered"),
        )
        .withColumn("clauses", F.flatten(F.transform("ordered", lambda x: x["clauses"])))
        .withColumn("sizes", F.transform("clauses", T.count_tokens))
        .withColumn("starts", pack_starts(F.col("sizes"), max_tokens))
    )

    def cut(k: Column) -> Column:
        start = F.get("starts", k)
        stop = F.coalesce(F.get("starts", k + 1), F.size("clauses"))
        return F.struct(
            F.array_join(F.slice("clauses", start + 1, stop - start), " ").alias("text"),
            F.aggregate(F.slice("sizes", start + 1, stop - start), F.lit(0), lambda a, b: a + b).alias("tokens"),
            (stop - start).alias("clause_count"),
        )

    numbers = F.sequence(F.lit(0), F.size("starts") - 1)
    return packed.select(
        "document_name", "run", "section_id", "absolute_page", F.posexplode(F.transform(numbers, cut)).alias("part", "c")
    ).select("document_name", "run", "part", "section_id", "absolute_page", "c.*")


def build_chunks(lines: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Packed chunks with index, content-derived id and outgoing section references."""
    within = Window.partitionBy("document_name").orderBy("run", "part")
    return (
        pack_chunks(lines, max_tokens)
        .withColumn("chunk_index", F.row_number().over(within) - 1)
        .select(
            F.concat_ws(
                ":", "document_name", F.col("chunk_index").cast("string"), F.substring(F.sha2("text", 256), 1, 16)
            ).alias("chunk_id"),
            "document_name", "chunk_index", "text", "section_id", "absolute_page", "tokens",
            T.section_references(F.col("text")).alias("references_sections"),
        )
    )


def snippets(documents: DataFrame, chunks: DataFrame, limit: int = 1000) -> DataFrame:
    """The first characters of each document's chunk text.

    Every chunk adds at least one character and a line break, so the first ``limit``/2
    chunks always cover the snippet and the rest is never moved."""
    head = (
        chunks.filter(F.col("chunk_index") <= limit // 2)
        .select("document_name", "chunk_index", F.substring("text", 1, limit).alias("text"))
        .groupBy("document_name")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
        .select(
            "document_name",
            F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), 1, limit).alias("snippet"),
        )
    )
    placeholder = F.lit("(No content/metadata extracted)")
    return documents.select("document_name").join(head, "document_name", "left").withColumn(
        "snippet", F.coalesce("snippet", placeholder)
    )
