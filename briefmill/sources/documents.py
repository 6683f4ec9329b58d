"""Document sources: files by extension, content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ACCEPTED = ("pdf", "docx")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with their bytes; only the columns used are read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(folder)
    )


def dispatch(files: DataFrame, path: str = "path") -> DataFrame:
    """Name, type and acceptance of each file by its suffix."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    kind = F.lower(F.regexp_replace(suffix, r"^\.", ""))
    accepted = kind.isin(*ACCEPTED)
    shown = F.when(suffix == "", "<none>").otherwise(suffix)
    return files.select(
        name.alias("document_name"), kind.alias("document_type"), accepted.alias("accepted"),
        F.when(~accepted, F.concat(F.lit("unsupported document type: "), shown)).alias("reason"),
    )


def load(listed: DataFrame, contents: DataFrame) -> DataFrame:
    """Accepted documents with their content, size and fingerprint; those without content carry a reason.

    ``contents``: (document_name, content)."""
    found = listed.filter("accepted").join(contents, "document_name", "left")
    data = F.col("content").cast("binary")
    return found.select(
        "document_name", "document_type", "content", F.length(data).cast("bigint").alias("size"), F.sha2(data, 256).alias("fingerprint"),
        F.when(F.col("content").isNull(), "no content").alias("reason"))


def first_per_fingerprint(documents: DataFrame, order: str = "doc_id", content: str = "text") -> DataFrame:
    """Fingerprint with its first document.  Only hashes are shuffled, combined map-side, so
    a fingerprint shared by a third of the corpus costs one row per input partition."""
    return (
        documents.select(order, F.sha2(F.col(content).cast("binary"), 256).alias("fingerprint"))
        .groupBy("fingerprint")
        .agg(F.min(order).alias(order), F.count("*").alias("copies"))
    )


def without_copies(documents: DataFrame, order: str = "doc_id", content: str = "text") -> DataFrame:
    """Documents that are the first of their fingerprint."""
    return documents.join(first_per_fingerprint(documents, order, content).select(order), order, "left_semi")
