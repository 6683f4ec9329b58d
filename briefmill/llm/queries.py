"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from briefmill.llm import (
    bpe, decontaminate, filter_audit, html_extract, language_id, licenses, line_templates, minhash, mixing, quality, secrets, url_filter,
    whitening,
)
from briefmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": lambda spark, sf_dir: decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_language_id": lambda spark, sf_dir: language_id.identify(table(spark, sf_dir, "documents")),
    "op3_html_extract": lambda spark, sf_dir: html_extract.articles(table(spark, sf_dir, "pages")),
    "op4_line_templates": lambda spark, sf_dir: line_templates.cleaned(table(spark, sf_dir, "documents"), **line_templates.SHORT),
    "op5_secrets": lambda spark, sf_dir: secrets.digests(table(spark, sf_dir, "documents")),
    "op6_minhash": lambda spark, sf_dir: minhash.near_duplicates(table(spark, sf_dir, "documents")),
    "op7_quality": lambda spark, sf_dir: quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_url_filter": lambda spark, sf_dir: url_filter.judged(table(spark, sf_dir, "pages")),
    "op9_licenses": lambda spark, sf_dir: licenses.summary(table(spark, sf_dir, "documents")),
    "op10_bpe": lambda spark, sf_dir: bpe.digests(table(spark, sf_dir, "documents")),
    "op11_mixing": lambda spark, sf_dir: mixing.taken(table(spark, sf_dir, "documents")),
    "op12_filter_audit": lambda spark, sf_dir: filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_whitening": lambda spark, sf_dir: whitening.whitened(table(spark, sf_dir, "embeddings")),
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op11_mixing": mixing.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
