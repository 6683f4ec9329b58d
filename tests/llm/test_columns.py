import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SF

# names that the operators use themselves
INTERNAL = [
    "row", "own", "doc", "positions", "salt", "copy", "may_lose", "own_id", "own_text", "worded", "text_key", "node", "label", "class", "buckets",
    "matches", "_scan", "_at", "items", "n_words", "n_hit", "spans", "key", "least", "copies", "component", "hash", "_id", "_text", "_doc",
    "_positions", "_n_dropped", "n_dropped", "_lid_host", "host", "language", "Text2", "a.b",
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_named_like_internal_ones_come_back(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{x}:"), F.col("doc_id")).alias(x) for x in INTERNAL])
    got = stage(spark, wide, SF)
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[x] == f"{x}:{r['doc_id']}" for r in rows for x in INTERNAL)
    assert sorted(r["doc_id"] for r in rows) == sorted(r.doc_id for r in stage(spark, docs, SF).collect())
