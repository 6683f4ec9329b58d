"""Documents with every awkward case, and plain reference computations."""

from __future__ import annotations

import random

from pyspark.sql import types as t

SF = "/root/testdata/sf0.001"

# Extra columns carry names that the operators use themselves.
DOCUMENTS = t.StructType([
    t.StructField("doc_id", t.LongType()), t.StructField("text", t.StringType()), t.StructField("lang", t.StringType()),
    t.StructField("source", t.StringType()), t.StructField("n_chars", t.LongType()),
    *(t.StructField(name, t.StringType()) for name in ("ids", "node", "kept", "n_words", "label", "matches", "features", "spans", "class", "doc")),
])


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    parts = ["th", "er", "an", "in", "ou", "re", "st", "ti", "on", "ea"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n)]


def awkward_rows() -> list[tuple]:
    base = " ".join(words(1, 120))
    near = base.replace(base.split()[60], "changed", 1)
    long = " ".join(words(2, 60_000))
    rows = [
        (1, base, "en", "a.example.de"), (2, near, "en", None), (3, base, None, "a.example.de"), (3, base, None, "a.example.de"),
        (4, None, "en", "b"), (5, "", "en", "b"), (6, " \n\t ", "xx", ""), (7, long, "de-AT", "b"), (None, base + " tail of words", "en", "b"),
        (None, None, None, None), (8, "one", "en", "b"), (8, "two words", "en", "b"), (9, "Ünïcödé “quoted” — 日本語 🙂 ﬁ", "EN_us", "b.example.fr"),
        (10, "<|endoftext|>a<|endoftext|>", "en", "b"), (11, "aaaa " * 50, "en", "b"), (12, "\0 nul \x1c\x1d \x85 \u2028 x", "en", "b"),
    ]
    return [(*row, len(row[1] or ""), *["x"] * 10) for row in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


def docs_of(spark, rows):
    """(doc_id, text) rows as a documents table."""
    return spark.createDataFrame([(i, x, "en", "src", len(x or ""), *["x"] * 10) for i, x in rows], DOCUMENTS)


def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
