import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefmill.llm import whitening as w
from tests.llm.fixtures import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, hash string, count string, whitened string, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows], SCHEMA)


def whole(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, by_count=False, components=4):
    """What the contract says, with exact integers and numpy's eigenvectors."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if whole(v)]
    lengths = [len(x) for _, x in kept]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k)) if kept else 0
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = [x for _, x in kept] if by_count else sorted({x for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(s) / n
    v = a.T @ a / n
    e, u = np.linalg.eigh(v)
    out = []
    for i, x in kept:
        deviation = sum((n * c - t) ** 2 for c, t in zip(x, s))
        for k in range(min(components, d)):
            if e[-1 - k] > 1e-12 * e[-1]:
                out.append((i, k + 1, n, deviation, (np.array(x) - np.array(s) / n) @ u[:, -1 - k] / math.sqrt(e[-1 - k]), e[-1 - k] / np.trace(v)))
    return out


def agree(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] <= 1e-4 for r in got) and len({r[6] for r in got}) <= 1
    for k in {r[1] for r in got}:  # either sign, the same for all rows
        a, b = np.array([r[4] for r in got if r[1] == k]), np.array([r[4] for r in want if r[1] == k])
        assert np.allclose(a, b, atol=1e-7) or np.allclose(a, -b, atol=1e-7)


def drawn(n, d, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, (draw.normal(size=d) * np.linspace(1, 0.2, d)).tolist()) for i in range(n)]


def test_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    agree(w.whitened(rows).collect(), brute([(r.vec_id, r.embedding) for r in rows.collect()]))


@pytest.mark.parametrize("by_count", [False, True])
def test_copies_weigh_once_or_by_count(spark, by_count):
    rows = drawn(120, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(90)] + [(5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1])]
    agree(w.whitened(vectors(spark, rows), by_count).collect(), brute(rows, by_count))


def test_hot_vectors_are_joined_by_broadcast(spark):
    rows = drawn(50, 3)
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    distinct = w.quantised(vectors(spark, rows)).groupBy("hash", "x").agg(F.count("*").alias("count"))
    for most_hot in (1, 3, 1000):
        back = w.joined_back(w.quantised(vectors(spark, rows)), distinct.withColumn("value", F.col("x")[0]), most_hot)
        assert back.count() == 150 and back.filter("value != x[0]").count() == 0


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = drawn(30, 3) + [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [0.0, -inf, 0.0]), (104, []), (105, [1.0, 2.0]),
                           (106, [-0.0, 0.0, -1e-9]), (107, [1.5, -2.25, 1e3])]
    got = w.whitened(vectors(spark, rows)).collect()
    agree(got, brute(rows))
    assert {r.vec_id for r in got} == set(range(30)) | {106, 107} and {r.component for r in got} == {1, 2, 3}


def test_no_variance(spark):
    assert w.whitened(vectors(spark, [])).collect() == []
    assert w.whitened(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert w.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]  # one direction only
    got = w.whitened(vectors(spark, flat)).collect()
    agree(got, brute(flat))
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9


def test_deviation_is_exact_beyond_doubles_and_null_beyond_longs(spark):
    rows = [(i, [float(i) * 3e3, float(i % 7)]) for i in range(60)]
    agree(w.whitened(vectors(spark, rows)).collect(), brute(rows))
    wide = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    got = w.whitened(vectors(spark, wide)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and any(r.deviation is None for r in got)


def test_blocks_add_up_in_rounds(spark):
    blocks = spark.range(0, 70, 1, 70).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("block"))
    assert w.summed(blocks).tolist() == [sum(range(70)), 70.0]
    assert w.summed(blocks.limit(0)) is None
