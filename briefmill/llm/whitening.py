"""Embedding whitening (operator 13): covariance over distinct quantised vectors, each whitened once.

1. A vector that is null or holds null or non-finite entries is dropped; each entry c becomes the integer floor(256 c).  The
   dimension is the most frequent length of the remaining vectors, the greater one of a tie; others and empty ones are dropped.
2. Equal integer vectors are grouped with their counts.  A fit weighs each of them once, or by its count.
3. The weights' sum n and the weighted sums S are exact integers.  Each task multiplies its centred block, weighted, with
   itself; the d x d blocks are added up in rounds, and the driver takes one of them apart into eigenvectors.
4. Each distinct vector is projected once, and the result is joined back to the rows.  Vectors held by many rows are
   joined by broadcast, of which there are at most ``MOST_HOT``; no key of the other join has more rows than the bound.

Components whose eigenvalue is at most 1e-12 of the largest have no variance to divide by and are left out, so a single distinct
vector gives no rows; neither does an empty table.  Rows with equal or null ids are rows of their own.  A deviation that does
not fit a long is null.  Entries beyond the range of longs are held at its ends.  Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import short_batches, written

SCALE = 256
COMPONENTS = 4
FAN_IN = 32  # blocks added up by one task
MOST_HOT = 2_000
RANK = 1e-12


def quantised(rows: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(vec_id, hash, x) of the rows whose vector is whole, finite and of the common dimension."""
    vectors = rows.select(F.col(id_).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter((F.size("v") > 0) & finite).select("vec_id", F.transform("v", _floored).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    most = sizes.agg(F.max(F.struct("rows", "d"))).first()[0]
    kept = kept.filter(F.size("x") == (most["d"] if most else 0))
    return kept.select("vec_id", F.xxhash64("x").alias("hash"), "x")


def _floored(c: Column) -> Column:
    scaled = F.floor(c * float(SCALE))
    return F.when(F.abs(c * float(SCALE)) < 2.0**63, scaled).otherwise(F.when(c > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63) + 1))).cast("bigint")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The x column of a batch, one row a vector."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def summed(blocks: DataFrame) -> np.ndarray | None:
    """The sum of all rows of ``blocks`` (block: array<double>), in rounds; None without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column(0):
                values = np.asarray(one.values)
                total = values.copy() if total is None else total + values
        if total is not None:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["block"])

    blocks = written(blocks, "blocks")
    held = blocks.count()
    while held > 1:
        held = -(-held // FAN_IN)
        blocks = written(blocks.repartition(held).mapInArrow(add, "block array<double>"), "blocks")
    found = blocks.first()
    return np.array(found[0]) if found else None


def centred_products(distinct: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum over ``distinct`` (x, weight) of weight times the outer product of x - mean with itself."""
    d = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((d, d)), False
        for batch in batches:
            if batch.num_rows:
                centred = _matrix(batch) - mean
                total += (centred * np.asarray(batch.column("weight"))[:, None]).T @ centred
                held = True
        if held:
            yield pa.record_batch([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], ["block"])

    short_batches(distinct.sparkSession)
    return summed(distinct.select("x", "weight").mapInArrow(multiply, "block array<double>")).reshape(d, d)


def weighted_sums(distinct: DataFrame) -> list:
    """Rows (n, s) by place of the exact sum of the weights and of weight times entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for batch in batches:
            if batch.num_rows:
                x, weight = _matrix(batch), np.asarray(batch.column("weight"))
                most = max(abs(int(x.min())), abs(int(x.max()))) * int(weight.sum())
                own = (weight @ x).tolist() if most < 1 << 63 else (weight.astype(object) @ x.astype(object)).tolist()
                n, s = n + int(weight.sum()), own if s is None else [a + b for a, b in zip(s, own)]
        if s is not None:
            yield pa.record_batch([
                pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0)),
            ], ["place", "n", "s"])

    sums = distinct.select("x", "weight").mapInArrow(add, "place int, n bigint, s decimal(38,0)")
    return sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("place").collect()


class Whitening:
    """Fitted on ``distinct`` (x, weight): n, sums, eigenvalues (falling), components as rows and the variance's share of each."""

    def __init__(self, distinct: DataFrame, components: int):
        sums = weighted_sums(distinct)
        self.n = int(sums[0]["n"]) if sums else 0
        self.sums = [int(r["s"]) for r in sums]
        self.mean = np.array([s / self.n for s in self.sums])
        self.values, self.rows, self.shares = np.zeros(0), np.zeros((0, len(sums))), np.zeros(0)
        if not sums:
            return
        covariance = centred_products(distinct, self.mean) / self.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(values)[::-1][:components]
        order = order[values[order] > RANK * max(values.max(), 0.0)] if values.max() > 0 else order[:0]
        self.values, self.rows = values[order], vectors[:, order].T
        self.shares = self.values / np.trace(covariance)


def projected(distinct: DataFrame, fit: Whitening) -> DataFrame:
    """``distinct`` with ``deviation`` and ``whitened``, an array of one number a component."""
    n, sums, mean = fit.n, fit.sums, fit.mean
    axes = (fit.rows / np.sqrt(fit.values)[:, None]).T

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            # exact in 64 bits if the largest sum of squares fits, else by Python's integers
            most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
            if most * most * len(sums) < 1 << 63:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x.tolist()]
            yield pa.record_batch([
                *(batch.column(c) for c in ("hash", "x", "count")), pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                pa.array(list((x - mean) @ axes), pa.list_(pa.float64())),
            ], ["hash", "x", "count", "deviation", "whitened"])

    short_batches(distinct.sparkSession)
    return distinct.select("hash", "x", "count").mapInArrow(
        step, "hash bigint, x array<bigint>, count bigint, deviation bigint, whitened array<double>")


def joined_back(rows: DataFrame, distinct: DataFrame, most_hot: int = MOST_HOT) -> DataFrame:
    """``rows`` (vec_id, hash, x) with the columns of their ``distinct`` vector."""
    total = distinct.agg(F.sum("count")).first()[0] or 0
    bound = -(-total // most_hot)  # at most most_hot vectors are above it
    result = distinct.drop("count")
    hashes = [r[0] for r in distinct.filter(F.col("count") > bound).select("hash").distinct().collect()]
    if not hashes:
        return rows.join(result, ["hash", "x"])
    is_hot = F.col("hash").isin(hashes)
    cold = rows.filter(~is_hot).join(result.filter(~is_hot), ["hash", "x"])
    return cold.unionByName(rows.filter(is_hot).join(F.broadcast(result.filter(is_hot)), ["hash", "x"]))


def whitened(rows: DataFrame, by_count: bool = False, components: int = COMPONENTS, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = quantised(rows, vector, id_)
    distinct = written(vectors.groupBy("hash", "x").agg(F.count("*").alias("count")), "distinct")
    weighted = distinct.withColumn("weight", F.col("count") if by_count else F.lit(1).cast("bigint"))
    fit = Whitening(weighted, components)
    k = len(fit.values)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    done = written(projected(distinct, fit), "whitened")
    weight = F.col("count") if by_count else F.lit(1)
    means = done.agg(*[(F.sum(F.col("whitened")[i] * weight) / F.sum(weight)).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = done.agg(*[
        F.sum((F.col("whitened")[i] - means[i]) * (F.col("whitened")[j] - means[j]) * weight) / F.sum(weight) for i, j in pairs]).first()
    error = max(abs(value - (i == j)) for (i, j), value in zip(pairs, products))
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col("whitened")[i].alias("value"), F.lit(float(fit.shares[i])).alias("share")) for i in range(k)])
    return joined_back(vectors, done).select("vec_id", "deviation", F.explode(parts).alias("p")).select(
        "vec_id", "p.component", F.lit(fit.n).cast("bigint").alias("n"), "deviation", F.col("p.value").alias("whitened"),
        F.col("p.share").alias("explained"), F.lit(float(error)).alias("identity_error"))
