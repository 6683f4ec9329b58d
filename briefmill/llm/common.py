"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.session import scratch_path


SLICE_ROWS = 1_000
# Session settings of Arrow batches: what a task holds on both sides of a Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(SLICE_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of a string column."""
    return F.sha2(value.cast("binary"), 256)


def short_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches; results do not depend on them."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: its size is known, its lineage is cut and it
    survives the loss of executors."""
    short_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a state per task: ``start()`` returns the function applied to slices of each batch, which
    are short so that a Python worker holds little at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                yield step(batch.slice(begin, SLICE_ROWS))
        del step
        give_back_memory()

    short_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS):
    """A broadcast Bloom filter of fixed size over the bigint ``key``, to drop rows where they are read; what passes is
    joined exactly.  Words of 64 bits meet in a partial aggregate."""
    place = f"pmod({key}, {bits})"
    words = keys.groupBy(F.expr(f"cast({place} div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # at most bits / 64 rows
    out[np.asarray(got["word"], np.int64)] = np.asarray(got["bits"], np.int64)
    return keys.sparkSession.sparkContext.broadcast(out)


def may_be_in(key: Column, shipped) -> Column:
    """False only for keys that ``key_filter`` has not seen."""

    @F.arrow_udf("boolean")
    def probe(keys: pa.Array) -> pa.Array:
        words = shipped.value
        at = np.asarray(keys, np.int64) % (len(words) * 64)
        return pa.array((words[at >> 6] >> (at & 63)) & 1 == 1)

    return probe(key)


MOST_HOT = 2_000


def join_hot(rows: DataFrame, known: DataFrame, key: str, copies: str, most_hot: int = MOST_HOT) -> DataFrame:
    """Inner join of ``rows`` with ``known``, which has one row a key and its number of rows in ``copies``.

    Keys of more than one row in ``most_hot`` are joined by broadcast, and there are at most ``most_hot`` of them; no key of
    the other join has more rows than that."""
    total = known.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) > -(-total // most_hot)
    some = known.filter(hot).select(key)
    if some.isEmpty():
        return rows.join(known.drop(copies), key)
    cold = rows.join(F.broadcast(some), key, "left_anti").join(known.filter(~hot).drop(copies), key)
    return cold.unionByName(rows.join(F.broadcast(known.filter(hot).drop(copies)), key))


def give_back_memory() -> None:
    """Return what a task has freed to the system: its Python worker lives on, and would hold it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each value of a string column, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def code_point_offsets(text: bytes, positions: list[int]) -> list[int]:
    """Code-point offsets of ascending byte offsets."""
    out, at, seen = [], 0, 0
    for position in positions:
        seen += len(text[at:position].decode("utf-8", "replace"))
        at = position
        out.append(seen)
    return out
