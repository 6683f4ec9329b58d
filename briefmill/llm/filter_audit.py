"""Filter interaction audit (operator 12): what each of five filters removes under every order of applying them.

1. One pass over the texts gives each document the bits of filters A to D and a 64-bit hash of its text, kept as a narrow
   table.  A null text is an empty one.
2. Filter E (a text equal to that of a smaller doc_id) is prepared by a counting Bloom filter over the hashes: each
   task counts in two-bit counters, the sketches are added up in rounds, and a hash with a counter of one is of a text that no other
   row has.  The sketch has ``CELLS`` counters a document; beyond ``MOST_CELLS`` the hashes are dealt into as many
   shards as keep a sketch below it, one after the other, so its size is bounded and no result changes.
3. Only texts that may repeat are shuffled, whole, for the least doc_id of each text, copies being reduced before the shuffle.
   A document fails E unless it is the least of its text: (hash, doc_id) is looked up among the least ones, so a
   text with a third of all rows is spread by doc_id.  Hashes that two texts share are told apart by the texts.
4. Bits and labels give counts by part and mask of failed filters, which add up to every figure of all 120 orders.

Rows with equal ids are documents of their own, a null id is neither smaller nor larger than another, and a null
source counts with the empty one.  Labels of a document are joined by doc_id, any 1 counting; null ids have none.  An
empty table gives no rows.  Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import short_batches, written

# The filters' letters, in the order of their bits.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CELLS = 8  # counters a document
HASHES = 3
MOST_CELLS = 1 << 26  # two bits each: 16 MB
FAN_IN = 32  # sketches added up by one task


def own_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * upper > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Counters of each hash, one row a hash function; a power of two of cells."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) & np.uint64(cells - 1)).astype(np.int64) for k in range(HASHES)])


def _packed(counters: np.ndarray) -> bytes:
    """Counters of 0, 1 or 2 (many), four in a byte."""
    c = counters.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    c = np.frombuffer(packed, np.uint8)
    return np.stack([c >> k & 3 for k in (0, 2, 4, 6)], axis=1).reshape(-1)


def counting_sketch(hashes: DataFrame, cells: int) -> bytes | None:
    """The packed counters of all rows of ``hashes`` (hash); None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(cells, np.uint8)
        for batch in batches:
            # a hash whose functions meet in one cell counts there once
            own = np.sort(_cells(np.asarray(batch.column(0)), cells), axis=0)
            fresh = np.vstack([np.ones((1, own.shape[1]), bool), own[1:] != own[:-1]])
            at, times = np.unique(own[fresh], return_counts=True)
            counters[at] = np.minimum(counters[at] + np.minimum(times, 2), 2)
        yield pa.record_batch([pa.array([_packed(counters)], pa.binary())], ["sketch"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for batch in batches:
            for sketch in batch.column(0):
                one = _unpacked(sketch.as_py())
                counters = one.copy() if counters is None else np.minimum(counters + one, 2)
        if counters is not None:
            yield pa.record_batch([pa.array([_packed(counters)], pa.binary())], ["sketch"])

    short_batches(hashes.sparkSession)
    sketches = written(hashes.select("hash").mapInArrow(count, "sketch binary"), "sketches")
    held = sketches.count()
    while held > 1:
        held = -(-held // FAN_IN)
        sketches = written(sketches.repartition(held).mapInArrow(add, "sketch binary"), "sketches")
    found = sketches.first()
    return bytes(found[0]) if found else None


def _may_repeat(hash_: Column, shipped, cells: int) -> Column:
    """Whether all counters of a hash are above one."""

    @F.arrow_udf("boolean")
    def probe(hashes: pa.Array) -> pa.Array:
        packed = np.frombuffer(shipped.value, np.uint8)
        at = _cells(np.asarray(hashes), cells)
        return pa.array((packed[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3 > 1).all(axis=0))

    return probe(hash_)


def text_sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def masks(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """Per row: doc_id, part and the mask of the filters that it fails."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    flags = written(texts.select("doc_id", "part", own_mask(F.col("text")).alias("mask"), text_sha(F.col("text")).alias("sha")), "flags")
    count = flags.count()
    shards = max(1, -(-count * CELLS // most_cells))
    cells = 1 << max(10, (-(-count * CELLS // shards) - 1).bit_length())
    # the upper bits of a hash deal it out, the lower ones place it
    hashed = {"hash": F.xxhash64("sha"), "shard": F.pmod(F.shiftrightunsigned(F.xxhash64("sha"), 40), F.lit(shards))}
    rows = ids = None
    for shard in range(shards):
        own = flags.withColumns(hashed).filter(F.col("shard") == shard)
        sketch = counting_sketch(own, cells)
        if sketch is None:
            continue
        may_repeat = _may_repeat(F.col("hash"), sc.broadcast(sketch), cells)
        repeated = texts.withColumn("sha", text_sha(F.col("text"))).withColumns(hashed).filter(F.col("shard") == shard).filter(may_repeat)
        least = written(
            repeated.groupBy("text").agg(F.min("doc_id").alias("least")).select(text_sha(F.col("text")).alias("of"), "least"), "least-ids")
        judged = written(own.select("doc_id", "part", "mask", "sha", may_repeat.alias("may_repeat")), "judged")
        rows, ids = (judged, least) if rows is None else (rows.unionByName(judged), ids.unionByName(least))
    if rows is None:
        return flags.drop("sha")
    met = rows.filter("may_repeat").join(ids, (F.col("sha") == F.col("of")) & (F.col("doc_id") == F.col("least")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("least").isNull()
    failing = met.withColumn("mask", F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
    return failing.select("doc_id", "part", "mask").unionByName(rows.filter("not may_repeat").select("doc_id", "part", "mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: documents ``n``, of them ``good`` and ``toxic`` ones."""
    one = labels.groupBy(F.col("doc_id").cast("bigint").alias("of")).agg(
        F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic"))
    known = masks.join(one.filter("of is not null"), F.col("doc_id") == F.col("of"), "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return known.groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def _total(what: str, holds) -> Column:
    """Sum of a count over the masks of a part for which ``holds``."""
    return F.aggregate("cells", F.lit(0).cast("bigint"), lambda sum_, cell: sum_ + F.when(holds(cell["mask"]), cell[what]).otherwise(F.lit(0)))


def interactions(counts: DataFrame) -> DataFrame:
    """The figures of every part, order and step from the counts of at most 32 masks a part."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, len(FILTERS) + 1)])))
    bits = steps.withColumns({
        "bit": sum((F.when(F.substring("filter_order", F.col("step"), F.lit(1)) == x, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0)),
        "ahead": sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0)),
    })
    bit, ahead = F.col("bit"), F.col("ahead")

    def here(mask: Column) -> Column:
        return (mask.bitwiseAND(bit) != 0) & (mask.bitwiseAND(ahead) == 0)

    # among the k filters that a document fails, each comes first in 120 / k of the orders
    first_of = F.array(*[F.lit(factorial(len(FILTERS)) // max(k, 1)).cast("bigint") for k in range(len(FILTERS) + 1)])
    shapley = F.aggregate("cells", F.lit(0).cast("bigint"), lambda sum_, cell: sum_ + F.when(
        cell["mask"].bitwiseAND(bit) != 0, cell["n"] * first_of[F.bit_count(cell["mask"])]).otherwise(F.lit(0)))
    return bits.select(
        "part", "filter_order", "step",
        _total("n", lambda m: m.bitwiseAND(ahead + bit) == 0).alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(ahead) != 0)).alias("redundant"),
        _total("n", lambda m: m == bit).alias("unique_fails"),
        _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(written(mask_counts(masks(docs, most_cells), labels), "mask-counts"))


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from t),
l as (select doc_id as of, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > least, false)} as fails
  from w left join l on doc_id = of),
f as (
  select part, good, toxic, (case when fails['A'] then 'A' else '' end) || (case when fails['B'] then 'B' else '' end)
    || (case when fails['C'] then 'C' else '' end) || (case when fails['D'] then 'D' else '' end) || (case when fails['E'] then 'E' else '' end) as failing
  from m),
c as (select part, failing, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
o as (
  select a || b || c || d || e as filter_order
  from (select unnest(['A', 'B', 'C', 'D', 'E']) as a), (select unnest(['A', 'B', 'C', 'D', 'E']) as b), (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
    (select unnest(['A', 'B', 'C', 'D', 'E']) as d), (select unnest(['A', 'B', 'C', 'D', 'E']) as e)
  where len(list_distinct([a, b, c, d, e])) = 5),
s as (
  select part, filter_order, step, substr(filter_order, step, 1) as letter, failing, n, good, toxic,
    least(case when contains(failing, 'A') then strpos(filter_order, 'A') else 6 end, case when contains(failing, 'B') then strpos(filter_order, 'B') else 6 end,
      case when contains(failing, 'C') then strpos(filter_order, 'C') else 6 end, case when contains(failing, 'D') then strpos(filter_order, 'D') else 6 end,
      case when contains(failing, 'E') then strpos(filter_order, 'E') else 6 end) as first_step
  from c, o, (select unnest([1, 2, 3, 4, 5]) as step)),
p as (
  select part, filter_order, step, letter, sum(case when first_step > step then n else 0 end)::bigint as kept,
    sum(case when first_step = step then n else 0 end)::bigint as removed,
    sum(case when contains(failing, letter) and first_step < step then n else 0 end)::bigint as redundant,
    sum(case when failing = letter then n else 0 end)::bigint as unique_fails,
    sum(case when first_step = step then good else 0 end)::bigint as good_lost,
    sum(case when first_step = step then toxic else 0 end)::bigint as toxic_lost
  from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from p
"""
