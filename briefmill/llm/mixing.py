"""Mixing sources to target weights (operator 11): weighted fair queueing over shuffled documents.

1. A document's size is its number of words.  Sources in code-point order, null last, take their weights in turn.
   A source's target is its share of the budget by weight, at most ``repeats`` times its size; what a full source
   leaves over is shared among the others by weight until none is above.  Each round is one aggregate over the sources.
2. A source's queue is its documents in the order of a seeded hash, ``repeats`` times over, each pass in an order of its own.
   The virtual finish time of an entry is the words of its source's queue up to it, divided by the source's target.
   A queue is cut by hash into ranges of a few thousand entries: range sums give offsets, a window runs within a range,
   so a source with a third of all documents is spread like the others.
3. All entries are range-sorted by finish time and the mix ends where the budget is used up: ranges before the
   end are in, ranges after it are out, and only the range that holds the end is summed entry by entry.
   Documents are taken whole, so a source misses its target by less than the entry at its end.

The order depends on doc_id, source and size only, so reruns agree.  A null text has size 0; documents of size 0 are in
no queue and take nothing.  Repeated rows are documents of their own.  A null source is a source of its own.  A table
without words has targets of 0; an empty table gives an empty one.  Extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from briefmill.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the budget as a fraction of all sizes
REPEATS = 2
RANGE_ROWS = 4_000  # entries of a queue that are summed by one window
KEY_BITS = 60


def shuffle_key(doc_id: Column, turn: Column) -> Column:
    """A seeded place in [0, 2^60) of a document in the given pass."""
    name = F.concat(turn.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def before(df: DataFrame, part: str, order: str, amount: str) -> DataFrame:
    """``df`` of one row a range, with the sum of ``amount`` over the ranges before it: ``offset``."""
    ahead = W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(amount).over(ahead), F.lit(0)))


def ranged(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows as a table dealt into ranges of the order, numbered by ``range``."""
    return written(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("range", F.spark_partition_id()), label)


def weighted_sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row a source: its documents with words, size, place in code-point order and weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("bigint")).alias("documents"))
    placed = ranged(sums, ["source"], "sources")
    counts = before(placed.groupBy("range").agg(F.count("*").alias("rows")).withColumn("all", F.lit(0)), "all", "range", "rows")
    own = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    numbered = placed.withColumn("own", own).join(counts.select("range", "offset"), "range")
    place = F.col("own") + F.col("offset") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("bigint")
    return numbered.select("source", "source_size", "documents", place.alias("place"), weight.alias("weight"))


def targeted(sources: DataFrame, share: tuple[int, int], repeats: int) -> DataFrame:
    """``sources`` with ``target``.  The level num / den is what one unit of weight gets."""
    sources = written(sources, "weighted")
    most = repeats * F.col("source_size")
    total, full = sources.agg(F.sum("source_size"), F.lit(0)).first()
    total, full = total or 0, full or 0
    if share[0] > repeats * share[1]:
        raise ValueError("the budget is more than all repeats of all documents")
    above = F.lit(False)
    while True:
        weight = sources.filter(~above).agg(F.sum("weight")).first()[0]
        num, den = share[0] * total - share[1] * repeats * full, share[1] * (weight or 1)
        due = F.col("weight") * F.lit(num).cast("bigint") / F.lit(den).cast("bigint")
        above = due > most
        now = sources.filter(above).agg(F.sum("source_size")).first()[0] or 0
        if now <= full:
            break
        full = now
    return sources.withColumn("target", F.when(above, most.cast("double")).otherwise(due))


def queues(sized: DataFrame, sources: DataFrame, repeats: int) -> DataFrame:
    """Entries (row, doc_id, size, place, turn, key, source_size, target, finish) of all queues."""
    known = sources.withColumnRenamed("source", "of")
    cuts = F.ceil(F.col("documents") / RANGE_ROWS)
    entries = (
        sized.filter("size > 0").join(known, sized["source"].eqNullSafe(known["of"]))
        .withColumn("turn", F.explode(F.array(*[F.lit(k) for k in range(1, repeats + 1)])))
        .withColumn("key", shuffle_key(F.col("doc_id"), F.col("turn")))
        .withColumn("cut", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * cuts))
        .select("row", "doc_id", "size", "place", "turn", "key", "cut", "source_size", "target")
    )
    sums = entries.groupBy("place", "turn", "cut").agg(F.sum("size").alias("sum"))
    offsets = before(sums.withColumn("order", F.struct("turn", "cut")), "place", "order", "sum").select("place", "turn", "cut", "offset")
    own = F.sum("size").over(W.partitionBy("place", "turn", "cut").orderBy("key", F.col("doc_id"), "size").rowsBetween(W.unboundedPreceding, 0))
    summed = entries.withColumn("own", own).join(offsets, ["place", "turn", "cut"])
    return summed.withColumn("finish", (F.col("own") + F.col("offset")) / F.col("target")).drop("own", "offset", "cut")


ORDER = ["finish", "place", "turn", "key", "doc_id", "size"]


def truncated(entries: DataFrame, most: int) -> DataFrame:
    """The ``entries`` that fit into ``most`` words, in the order of their finish times."""
    entries = ranged(entries, ORDER, "finish-times")
    sums = entries.groupBy("range").agg(F.sum("size").alias("sum")).withColumn("all", F.lit(0))
    ends = before(sums, "all", "range", "sum").withColumn("end", F.col("offset") + F.col("sum"))
    last = ends.filter(F.col("end") > most).agg(F.min(F.struct("range", "offset"))).first()[0]
    if last is None:
        return entries.drop("range")
    upto = F.sum("size").over(W.partitionBy("range").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER]).rowsBetween(W.unboundedPreceding, 0))
    at_end = entries.filter(F.col("range") == last["range"]).withColumn("upto", upto + F.lit(last["offset"])).filter(F.col("upto") <= most)
    return entries.filter(F.col("range") < last["range"]).unionByName(at_end.drop("upto")).drop("range")


def _prepared(docs: DataFrame, weights: tuple[int, ...], share: tuple[int, int], repeats: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint")
    sized = written(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"),
        F.monotonically_increasing_id().alias("row")), "sized")
    sources = written(targeted(weighted_sources(sized, weights), share, repeats), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return sized, sources, written(truncated(queues(sized, sources, repeats), share[0] * total // share[1]), "mix")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The mix, one row a document taken, to be read by ``finish``: doc_id, source, turn, size, finish."""
    _, sources, mix = _prepared(docs, weights, share, repeats)
    return mix.join(sources.select("place", "source"), "place").select("doc_id", "source", "turn", "size", "finish")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (its words in the mix, repeats counted)."""
    sized, sources, mix = _prepared(docs, weights, share, repeats)
    known = sources.select(F.col("source").alias("of"), "source_size", "target")
    in_mix = mix.groupBy("row").agg(F.sum("size").alias("in_mix"))
    return (
        sized.join(in_mix, "row", "left").join(known, sized["source"].eqNullSafe(known["of"]))
        .select("doc_id", "size", "source_size", "target", F.coalesce("in_mix", F.lit(0)).cast("bigint").alias("taken"))
    )


ORACLE_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, row_number() over () as row from documents),
s as (
  select *, row_number() over (order by source nulls last) - 1 as place from (
    select source, sum(size)::bigint as source_size from sized group by source)),
w as (select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, (sum(source_size) over ())::bigint as total from s),
a as (
  select *, coalesce(sum(source_size) over p, 0) as full_size, sum(weight) over () - coalesce(sum(weight) over p, 0) as open_weight
  from w window p as (order by source_size / weight, place rows between unbounded preceding and 1 preceding)),
l as (
  select arg_min((3 * total - 4 * full_size)::bigint, source_size / weight) as num, arg_min((2 * open_weight)::bigint, source_size / weight) as den
  from a where weight * (3 * total - 4 * full_size) <= 4 * source_size * open_weight),
t as (
  select place, source, source_size, total,
    case when weight * num / den > 2 * source_size then (2 * source_size)::double else weight * num / den end as target
  from w, l),
q as (
  select row, doc_id, size, place, turn, total, target, ('0x' || substr(md5(turn || ':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from sized join t on sized.source is not distinct from t.source, (select unnest([1, 2]) as turn) where size > 0),
f as (
  select *, sum(size) over (partition by place order by turn, key, doc_id, size rows unbounded preceding)::bigint / target as finish from q),
m as (
  select *, sum(size) over (order by finish, place, turn, key, doc_id, size rows unbounded preceding) as upto from f),
k as (select row, sum(size) as in_mix from m where 2 * upto <= 3 * total group by row)
select doc_id, size::bigint as size, source_size, target, coalesce(in_mix, 0)::bigint as taken
from sized join t on sized.source is not distinct from t.source left join k using (row)
"""
