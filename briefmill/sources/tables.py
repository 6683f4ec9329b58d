"""Persistent tables on plain files: caches, state, versioned upserts, append-only logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from briefmill import domains

CHUNK_SCHEMA = (
    "chunk_id string, document_name string, chunk_index int, text string, section_id string, absolute_page int, "
    "references_sections array<string>, clause_type string, classification_confidence double, "
    "matched_terms array<string>, defined_terms map<string,string>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path can be listed, asked through Spark's own readers."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_chunk_cache(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """JSON chunk cache; a missing cache is empty and corrupt records are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("chunk_id").isNotNull())


def last_write_wins(batches: DataFrame, key: str = "chunk_id", order: str = "batch") -> DataFrame:
    """Newest record per key over numbered batches, as a map-side aggregate."""
    keep = [c for c in batches.columns if c not in (key, order)]
    return batches.groupBy(key).agg(
        F.max(order).alias(order), F.max_by(F.struct(*keep), order).alias("row")).select(key, order, "row.*")


def write_chunk_cache(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("errorifexists").json(path)


def known_states(states: DataFrame) -> DataFrame:
    """Dimension states whose dimension and state names are in the domain."""
    return states.filter(F.col("dimension").isin(domains.DIMENSIONS) & F.col("state").isin(domains.DIMENSION_STATES))


def upsert(existing: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without the delta's keys, plus the delta."""
    return existing.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


def merge_states(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Dimension states with new values where given; unknown keys are inserted."""
    keys = ["deal_id", "dimension"]
    values = [c for c in existing.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return existing.join(renamed, keys, "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def indexing_outcome(delta: DataFrame) -> DataFrame:
    """Attempted, indexed and failed rows of an upsert; a chunk needs an id and text."""
    good = (F.length(F.coalesce("chunk_id", F.lit(""))) > 0) & (F.length(F.coalesce("text", F.lit(""))) > 0)
    return delta.agg(F.count("*").alias("attempted"), F.count_if(good).alias("indexed"), F.count_if(~good).alias("errors"))


class VersionedTable:
    """Upserts as appended versions; the newest version of a key counts when the table is read.

    A batch is evaluated once and writes its own rows only, as many tasks as it has partitions.  Versions are
    numbered; a retried batch writes its number again and replaces what its first try left.  Reading costs
    as many rows as were ever written, so compact on a schedule, for instance whenever the versions
    hold twice the rows of the last compaction."""

    def __init__(self, spark: SparkSession, path: str, *keys: str) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def rows(self, schema, before: int | None = None) -> DataFrame:
        """All rows with their ``version``, of versions below ``before`` if given."""
        names = f"{schema}, version bigint" if isinstance(schema, str) else t.StructType([*schema.fields, t.StructField("version", t.LongType())])
        if not exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], names)
        stored = self.spark.read.schema(names).parquet(f"{self.path}/data")
        return stored if before is None else stored.filter(F.col("version") < before)

    def read(self, schema, before: int | None = None) -> DataFrame:
        """The newest row of every key."""
        rows = self.rows(schema, before)
        keep = [c for c in rows.columns if c not in (*self.keys, "version")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*keep), "version").alias("row"))
        return newest.select(*self.keys, "row.*").select(*[c for c in rows.columns if c != "version"])

    def upsert(self, delta: DataFrame, version: int | None = None) -> None:
        """Write a batch with unique keys as one version, by default the next."""
        if version is None:
            version = 0
            if exists(self.spark, f"{self.path}/data"):
                version = (self.spark.read.schema("version bigint").parquet(f"{self.path}/data").agg(F.max("version")).first()[0] or 0) + 1
        delta.write.mode("overwrite").parquet(f"{self.path}/data/version={version}")

    def compact(self, schema, path: str) -> "VersionedTable":
        """A table at a new path with the newest rows as its only version; readers move to it, and the
        old path goes when none reads it any more."""
        last = self.spark.read.schema("version bigint").parquet(f"{self.path}/data").agg(F.max("version")).first()[0]
        out = VersionedTable(self.spark, path, *self.keys)
        out.upsert(self.read(schema), last)
        return out


def append_audit(events: DataFrame, path: str, days: str = "event_time") -> None:
    """Append events, laid out by day so that one busy deal does not become one directory."""
    events.withColumn("day", F.to_date(days)).write.mode("append").partitionBy("day").parquet(path)


def append_only_violations(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of the earlier snapshot that were deleted or changed in the later one."""
    values = sorted(c for c in before.columns if c != key)
    digest = lambda df, name: df.select(key, F.xxhash64(*values).alias(name))
    joined = digest(before, "_old").join(digest(after, "_new"), key, "left")
    return joined.select(
        key, F.when(F.col("_new").isNull(), "deleted").when(F.col("_new") != F.col("_old"), "updated").alias("violation")
    ).filter(F.col("violation").isNotNull())


def transcript_rows(arguments: DataFrame) -> DataFrame:
    """The arguments of a round as they are recorded, one row each."""
    return arguments.select(
        "deal_id", "round", "argument_id", "finding_id", "persona", "stance", "argument", "confidence", "dropout_flag", "contradiction_flag")


def round_transcript(arguments: DataFrame) -> DataFrame:
    """Summary per deal and round: argument count, personas, stances, dropouts, contradictions.

    Lists that name a persona once per argument are kept as persona=count pairs, so a round
    of a hot deal stays six entries wide; the stance is the persona's last one."""
    per_persona = arguments.groupBy("deal_id", "round", "persona").agg(
        F.count("*").alias("n"), F.max_by("stance", "argument_id").alias("stance"),
        F.count_if("dropout_flag").alias("dropouts"), F.count_if("contradiction_flag").alias("contradictions"))

    def pairs(count: str):
        shown = F.when(F.col(count) > 0, F.concat_ws("=", "persona", F.col(count).cast("string")))
        return F.array_sort(F.collect_list(shown))

    return per_persona.groupBy("deal_id", "round").agg(
        F.sum("n").alias("argument_count"), pairs("n").alias("personas"),
        F.array_sort(F.collect_list(F.concat_ws("=", "persona", "stance"))).alias("stances"),
        pairs("dropouts").alias("dropouts"), pairs("contradictions").alias("contradictions"),
    ).withColumn(
        "description", F.concat(F.lit("Round "), "round", F.lit(" complete: "), "argument_count", F.lit(" arguments recorded.")))
