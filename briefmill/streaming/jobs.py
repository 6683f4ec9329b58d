"""Structured Streaming jobs, each with a batch twin of the same result.

Growing results live in tables, not in unbounded operator state.  A micro-batch is reduced with
map-side aggregates and written as a version of its own number, so a retried batch replaces what
its first try left; it reads only versions below its number.  Readers merge the versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from briefmill import domains
from briefmill.operators import chunking, classify, hitl
from briefmill.sources.documents import first_per_fingerprint
from briefmill.sources.tables import VersionedTable

RECENT_EVENTS = 200


def file_stream(spark: SparkSession, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(each).start()
    )
    finish(query)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ---- documents -------------------------------------------------------------------------------


FINGERPRINTS = "fingerprint string, doc_id bigint, copies bigint"


def ingest_unique(documents: DataFrame, target: str, checkpoint: str) -> None:
    """Record every batch's fingerprints with their first document and copies.

    A batch costs its own size, whatever is stored already."""

    def each(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, target, "fingerprint").upsert(first_per_fingerprint(batch), number)

    run_available(documents, checkpoint, each)


def unique_documents(spark: SparkSession, target: str, schema: str = FINGERPRINTS) -> DataFrame:
    """First document and copies of every fingerprint over all batches."""
    return VersionedTable(spark, target, "fingerprint").rows(schema).groupBy("fingerprint").agg(
        F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))


def unique_within(documents: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Variant with bounded state: copies are recognised within the watermark only."""
    fingerprint = F.sha2(F.col("text").cast("binary"), 256)
    return documents.withColumn("fingerprint", fingerprint).withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def chunk_delta(
    documents: DataFrame, to_lines: Callable[[DataFrame], DataFrame], table: str, checkpoint: str,
    taxonomy: dict[str, Sequence[str]] | None = None,
) -> None:
    """Chunk, classify and upsert arriving documents without rebuilding the rest."""

    def each(batch: DataFrame, number: int) -> None:
        fresh = classify.classify(chunking.build_chunks(to_lines(batch)), taxonomy)
        VersionedTable(batch.sparkSession, table, "chunk_id").upsert(fresh, number)

    run_available(documents, checkpoint, each)


# ---- events ------------------------------------------------------------------------------------


def latest_phase(events: DataFrame) -> DataFrame:
    """Newest phase per deal and its progress; the same expression on streams and tables."""
    newest = events.groupBy("deal_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"), F.count("*").alias("events"))
    return _with_percent(newest)


def _with_percent(phases: DataFrame) -> DataFrame:
    percent = F.create_map(*[F.lit(x) for pair in domains.PHASE_PERCENT.items() for x in pair])
    return phases.withColumn("percent", F.coalesce(percent[F.col("status")], F.lit(0)))


PHASES = "deal_id bigint, status string, seq bigint, ts timestamp, events bigint"


def follow_phases(events: DataFrame, table: str, checkpoint: str) -> None:
    """Keep each batch's newest phase of the deals it names."""

    def each(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("deal_id").agg(
            F.max_by(F.struct("status", "seq", "ts"), F.struct("ts", "seq")).alias("row"), F.count("*").alias("events"))
        VersionedTable(batch.sparkSession, table, "deal_id").upsert(newest.select("deal_id", "row.*", "events"), number)

    run_available(events, checkpoint, each)


def current_phases(spark: SparkSession, table: str, schema: str = PHASES) -> DataFrame:
    """What ``latest_phase`` gives for all events, from the batches' rows."""
    merged = VersionedTable(spark, table, "deal_id").rows(schema).groupBy("deal_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"), F.sum("events").alias("events"))
    return _with_percent(merged)


def most_recent(events: DataFrame, limit: int = RECENT_EVENTS) -> DataFrame:
    """The newest ``limit`` events per deal; the rank bound cuts partitions before the shuffle."""
    newest = Window.partitionBy("deal_id").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= limit)


def follow_recent(events: DataFrame, table: str, checkpoint: str, limit: int = RECENT_EVENTS) -> None:
    """Keep each batch's newest events per deal; no later reader can need others."""

    def each(batch: DataFrame, number: int) -> None:
        top = most_recent(batch, limit).drop("recency")
        VersionedTable(batch.sparkSession, table, "deal_id", "seq").upsert(top, number)

    run_available(events, checkpoint, each)


def recent_events(spark: SparkSession, table: str, schema, limit: int = RECENT_EVENTS) -> DataFrame:
    return most_recent(VersionedTable(spark, table, "deal_id", "seq").read(schema), limit)


HISTORY = "deal_id bigint, seq bigint, status string"
SPAN = 65_536  # sequence numbers of a slice, which is one value of the state
VIOLATIONS = "deal_id bigint, seq bigint, previous string, status string, valid boolean"


EDGES = "deal_id bigint, slice bigint, first_seq bigint, first_status string, last_seq bigint, last_status string"
GUARDED = "deal string, slice bigint, seq bigint, previous string, status string, valid boolean, last_seq bigint, last_status string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALLOWED = frozenset(map(tuple, domains.TRANSITIONS))


GUARD_STATE = "rows binary"
GUARD_BUCKETS = 256  # states that the deals of a slice share
GUARD_ROWS = pa.schema([("deal", pa.string()), ("seq", pa.int64()), ("status", pa.string()), ("latest", pa.int64()), ("due", pa.int64())])


def slice_guard(limit_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Keeps the statuses of one slice of the histories of a bucket's deals, and tells what a batch changes about the invalid
    steps inside it.

    A row of the output is a step that is invalid now or no longer is; one more row for each deal of the batch, without ``valid``,
    tells the slice's first and last status.  The state comes and goes with the rows, as one value a bucket and slice."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() if limit_ms is not None else 0
        fresh = [] if state.hasTimedOut else list(batches)
        stored = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else GUARD_ROWS.empty_table().to_pandas()
        arrived = pd.concat([b[["deal", "seq", "status", "ms"]] for b in fresh]) if fresh else pd.DataFrame({"deal": [], "seq": [], "status": [], "ms": []})
        codes = pd.factorize(pd.concat([stored["deal"], arrived["deal"]]).astype(object), use_na_sentinel=False)[0]
        old, new = codes[: len(stored)], codes[len(stored) :]
        touched = np.isin(old, new)
        kept = ~touched if limit_ms is None else ~touched & (stored["due"].to_numpy(np.int64) >= now)
        ours = stored[touched]
        before = invalid_steps(old[touched], ours["seq"].to_numpy(np.int64), ours["status"].to_numpy(object))[0]
        rows = pd.DataFrame({
            "code": np.r_[old[touched], new].astype(np.int64), "seq": np.r_[ours["seq"], arrived["seq"]].astype(np.int64),
            "deal": np.r_[ours["deal"].to_numpy(object), arrived["deal"].to_numpy(object)],
            "status": np.r_[ours["status"].to_numpy(object), arrived["status"].to_numpy(object)]})
        if limit_ms is not None:
            rows["latest"] = np.r_[ours["latest"], arrived["ms"].fillna(0)].astype(np.int64)
            rows["latest"] = rows.groupby("code")["latest"].transform("max")
            rows["due"] = np.maximum(rows["latest"] + limit_ms, now + 1)
        else:
            rows["latest"] = rows["due"] = 0
        rows = rows.drop_duplicates(["code", "seq"], keep="last").sort_values(["code", "seq"], ignore_index=True)
        held = pd.concat([stored[kept], rows[GUARD_ROWS.names]]) if kept.any() else rows[GUARD_ROWS.names]
        if len(held):
            sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(held, GUARD_ROWS, preserve_index=False)
            with pa.ipc.new_stream(sink, GUARD_ROWS) as writer:
                writer.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            if limit_ms is not None:
                state.setTimeoutTimestamp(max(int(held["due"].min()), now + 1))
        elif state.exists:
            state.remove()
        if not len(rows):
            return
        code, seqs, statuses = rows["code"].to_numpy(), rows["seq"].to_numpy(), rows["status"].to_numpy(object)
        after, starts = invalid_steps(code, seqs, statuses)
        ends, deals = np.r_[starts[1:], len(rows)] - 1, rows["deal"].to_numpy(object)[starts]
        name = dict(zip(code[starts].tolist(), deals))
        out = [(name[c], seq, *step, True, None, None) for (c, seq), step in after.items() if before.get((c, seq)) != step]
        out += [(name[c], seq, *step, False, None, None) for (c, seq), step in before.items() if (c, seq) not in after]
        out += zip(deals, seqs[starts].tolist(), [None] * len(starts), statuses[starts], [None] * len(starts), seqs[ends].tolist(), statuses[ends])
        told = pd.DataFrame(out, columns=["deal", "seq", "previous", "status", "valid", "last_seq", "last_status"])
        told.insert(1, "slice", key[1])
        yield told.astype({"valid": object, "last_seq": "Int64"})

    return step


def invalid_steps(codes: np.ndarray, seqs: np.ndarray, statuses: np.ndarray) -> tuple[dict[tuple[int, int], tuple[str, str]], np.ndarray]:
    """(previous, status) of each row, by deal's code and number, that follows another status of its deal without being allowed
    to; and the places where deals begin, in the order of codes and numbers."""
    order = np.lexsort((seqs, codes))
    codes, seqs, statuses = codes[order], seqs[order], statuses[order]
    begins = np.diff(codes, prepend=-1) != 0
    at = np.flatnonzero(~begins)
    at = at[(statuses[at] != statuses[at - 1]).astype(bool)]
    steps = zip(zip(codes[at].tolist(), seqs[at].tolist()), zip(statuses[at - 1], statuses[at]))
    return {place: step for place, step in steps if step not in ALLOWED}, np.flatnonzero(begins)


def guard_transitions(
    history: DataFrame, target: str, edges: str, checkpoint: str, schema: str = HISTORY, span: int = SPAN,
    delay: str | None = None, limit: timedelta | None = None, buckets: int = GUARD_BUCKETS,
) -> None:
    """Find invalid status changes as rows arrive, in any order.

    A deal's history is kept as operator state in slices of ``span`` sequence numbers, so a hot deal has many keys; the deals of a
    slice are dealt into ``buckets``, each one state, so a batch costs no call a deal.  A batch reads and writes the buckets of the
    slices that its rows fall into, whatever is stored of others.  A late row is set between its neighbours, and a
    violation that it ends is recorded as no longer valid.  Steps between slices are judged when read, from the slices'
    edges.  With a ``limit`` a slice's state goes when the watermark, ``delay`` behind the newest ``ts``, is that far
    past its newest row; later rows for it start anew."""
    kind = schema.split(",")[0].split()[1]
    rows = history if limit is None else history.withWatermark("ts", delay or "0 seconds")
    ms = F.lit(None).cast("bigint") if limit is None else F.unix_millis(F.col("ts").cast("timestamp"))
    keyed = rows.select(
        *([] if limit is None else ["ts"]), F.pmod(F.xxhash64("deal_id"), F.lit(buckets)).alias("bucket"), F.floor(F.col("seq") / span).alias("slice"),
        F.col("deal_id").cast("string").alias("deal"), F.col("seq").cast("bigint").alias("seq"), "status", ms.alias("ms"))
    step = slice_guard(None if limit is None else int(limit.total_seconds() * 1000))
    changes = keyed.groupBy("bucket", "slice").applyInPandasWithState(
        step, GUARDED, GUARD_STATE, "update", GroupStateTimeout.NoTimeout if limit is None else GroupStateTimeout.EventTimeTimeout
    ).withColumn("deal_id", F.col("deal").cast(kind))

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # one evaluation of the state for both tables; a lost part is computed again from the same state
        VersionedTable(spark, target, "deal_id", "seq").upsert(
            batch.filter("valid is not null").select("deal_id", "seq", "previous", "status", "valid"), number)
        VersionedTable(spark, edges, "deal_id", "slice").upsert(
            batch.filter("valid is null").select("deal_id", "slice", F.col("seq").alias("first_seq"), F.col("status").alias("first_status"), "last_seq", "last_status"), number)
        batch.unpersist()

    spark = history.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        run_available(changes, checkpoint, each, "update")
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def violations_schema(schema: str = HISTORY) -> str:
    kind = schema.split(",")[0].split()[1]
    return VIOLATIONS.replace("deal_id bigint", f"deal_id {kind}")


def violations(spark: SparkSession, target: str, edges: str, schema: str = HISTORY) -> DataFrame:
    """The invalid status changes of all rows so far: those inside slices, and those from a slice's last row to the next
    slice's first one."""
    kind = schema.split(",")[0].split()[1]
    inside = VersionedTable(spark, target, "deal_id", "seq").read(violations_schema(schema)).filter("valid").drop("valid")
    slices = VersionedTable(spark, edges, "deal_id", "slice").read(EDGES.replace("deal_id bigint", f"deal_id {kind}"))
    order = Window.partitionBy("deal_id").orderBy("slice")
    steps = slices.withColumn("previous", F.lag("last_status").over(order)).filter("previous <> first_status").select(
        "deal_id", F.col("first_seq").alias("seq"), "previous", F.col("first_status").alias("status"))
    allowed = domains.frame(spark, sorted(ALLOWED), "previous string, status string")
    return inside.unionByName(steps.join(allowed, ["previous", "status"], "left_anti"))


# ---- deadline with an event-time timer -------------------------------------------------------------

SLA_OUTPUT = "deal_id long, escalation_id long, opened_ms long"
SLA_STATE = "opened binary, closed binary"
SLA_BUCKETS = 1_024


def sla_timeouts(events: DataFrame, delay: str, hours: int = 24, shards: int = 8, buckets: int = SLA_BUCKETS) -> DataFrame:
    """Escalations without a resolution within the limit, emitted when the watermark passes it.

    ``delay`` is how late rows may come; a resolution later than that cannot be seen any more.

    ``events``: (deal_id, escalation_id, kind open|close, ts).  Openings of a deal are spread
    over ``shards`` keys and its few closings copied to each, so a hot deal's state is split.
    The keys of all deals are dealt into ``buckets``, each one state, so a batch costs its rows and not a call a deal.
    State holds openings and closings not older than the limit; the decision waits for the
    watermark, so the order of arrival does not matter.  Rows without a time are never due and
    close nothing, nor do those of no deal."""
    limit = hours * 3_600_000
    shard = F.when(F.col("kind") == "open", F.array(F.pmod(F.xxhash64("escalation_id"), F.lit(shards)))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    keyed = (
        events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).filter(F.col("ms").isNotNull())
        .withColumn("shard", F.explode(shard))
        .select(
            "ts", "ms", "shard", F.pmod(F.xxhash64("deal_id", "shard"), F.lit(buckets)).alias("bucket"),
            F.coalesce(F.col("kind") == "open", F.lit(False)).alias("is_open"),
            F.coalesce(F.col("deal_id").cast("bigint"), F.lit(0)).alias("deal"), F.col("deal_id").isNotNull().cast("bigint").alias("deal_known"),
            F.coalesce(F.col("escalation_id").cast("bigint"), F.lit(0)).alias("ident"),
            F.col("escalation_id").isNotNull().cast("bigint").alias("ident_known"))
    )
    key, row = ["deal_known", "deal", "shard"], ["deal_known", "deal", "shard", "ms", "ident_known", "ident"]

    def step(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts: dict[bool, list[np.ndarray]] = {True: [np.zeros((0, 6), np.int64)], False: [np.zeros((0, 6), np.int64)]}
        if state.exists:
            for is_open, stored in zip((True, False), state.get):
                parts[is_open].append(np.frombuffer(bytes(stored), np.int64).reshape(-1, 6))
        for batch in batches:
            values, opens = batch[row].to_numpy(np.int64), batch["is_open"].to_numpy(bool)
            parts[True].append(values[opens])
            parts[False].append(values[~opens & (values[:, 0] == 1)])
        now = state.getCurrentWatermarkMs()
        opened, closed = np.concatenate(parts[True]), np.concatenate(parts[False])
        due, opened = opened[opened[:, 3] + limit < now], opened[opened[:, 3] + limit >= now]
        late = _unresolved(pd.DataFrame(due, columns=row), pd.DataFrame(closed, columns=row)[[*key, "ms"]], key, limit)
        # a closing counts for openings before it
        closed = closed[closed[:, 3] > (opened[:, 3].min() if len(opened) else now)]
        if len(opened) or len(closed):
            state.update((opened.tobytes(), closed.tobytes()))
            deadline = int(opened[:, 3].min()) + limit if len(opened) else now + limit
            state.setTimeoutTimestamp(max(deadline, now + 1))
        elif state.exists:
            state.remove()
        if len(late):
            named = lambda name: late[name] if late[f"{name}_known"].all() else late[name].astype("Int64").where(late[f"{name}_known"] == 1)
            yield pd.DataFrame({"deal_id": named("deal"), "escalation_id": named("ident"), "opened_ms": late["ms"]})

    return keyed.groupBy("bucket").applyInPandasWithState(
        step, SLA_OUTPUT, SLA_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _unresolved(opened: pd.DataFrame, closed: pd.DataFrame, key: list[str], limit: int) -> pd.DataFrame:
    """The rows of ``opened`` whose next closing of equal ``key`` is missing or later than ``limit``."""
    if opened.empty or closed.empty:
        return opened
    nearest = pd.merge_asof(
        opened.sort_values("ms", kind="stable"), closed.sort_values("ms").assign(closed_ms=lambda x: x["ms"]),
        on="ms", by=key, direction="forward", allow_exact_matches=False, tolerance=limit)
    return nearest[nearest["closed_ms"].isna()]


def append_log(events: DataFrame, target: str, checkpoint: str) -> None:
    """Append-only event log, exactly once through the file sink's own log."""
    query = (
        events.withColumn("day", F.to_date("ts")).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start(target)
    )
    finish(query)


def write_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    finish(stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(target))
