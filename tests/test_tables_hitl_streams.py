"""Table maintenance, human loop, replay and streams."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from briefmill import session
from briefmill.operators import delta, hitl
from briefmill.plans.debate_replay import replay
from briefmill.sources import documents as docs
from briefmill.sources import tables
from briefmill.sources.documents import first_per_fingerprint
from briefmill.streaming import jobs


def test_files_by_suffix(spark, tmp_path):
    for name in ("a.PDF", "b.docx", "c.txt", "noext"):
        (tmp_path / name).write_text(name)
    got = {r["document_name"]: (r["accepted"], r["reason"]) for r in docs.dispatch(docs.read_files(spark, str(tmp_path))).collect()}
    assert got["a.PDF"] == (True, None) and got["b.docx"] == (True, None)
    assert got["c.txt"] == (False, "unsupported document type: .txt") and got["noext"] == (False, "unsupported document type: <none>")


def test_copies_keep_the_first(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id int, text string")
    assert {r["doc_id"] for r in docs.without_copies(df).collect()} == {1, 2}


def test_upserts(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "id")
    rows = spark.range(100).select("id", F.lit("old").alias("v"))
    table.upsert(rows)
    table.upsert(spark.range(90, 120).select("id", F.lit("new").alias("v")))
    got = {r["v"]: r["n"] for r in table.read(rows.schema).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == {"old": 90, "new": 30}
    assert tables.VersionedTable(spark, str(tmp_path / "none"), "id").read(rows.schema).count() == 0


def test_cache_is_forgiving(spark, tmp_path):
    assert tables.read_chunk_cache(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "cache.json").write_text('{"chunk_id":"a","chunk_index":1}\n{broken\n')
    assert [r["chunk_id"] for r in tables.read_chunk_cache(spark, str(tmp_path / "cache.json")).collect()] == ["a"]


def test_append_only_violations(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "changed"), (4, "d")], "id int, v string")
    assert {(r["id"], r["violation"]) for r in tables.append_only_violations(before, after, "id").collect()} == {(2, "updated"), (3, "deleted")}


def history(spark, n=400):
    rng = random.Random(3)
    states = ["created", "indexing", "analyzing", "debating", "judging", "complete", "error"]
    rows = [("hot" if i % 3 == 0 else f"d{rng.randrange(5)}", i, rng.choice(states)) for i in range(n)]
    return spark.createDataFrame(rows, "deal_id string, seq long, status string")


def test_bounded_lag_equals_plain_lag(spark):
    df = history(spark)
    plain = df.withColumn("previous", F.lag("status").over(Window.partitionBy("deal_id").orderBy("seq")))
    assert hitl.bounded_lag(df, "deal_id", "seq", "status", 7).exceptAll(plain).isEmpty()
    assert plain.exceptAll(hitl.bounded_lag(df, "deal_id", "seq", "status", 7)).isEmpty()


def test_transitions(spark):
    df = spark.createDataFrame([("d", 1, "created"), ("d", 2, "indexing"), ("d", 3, "indexing"), ("d", 4, "complete"), ("d", 5, "error")],
                               "deal_id string, seq long, status string")
    assert [(r["previous"], r["status"]) for r in hitl.invalid_transitions(df).collect()] == [("indexing", "complete")]


def test_sla_takes_open_deals_down(spark):
    rows = [("e1", "d1", "pending", "2024-01-01 00:00:00"), ("e2", "d2", "pending", "2024-01-01 00:00:00"), ("e3", "d1", "resolved", "2024-01-01 00:00:00"),
            ("e4", "d1", "pending", "2024-01-02 12:00:00")]
    esc = spark.createDataFrame(rows, "escalation_id string, deal_id string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    deals = spark.createDataFrame([("d1", "judging"), ("d2", "complete")], "deal_id string, status string")
    out = hitl.expire_escalations(esc, deals, F.lit("2024-01-02 13:00:00").cast("timestamp_ntz"))
    assert {(r["escalation_id"], r["deal_status"]) for r in out.collect()} == {("e1", "error"), ("e2", "complete")}
    assert [r["deal_id"] for r in hitl.dropped_deals(out).collect()] == ["d1"]


def test_resolution_adds_and_never_changes(spark):
    esc = spark.createDataFrame([("e1", "d", "f", "pending"), ("e2", "d", "f", "resolved"), ("e3", "d", "f", "pending")], "escalation_id string, deal_id string, finding_id string, status string")
    found = spark.createDataFrame([("f", "d", "claim", "low")], "finding_id string, deal_id string, claim string, confidence string")
    asked = spark.createDataFrame([(1, "e1", "resolve", "fine", "ann"), (2, "e1", "accept_risk", "again", "bob"), (3, "e2", "resolve", "x", "ann"), (4, "e9", "resolve", "x", "ann"),
                                   (5, "e3", "shrug", "x", "ann")], "seq int, escalation_id string, decision string, decision_text string, resolved_by string")
    out = hitl.resolve_escalations(asked, esc, found)
    row = out.findings.first()
    assert (row["confidence"], row["agent"], row["notes"]) == ("human_confirmed", "human_expert_ann", "Human Resolution Override: fine")
    assert {(r["seq"], r["error"]) for r in out.errors.collect()} == {(2, "already resolved"), (3, "already resolved"), (4, "not found"), (5, "unknown decision path: shrug")}


def test_dispute_routes(spark):
    asked = spark.createDataFrame([(i, "d", "f", s, "u", "p") for i, s in enumerate("ABCD")], "dispute_id int, deal_id string, finding_id string, scenario string, user_id string, uploaded_document_path string")
    found = spark.createDataFrame([("f", "d", "x")], "finding_id string, deal_id string, dimension string")
    states = spark.createDataFrame([("d", "x", "settled"), ("d", "y", "settled")], "deal_id string, dimension string, state string")
    out = hitl.route_disputes(asked, found, states)
    assert {r["dispute_id"] for r in out.escalations.collect()} == {0, 2} and out.delta_runs.first()["dispute_id"] == 1
    assert {r["dimension"]: r["state"] for r in out.states.collect()} == {"x": "active", "y": "settled"}
    assert out.trail_requests.first()["dispute_id"] == 3 and out.disputes.count() == 3 and out.audit.count() == 6


def test_delta_sees_only_new_text(spark):
    schema = "chunk_id string, document_name string, text string, clause_type string"
    old = spark.createDataFrame([("a", "d1", "same", "general")], schema)
    now = spark.createDataFrame([("b", "d1", "same", "general"), ("c", "d1", "a patent", "general"), ("e", "d2", "same", "general")], schema)
    deals = spark.createDataFrame([("x", "d1"), ("y", "d2"), ("z", "d3")], "deal_id string, document_name string")
    out = delta.scope(delta.known(old), now, deals)
    assert {r["chunk_id"] for r in out.chunks.collect()} == {"c", "e"}
    assert {r["agent"] for r in out.agents.filter("deal_id = 'x'").collect()} == {"ip_agent"}
    assert out.agents.filter("deal_id = 'y' and used_fallback").count() == 16 and out.agents.filter("deal_id = 'z'").isEmpty()


def test_unchanged_documents_cost_one_row(spark):
    """Digests decide: an unchanged document's chunks are not read, a new one's not hashed, an edited one's compared."""
    schema = "chunk_id string, document_name string, text string, clause_type string"
    old = spark.createDataFrame([(f"o{d}{k}", f"d{d}", f"text {d} {k}", "general") for d in range(6) for k in range(5)], schema)
    now = old.filter("document_name != 'd5' or text != 'text 5 0'").unionByName(
        spark.createDataFrame([("n1", "d5", "a new one", "general"), ("n2", "d9", "text 0 0", "general")], schema))
    assert {r.chunk_id for r in delta.new_chunks(delta.known(old), now).collect()} == {"n1", "n2"}
    digests = delta.document_digests(now)
    assert digests.count() == 7 and digests.join(delta.document_digests(old), ["document_name", "digest"]).count() == 5
    refuse = F.udf(lambda text: 1 / 0, "string")
    unread = old.withColumn("text", F.when(F.col("document_name") == "d0", refuse("text")).otherwise(F.col("text")))
    same = delta.new_chunks(delta.Known(delta.document_digests(old), delta.content_key(old)), unread, delta.document_digests(old))
    assert same.select("chunk_id", "text").collect() == []


def test_replay_stops_when_settled(spark):
    from tests.test_findings_debate import args
    from briefmill import domains
    rounds = args(spark, ["support"] * 6)
    for n in (2, 3):
        rounds = rounds.unionByName(args(spark, ["oppose"] * 6, round_=n, start=n * 10))
    gate = spark.createDataFrame([("d", "risk_exposure", "full", domains.PERSONAS)], "deal_id string, dimension string, mode string, personas array<string>")
    found = spark.createDataFrame([("d", "risk_exposure", "f")], "deal_id string, dimension string, finding_id string")
    chunks = spark.createDataFrame([("c", "Section 1", "text")], "chunk_id string, section_id string, text string")
    out = replay(rounds, gate, found, chunks)
    assert out.arguments.count() == 6 and out.final.first()["state"] == "settled"
    split = rounds.withColumn("stance", F.element_at(F.array(*[F.lit(s) for s in ("support", "oppose", "neutral")]), (F.col("argument_id") % 3 + 1).cast("int")))
    unverified = split.withColumn("citations", F.array().cast("array<string>"))
    out = replay(unverified, gate, found, chunks)
    assert out.arguments.count() == 18 and out.final.first()["state"] == "unresolved"


@pytest.fixture()
def files(spark, tmp_path):
    """Three files, so that streams run in three batches."""
    path = str(tmp_path / "in")
    df = history(spark).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    for part in range(3):
        df.filter((F.col("seq") * 3 / 400).cast("int") == part).coalesce(1).write.mode("append").parquet(path)
    return path, df


def stream_of(spark, files):
    path, df = files
    return jobs.file_stream(spark, path, df.schema, files_per_batch=1), df


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_phase_stream_equals_batch(spark, files, tmp_path):
    stream, df = stream_of(spark, files)
    jobs.follow_phases(stream, str(tmp_path / "t"), str(tmp_path / "cp"))
    want = jobs.latest_phase(df)
    got = jobs.current_phases(spark, str(tmp_path / "t"), jobs.PHASES.replace("deal_id bigint", f"deal_id {dict(df.dtypes)['deal_id']}"))
    assert same(got.select(*want.columns), want)


def test_recent_stream_equals_batch(spark, files, tmp_path):
    stream, df = stream_of(spark, files)
    jobs.follow_recent(stream, str(tmp_path / "t"), str(tmp_path / "cp"), limit=20)
    want = jobs.most_recent(df, 20)
    assert same(jobs.recent_events(spark, str(tmp_path / "t"), df.schema, 20).select(*want.columns), want)


def test_guard_stream_equals_batch_with_late_files_and_a_retry(spark, files, tmp_path):
    path, df = files
    kind = f"deal_id {dict(df.dtypes)['deal_id']}, seq {dict(df.dtypes)['seq']}, status string"
    late = str(tmp_path / "late")
    for part in (1, 0, 2):  # the second part of the history arrives first
        df.filter((F.col("seq") * 3 / 400).cast("int") == part).coalesce(1).write.mode("append").parquet(late)
    want = hitl.invalid_transitions(df)
    assert not want.isEmpty()
    for source, span in ((path, 7), (late, 50)):
        where = tmp_path / ("run-" + source.rsplit("/", 1)[-1])
        names = [str(where / x) for x in ("bad", "edges", "cp")]
        jobs.guard_transitions(jobs.file_stream(spark, source, df.schema, files_per_batch=1), *names, kind, span)
        assert same(jobs.violations(spark, *names[:2], kind).select(*want.columns), want)
    # the last batch again, as after a failure between its writes and its commit
    commits = sorted((where / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (where / "cp" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    jobs.guard_transitions(jobs.file_stream(spark, late, df.schema, files_per_batch=1), *names, kind, span)
    assert same(jobs.violations(spark, *names[:2], kind).select(*want.columns), want)


def test_guard_batch_costs_its_own_rows_and_state_expires(spark, tmp_path):
    """A small batch writes few rows however much is held; past the limit a slice's state is gone."""
    schema = "deal_id string, seq long, status string, ts timestamp"
    moves = ["created", "indexing", "analyzing", "debating"]

    def put(rows, hours):
        spark.createDataFrame([(d, s, x) for d, s, x in rows], "deal_id string, seq long, status string").withColumn(
            "ts", F.timestamp_seconds(F.lit(hours * 3600) + F.col("seq"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    names = [str(tmp_path / x) for x in ("bad", "edges", "cp")]
    kind = "deal_id string, seq long, status string"
    run = lambda: jobs.guard_transitions(
        jobs.file_stream(spark, str(tmp_path / "in"), schema, 1), *names, kind, 100, "1 hour", timedelta(hours=2))
    put([(f"d{d}", s, moves[s % 4]) for d in range(20) for s in range(100)], 0)
    run()
    put([("d1", 100, "created"), ("d2", 101, "debating")], 1)
    run()
    written = spark.read.parquet(f"{names[0]}/data").filter("version = (select max(version) from parquet.`%s/data`)" % names[1]).count()
    assert written <= 4
    put([("d9", 5000, "created")], 50)
    run()
    put([("d9", 5001, "created")], 51)
    run()
    state = sorted((tmp_path / "cp" / "state" / "0").glob("*/*"))
    assert state
    put([("d1", 99, "created")], 52)  # its slice has been forgotten: no step inside it, none is recalled
    run()
    got = {(r.deal_id, r.seq) for r in jobs.violations(spark, *names[:2], kind).collect()}
    full = spark.read.parquet(str(tmp_path / "in")).dropDuplicates(["deal_id", "seq"]).select("deal_id", "seq", "status")
    assert {(r.deal_id, r.seq) for r in hitl.invalid_transitions(full).collect() if r.seq < 99} <= got | {("d1", 99)}



def test_guard_keeps_sparse_histories_in_few_slices(spark, tmp_path):
    """Deals that share one sequence have few rows in a stretch of it; a slice is long enough that each holds many."""
    rows = [(i % 7, i, ["created", "indexing", "analyzing", "debating", "error"][i * i % 5]) for i in range(0, 50_000, 100)]
    df = spark.createDataFrame(rows, "deal_id bigint, seq bigint, status string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    names = [str(tmp_path / x) for x in ("bad", "edges", "cp")]
    jobs.guard_transitions(jobs.file_stream(spark, str(tmp_path / "in"), df.schema), *names)
    want = hitl.invalid_transitions(df)
    assert same(jobs.violations(spark, *names[:2]).select(*want.columns), want)
    assert spark.read.parquet(f"{names[1]}/data").count() == 7


def test_unique_stream_equals_batch_over_several_files(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [[(3, "a"), (2, "b")], [(1, "a"), (4, "c"), (5, "c")], [(6, "a"), (7, "d")]]
    for part in rows:
        spark.createDataFrame(part, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    jobs.ingest_unique(jobs.file_stream(spark, path, table.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = jobs.unique_documents(spark, str(tmp_path / "out"))
    assert same(got.select("fingerprint", "doc_id", "copies"), first_per_fingerprint(table).select("fingerprint", "doc_id", "copies"))


def test_a_small_upsert_writes_a_small_version(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "k")
    schema = "k bigint, v string"
    table.upsert(spark.range(5000).selectExpr("id as k", "'old' as v"))
    table.upsert(spark.range(10).selectExpr("id as k", "'new' as v"))
    table.upsert(spark.range(4999, 5001).selectExpr("id as k", "'last' as v"))
    per_version = {r["version"]: r["n"] for r in table.rows(schema).groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert per_version == {0: 5000, 1: 10, 2: 2}
    want = {"old": 4989, "new": 10, "last": 2}
    assert {r["v"]: r["n"] for r in table.read(schema).groupBy("v").agg(F.count("*").alias("n")).collect()} == want
    small = table.compact(schema, str(tmp_path / "u"))
    assert small.rows(schema).count() == 5001 and {r["v"]: r["n"] for r in small.read(schema).groupBy("v").agg(F.count("*").alias("n")).collect()} == want


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_a_failed_request_leaves_the_escalation_open(spark):
    esc = spark.createDataFrame([("e1", "d", "f", "pending")], "escalation_id string, deal_id string, finding_id string, status string")
    found = spark.createDataFrame([("f", "d", "claim", "low")], "finding_id string, deal_id string, claim string, confidence string")
    asked = spark.createDataFrame([(1, "e1", "shrug", "x", "ann"), (2, "e1", "resolve", "fine", "bob"), (3, "e1", "accept_risk", "x", "cyd")],
                                  "seq int, escalation_id string, decision string, decision_text string, resolved_by string")
    out = hitl.resolve_escalations(asked, esc, found)
    assert [r["decision"] for r in out.updates.collect()] == ["resolve"]
    assert {(r["seq"], r["error"]) for r in out.errors.collect()} == {(1, "unknown decision path: shrug"), (3, "already resolved")}


def test_a_dispute_reopens_its_own_deal(spark):
    asked = spark.createDataFrame([(1, "other", "f", "B", "u", "p")], "dispute_id int, deal_id string, finding_id string, scenario string, user_id string, uploaded_document_path string")
    found = spark.createDataFrame([("f", "d", "x")], "finding_id string, deal_id string, dimension string")
    states = spark.createDataFrame([("d", "x", "settled"), ("other", "x", "settled")], "deal_id string, dimension string, state string")
    got = {r["deal_id"]: r["state"] for r in hitl.route_disputes(asked, found, states).states.collect()}
    assert got == {"d": "settled", "other": "active"}


def test_sla_stream(spark, tmp_path):
    rows = [(1, 10, "open", 0), (1, 11, "open", 5), (1, 90, "close", 3), (2, 20, "open", 0), (2, 91, "close", 30), (3, 30, "open", 90), (9, 99, "close", 100)]
    df = spark.createDataFrame(rows, "deal_id long, escalation_id long, kind string, hour int").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("hour") * 3600)).drop("hour")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    jobs.write_available(jobs.sla_timeouts(jobs.file_stream(spark, path, df.schema, 1), "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r["escalation_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {11, 20}


def test_only_chunks_of_documents_that_arrive_are_upserted_again(spark, tmp_path):
    from briefmill.plans.table_queries import _upsert

    text = "An agreement by and from them."
    spark.createDataFrame([(1, text, "web"), (2, text, "web")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,), (None,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    rows = _upsert(spark, str(tmp_path)).collect()
    types = {r.chunk_id.split(":")[0]: r.clause_type for r in rows}
    assert len(rows) == len({r.chunk_id for r in rows}) and set(types) == {"doc-1", "doc-2"}
    assert types["doc-2"] == "reindexed" != types["doc-1"]


def test_a_round_trip_is_compared_in_one_shuffle_with_copies_and_nulls(spark):
    from briefmill.operators import graph

    schema = "x string, y string, z array<string>"
    saved = spark.createDataFrame([("a", None, ["q"]), ("a", None, ["q"]), (None, "a", []), ("b", "c", None)], schema)
    other = spark.createDataFrame([("a", None, ["q"]), ("a", None, []), ("b", "c", None), ("b", "c", None)], schema)
    assert tuple(graph.differing(saved, saved).first()) == (4, 0)
    lost = graph.encoded(saved).exceptAll(graph.encoded(other)).count() + graph.encoded(other).exceptAll(graph.encoded(saved)).count()
    assert tuple(graph.differing(saved, other).first()) == (4, lost)


def test_scope_joins_sides_dealt_by_document(spark):
    registry = [{"agent": "a", "routing_terms": ["tax"], "clause_types": ["t"], "synonym_groups": []}]
    rows = [(f"c{i}", f"d{i % 40}", "the tax of it" if i % 3 else "nothing", "t" if i % 5 == 0 else "general") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_name string, text string, clause_type string")
    deals = spark.createDataFrame([(f"D{i % 7}", f"d{i}") for i in range(40)], "deal_id string, document_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = delta.scope(delta.known(chunks.filter("document_name < 'd2'")), chunks, deals, registry)
        assert {r.deal_id for r in out.agents.collect()} == {r.deal_id for r in deals.filter("document_name >= 'd2'").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_matches_of_texts_and_names_are_dealt_again_after_their_union(spark):
    from briefmill.operators import routing

    registry = [{"agent": "a", "routing_terms": ["tax"], "clause_types": ["t"], "synonym_groups": []}]
    chunks = spark.createDataFrame([("d1", "the tax", "t")], "document_name string, text string, clause_type string").repartition(8, "document_name")
    deals = spark.createDataFrame([("D1", "d1")], "deal_id string, document_name string").repartition(8, "document_name")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        lines = routing.specialists(deals, chunks, registry)._jdf.queryExecution().executedPlan().toString().splitlines()
        at = [i for i, line in enumerate(lines) if "Union" in line and i > 2 and "HashAggregate" in lines[i - 1]]
        assert at and all("Exchange" in lines[i - 2] for i in at), "\n".join(line[:80] for line in lines)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
