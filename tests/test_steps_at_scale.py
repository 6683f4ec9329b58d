"""Steps that many queries share: what they shuffle, and equal results on odd rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from briefmill.functions import text as T
from briefmill.operators import chunking, debate, search
from briefmill.operators import graph as gr
from briefmill.plans import inputs
from briefmill.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_dealt_before_they_become_lines(spark):
    docs = spark.createDataFrame([(1, "one. two\nthree", "src")], "doc_id bigint, text string, source string")
    plan = plan_of(chunking.build_chunks(inputs.section_lines(docs)))
    assert plan.count("Exchange ") == 1 and plan.rindex("Generate ") < plan.index("Exchange ")


def test_phrases_found_are_those_on_word_boundaries(spark):
    phrases = ["an", "of the", "An", "x-y", "über", "a_b", "c++"]
    texts = ["An apple", "of the an", "of  the", "ofthe of the_", "x-y", "ax-y x-yb", "über uber", "a_b", "a_bc", "c++ x", "xc++", "", "éan an", "of the é of the"]
    low = F.lower("t")
    one = [F.when(T.has_phrase(low, T.word_edges(low), p), F.lit(p.lower())) for p in phrases]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(
        T.phrases_found(low, phrases).alias("all"), F.array_distinct(F.array_compact(F.array(*one))).alias("single")).collect()
    assert [sorted(r["all"] or []) for r in rows] == [sorted(r["single"] or []) for r in rows]


def test_clauses_end_where_they_did(spark):
    texts = ["a. b; c", "a.b", "a.  \r\n b", "x\r\ny\n\nz", " . ", ".\n;", "a.\t\tb.", "", "a\r b", ".\r\n\r\n.", "a \n. b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.split("t", T.CLAUSE_BREAK).alias("a"), F.split("t", r"(?<=[.;])\s+|\r?\n+").alias("b")).collect()
    clean = lambda parts: [p.strip() for p in parts if p.strip()]
    assert [clean(r.a) for r in got] == [clean(r.b) for r in got]


def test_passages_are_first_chunks(spark):
    rows = [("s", "b", "second"), ("s", "a", "first"), ("s", "a", "first again"), (None, "z", "rootless"), ("t", None, "unplaced"), ("u", None, "x"), ("u", "k", "y")]
    got = debate.passages(spark.createDataFrame(rows, "section_id string, chunk_id string, text string")).collect()
    assert {r.section_id: (r.chunk_id, r.text) for r in got} == {"s": ("a", "first"), None: ("z", "rootless"), "t": (None, None), "u": ("k", "y")}


def test_node_ids_are_made_once_a_name(spark):
    mentions = spark.createDataFrame([("org", "A", "c1")] * 3, "entity_type string, name string, chunk_id string")
    names = spark.createDataFrame([("org", "A", "A", "confirmed")], "entity_type string, name string, canonical string, status string")
    plan = plan_of(gr.members(mentions, names))
    assert plan.index("Join") < plan.index("sha2")


def test_queries_for_one_section_meet_its_rows_where_they_are(spark):
    chunks = spark.range(500).select(
        F.format_string("c%05d", "id").alias("chunk_id"), F.concat(F.lit("d"), F.col("id") % 50).alias("document_name"),
        F.lit("Section 1").alias("section_id"), F.lit("general").alias("clause_type"))
    queries = spark.range(40).select(
        F.col("id").alias("query_id"), F.concat(F.lit("Section "), F.col("id") % 1 + 1).alias("section_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), "id")).alias("document_name"))
    found = search.resolve_sections(chunks, queries)
    assert "BroadcastHashJoin [section_id" in plan_of(found)
    counts = {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: 50 if i % 2 else 10 for i in range(40)}


def test_timeouts_of_many_deals_in_few_states(spark, tmp_path):
    draw, start = random.Random(4), datetime(2024, 1, 1)
    rows = [
        (draw.choice([None, 0, 1, 2, 3, 2**60 + 1]), i, draw.choice(["open", "open", "close"]), start + timedelta(minutes=draw.randrange(6000)) if i % 40 else None)
        for i in range(600)]
    rows += [(7, 2**60 + 5, "open", start), (9, 9_999, "close", start + timedelta(days=30))]
    path, limit = str(tmp_path / "in"), timedelta(hours=24)
    df = spark.createDataFrame(rows, "deal_id bigint, escalation_id bigint, kind string, ts timestamp")
    df.write.parquet(path)
    jobs.write_available(
        jobs.sla_timeouts(jobs.file_stream(spark, path, df.schema), "0 seconds", buckets=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = sorted(
        i for deal, i, kind, ts in rows if kind == "open" and ts
        and not any(k == "close" and deal is not None and d == deal and t and ts < t <= ts + limit for d, _, k, t in rows))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    deal_of = {i: deal for deal, i, _, _ in rows}
    assert sorted(r.escalation_id for r in got) == want and all(deal_of[r.escalation_id] == r.deal_id for r in got)
