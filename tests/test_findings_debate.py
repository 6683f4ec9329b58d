"""Findings, debate and verdict rules on small tables, and against sequential replays."""

import random

import pytest
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.operators import debate, findings, validation, verdict
from briefmill.plans.debate_replay import replay
from briefmill.sources import tables


@pytest.mark.parametrize("confidence, kind, claim, want", [
    (0.75, "change_of_control", "plain", "critical"), (0.74, "change_of_control", "plain", "high"), (0.1, "general", "plain", "low"),
    (0.1, "general", "an Injunction", "high"), (0.1, "general", "material breach", "medium"), (0.85, "general", "default", "high"),
    (0.96, "general", "fraud", "critical"), (0.95, "unheard_of", "plain", "critical"), (0.65, "supplier_contract", "plain", "medium"),
])
def test_severity(spark, confidence, kind, claim, want):
    df = spark.createDataFrame([(confidence, kind, claim)], "confidence_num double, clause_type string, claim string")
    assert findings.assign_severity(df).first()["severity"] == want


def sequential_dedup(rows):
    kept = {}
    for row in sorted(rows, key=lambda r: (r["seq"], r["finding_id"])):
        key = (row["deal_id"], row["section_id"], row["citation"])
        old = kept.get(key)
        if old is None:
            kept[key] = dict(row, cross_refs=set(row["cross_refs"]))
        elif domains.CONFIDENCE_RANK[row["confidence"]] > domains.CONFIDENCE_RANK[old["confidence"]]:
            kept[key] = dict(row, cross_refs=set(row["cross_refs"]) | old["cross_refs"] | {old["agent"]})
        else:
            old["cross_refs"] |= {row["agent"]}
    return {r["finding_id"]: (r["agent"], r["confidence"], tuple(sorted(r["cross_refs"]))) for r in kept.values()}


def test_dedup_equals_sequential_merge(spark):
    rng = random.Random(7)
    rows = [{"finding_id": f"f{i:03}", "seq": rng.randrange(50), "deal_id": "hot" if i % 3 == 0 else f"d{i % 4}", "section_id": f"s{rng.randrange(3)}",
             "citation": f"c{rng.randrange(2)}", "agent": f"a{rng.randrange(4)}", "confidence": rng.choice(domains.CONFIDENCES),
             "cross_refs": [f"r{rng.randrange(5)}"] if rng.random() < 0.5 else []} for i in range(300)]
    schema = ("finding_id string, seq int, deal_id string, section_id string, citation string, agent string, confidence string, cross_refs array<string>")
    got = findings.deduplicate(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    assert {r["finding_id"]: (r["agent"], r["confidence"], tuple(r["cross_refs"])) for r in got} == sequential_dedup(rows)


def test_dimension_lookup_order(spark):
    df = spark.createDataFrame([("finance_agent", "general", None), ("esg_agent", "general", None), ("nobody", "general", "exit_scenario")],
                               "agent string, clause_type string, dimension string")
    got = {r["agent"]: r["dimension"] for r in findings.map_dimension(df).collect()}
    assert got == {"finance_agent": "synergy_validity", "esg_agent": "strategic_fit", "nobody": "exit_scenario"}


def test_gate_modes_and_gaps(spark):
    df = spark.createDataFrame([("d", "risk_exposure", i) for i in range(3)] + [("d", "exit_scenario", 9)], "deal_id string, dimension string, n int")
    gate = findings.dimension_gate(df, df)
    got = {r["dimension"]: (r["mode"], len(r["personas"]), r["max_rounds"]) for r in gate.collect()}
    assert got["risk_exposure"] == ("full", 6, 3) and got["exit_scenario"] == ("limited", 3, 1) and got["market_timing"] == ("skipped", 0, 0)
    assert len(got) == 8 and findings.evidence_gaps(gate).count() == 6


def test_confidence_coercion(spark):
    from briefmill.functions.text import coerce_confidence
    df = spark.createDataFrame([(v,) for v in ("0.8", "0.5", "0.49", "1.01", "-0.1", "high", "sure")], "v string")
    assert [r["c"] for r in df.select(coerce_confidence(F.col("v")).alias("c")).collect()] == [
        "high", "medium", "speculative", None, None, "high", "medium"]


def test_responses_need_repair(spark):
    texts = ['{"claim":"a","citation":"b","confidence":0.4}', "oops", '{"claim":"a","citation":"b","confidence":"x"}', '{"claim":"","citation":"b","confidence":1}',
             '{"claim":"a","citation":"b","confidence":2}']
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, raw_text string")
    got = {r["request_id"]: r["error"] for r in validation.parse_responses(df).collect()}
    assert got == {0: None, 1: "invalid json", 2: "invalid json", 3: "claim is required", 4: "confidence out of range"}


ARG = ("argument_id int, finding_id string, deal_id string, dimension string, persona string, round int, stance string, bm25_verified boolean, "
       "dropout_flag boolean, confidence string, citations array<string>, notes string, argument string")


def args(spark, stances, verified=True, dropouts=(), round_=1, start=0):
    rows = [(start + i, "f", "d", "risk_exposure", p, round_, s, verified if isinstance(verified, bool) else s in verified, p in dropouts, "high",
             ["Section 1"], "", "text") for i, (p, s) in enumerate(zip(domains.PERSONAS, stances))]
    return spark.createDataFrame(rows, ARG)


S, O, N = "support", "oppose", "neutral"


@pytest.mark.parametrize("stances, verified, want", [
    ([S] * 4 + [O, O], {S}, "settled"), ([S] * 4 + [O, O], True, "contested"), ([S] * 4 + [O, O], False, "unresolved"), ([S, S, O, O, N, N], {S}, "unresolved"),
    ([N] * 5 + [O], True, "settled"), ([S] * 3, True, "unresolved"),
])
def test_consensus(spark, stances, verified, want):
    assert debate.finding_consensus(args(spark, stances, verified)).first()["state"] == want


@pytest.mark.parametrize("stances, verified, dropouts, want", [
    ([S] * 4 + [O, O], True, (), "settled"), ([S] * 4 + [O, O], True, ("critic",), "contested"), ([S] * 4 + [O, O], True, ("proponent",), "settled"),
    ([S, S, O, O, N, N], True, (), "contested"), ([S, S, O, O, N, N], {S}, (), "active"),
])
def test_round_state(spark, stances, verified, dropouts, want):
    assert debate.round_state(args(spark, stances, verified, dropouts)).first()["state"] == want


def test_latest_round_counts_once(spark):
    both = args(spark, [S] * 6, True).unionByName(args(spark, [O] * 6, {O}, round_=2, start=100))
    assert debate.finding_consensus(both).first()["state"] == "settled"
    assert {r["stance"] for r in debate.latest_per_persona(both).collect()} == {O}


def test_contradiction_needs_explanation(spark):
    first, second = args(spark, [S, S, S]), args(spark, [O, O, S], round_=2, start=10)
    explained = second.withColumn("notes", F.when(F.col("persona") == "critic", "changed by new evidence").otherwise("short"))
    got = {(r["persona"], r["round"]) for r in debate.gate_contradiction(first.unionByName(explained)).filter("contradiction_flag").collect()}
    assert got == {("proponent", 2)}


def test_corroboration_needs_another_persona(spark):
    df = args(spark, [S] * 3).withColumn("citations", F.when(F.col("persona") == "devils_advocate", F.array(F.lit("alone"), F.lit("alone"))).otherwise(F.col("citations")))
    got = {r["persona"]: r["confidence"] for r in debate.gate_corroboration(df).collect()}
    assert got == {"proponent": "high", "critic": "high", "devils_advocate": "medium"}


def test_citations_and_passages(spark):
    chunks = spark.createDataFrame([("c2", "Section 1", "never mind"), ("c1", "Section 1", "the price is fixed")], "chunk_id string, section_id string, text string")
    df = args(spark, [S, S, S]).withColumn("citations", F.when(F.col("persona") == "critic", F.array(F.lit("Ghost"))).otherwise(F.array(F.lit("Ghost"), F.lit("Section 1"))))
    df = df.withColumn("argument", F.when(F.col("persona") == "proponent", "The price rose").otherwise("unrelated things entirely here"))
    got = {r["persona"]: (r["citations"], r["bm25_verified"], r["confidence"]) for r in debate.gate_passage(debate.gate_citations(df, chunks), chunks).collect()}
    assert got == {"proponent": (["Section 1"], True, "high"), "critic": ([], False, "high"), "devils_advocate": (["Section 1"], True, "speculative")}
    by_id = args(spark, [S]).withColumn("citations", F.array(F.lit("c2")))
    assert debate.gate_citations(by_id, chunks, match_chunk_id=True).first()["bm25_verified"]
    assert not debate.gate_citations(by_id, chunks).first()["bm25_verified"]


def test_dimension_rollup_is_worst_first(spark):
    consensus = spark.createDataFrame([("d", "a", "settled"), ("d", "a", "contested"), ("d", "b", "settled"), ("d", "b", "unresolved")], "deal_id string, dimension string, state string")
    states = spark.createDataFrame([("d", x, "active") for x in "abc"] + [("d", "e", "settled")], "deal_id string, dimension string, state string")
    got = {r["dimension"]: r["state"] for r in debate.dimension_rollup(consensus, states).collect()}
    assert got == {"a": "contested", "b": "unresolved", "c": "unresolved", "e": "settled"}


def test_limited_dimensions_run_once(spark):
    states = spark.createDataFrame([("d", "a", "active"), ("d", "b", "active"), ("d", "c", "settled")], "deal_id string, dimension string, state string")
    gate = spark.createDataFrame([("d", "a", "full", domains.PERSONAS), ("d", "b", "limited", domains.LIMITED_PERSONAS), ("d", "c", "full", domains.PERSONAS)],
                                 "deal_id string, dimension string, mode string, personas array<string>")
    found = spark.createDataFrame([("d", x, f"f{x}") for x in "abc"], "deal_id string, dimension string, finding_id string")
    size = lambda n: debate.task_plan(states, gate, found, n).count()
    assert [size(1), size(2), size(4)] == [9, 6, 0]
    assert {r["state"] for r in debate.close_limited(states, gate, 2).filter("dimension = 'b'").collect()} == {"settled"}


def test_dropouts_are_filled(spark):
    rows = args(spark, [S] * 6)
    plan = rows.select("finding_id", "persona", "round", "deal_id", "dimension")
    filled = debate.fill_dropouts(plan, rows.filter("persona <> 'critic'"))
    row = filled.filter("dropout_flag").first()
    assert filled.count() == 6 and (row["persona"], row["stance"], row["confidence"]) == ("critic", N, "speculative")


def test_compression_keeps_notes_and_every_argument(spark):
    df = debate.gate_contradiction(args(spark, [S] * 6).withColumn("argument", F.lit("First. " + "word " * 300)).withColumn("notes", F.lit("kept verbatim")))
    states = debate.round_rollup(debate.round_state(df))
    short = debate.compress_arguments(df)
    rows = debate.compress_rounds(short, states)
    assert short.filter("notes = 'kept verbatim' and key_claim = 'First.'").count() == 6 and rows.first()["argument_count"] == 6
    assert debate.token_reduction(rows).first()["reduction"] > 0.5


def test_string_ids_serve_as_well(spark):
    df = args(spark, [S, S, S, S]).withColumn("argument_id", F.concat(F.lit("arg-"), "argument_id"))
    later = df.limit(1).withColumn("round", F.col("round") + 1).withColumn("argument_id", F.lit("arg-z"))
    latest = debate.latest_per_persona(df.unionByName(later))
    assert latest.count() == 4 and latest.filter("argument_id = 'arg-z'").count() == 1
    assert debate.finding_consensus(df).count() == 1


def test_a_silent_critic_makes_a_settled_finding_contested(spark):
    rows = args(spark, [S] * 6).withColumn("round", F.lit(1))
    gate = spark.createDataFrame([("d", "x", "full", domains.PERSONAS)], "deal_id string, dimension string, mode string, personas array<string>")
    one = rows.select("finding_id").first()["finding_id"]
    found = spark.createDataFrame([("d", "x", one)], "deal_id string, dimension string, finding_id string")
    chunks = spark.createDataFrame([("c1", "Section 1", "text")], "chunk_id string, section_id string, text string")
    said = rows.withColumn("deal_id", F.lit("d")).withColumn("dimension", F.lit("x")).filter("persona <> 'critic'")
    done = replay(said, gate, found, chunks)
    first = done.log.filter("round = 1").first()
    assert first["state"] == "contested" and done.arguments.filter("dropout_flag and persona = 'critic'").count() == 1


def verdict_parts(spark):
    found = spark.createDataFrame([("d", f"f{i}", "claim", s, dim, "cite", "general") for i, (s, dim) in enumerate(
        [("low", "a"), ("critical", "a"), ("high", "b"), ("high", "c")])], "deal_id string, finding_id string, claim string, severity string, dimension string, citation string, clause_type string")
    states = spark.createDataFrame([("d", "a", "settled"), ("d", "b", "contested"), ("d", "c", "unresolved")], "deal_id string, dimension string, state string")
    judged = spark.createDataFrame([("f2", "confirmed", False, "ok", 0.7), ("f3", "evidence_not_found", False, "none", 0.5)],
                                   "finding_id string, status string, judge_override_flag boolean, synthesis_rationale string, calibrated_confidence double")
    return found, states, judged


def test_brief_is_ranked_and_gaps_named(spark):
    found, states, judged = verdict_parts(spark)
    assert [(r["finding_id"], r["confidence"]) for r in verdict.brief(found, states, judged).orderBy("rank").collect()] == [("f1", 1.0), ("f2", 0.7), ("f0", 1.0)]
    assert [r["rank"] for r in verdict.brief(found, states, judged).orderBy("rank").collect()] == [1, 2, 3]
    gap = verdict.gaps(found, judged)
    assert (gap.first()["dimension"], gap.first()["missing_claim"]) == ("c", "claim")
    assert verdict.gap_summary(gap).first()["missing_claims"] == 1


def test_verdict_document_holds_everything(spark):
    import json
    found, states, judged = verdict_parts(spark)
    told = args(spark, [S, O]).withColumn("finding_id", F.lit("f2")).withColumn("contradiction_flag", F.col("persona") == "critic")
    rows = verdict.documents(verdict.brief(found, states, judged), verdict.escalations(found, states, told, judged), verdict.gaps(found, judged),
                             verdict.skipped_dimensions(found, states))
    one = [json.loads(r["verdict"]) for r in verdict.document_of(rows, found).collect()]
    assert len(one) == 1 and [x["finding_id"] for x in one[0]["brief"]] == ["f1", "f2", "f0"]
    items = {x["finding_id"]: x for x in one[0]["escalations"]}
    assert items["f2"]["has_contradictions"] and len(items["f2"]["arguments"]) == 2 and items["f3"]["judge_notes"] == "none"
    assert len(one[0]["skipped_dimensions"]) == 8
    counts = verdict.document_counts(found, rows).first()
    assert (counts["brief"], counts["escalations"], counts["gaps"], counts["skipped_dimensions"]) == (3, 2, 1, 8)


def test_a_hot_deal_is_ranked_and_listed_whole(spark):
    rows = spark.range(12_000).selectExpr(
        "'hot' as deal_id", "concat('f', id) as finding_id", "'c' as claim", "'a' as dimension", "'s' as citation", "'general' as clause_type",
        "element_at(array('critical', 'high', 'low'), cast(id % 3 + 1 as int)) as severity")
    states = spark.createDataFrame([("hot", "a", "settled")], "deal_id string, dimension string, state string")
    judged = spark.createDataFrame([], "finding_id string, status string, calibrated_confidence double")
    ranked = verdict.brief(rows, states, judged).orderBy("rank").select("rank", "severity", "finding_id").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 12_001))
    order = {"critical": 0, "high": 1, "low": 2}
    assert [(r["severity"], r["finding_id"]) for r in ranked] == sorted(((r["severity"], r["finding_id"]) for r in ranked), key=lambda x: (order[x[0]], x[1]))


def test_transcript_counts(spark):
    df = debate.gate_contradiction(args(spark, [S, O, S], dropouts=("critic",)))
    row = tables.round_transcript(df).first()
    assert row["argument_count"] == 3 and row["dropouts"] == ["critic=1"] and row["stances"] == ["critic=oppose", "devils_advocate=support", "proponent=support"]
