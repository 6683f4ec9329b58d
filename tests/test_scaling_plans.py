"""Steps that must not move more than they need."""

import __spark_entry__ as entry
from briefmill.operators import graph as gr
from briefmill.operators import search
from briefmill.plans import inputs
from tests.test_search import CHUNK

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chunks_of(spark, texts):
    return spark.createDataFrame([(f"c{i}" if t != "twice a b" else "c", "d", t, "Section 1", "general", []) for i, t in enumerate(texts)], CHUNK)


def test_synonym_groups_build_no_postings(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("the index is not needed to count chunks per term")

    monkeypatch.setattr(inputs, "index", refused)
    assert entry.queries()["ir_synonym_groups"](spark, SF).count() == 16


def test_synonym_expansion_shuffles_only_what_it_adds(spark):
    groups = spark.createDataFrame([("g", 0, ["a b", "x", "c"])], "agent string, group_no int, members array<string>")
    single = search.synonym_expand(chunks_of(spark, ["a b c", "x x", "q"]), groups)
    plan = plan_of(single)
    assert plan.index("Union") < plan.index("Exchange")
    want = {("c0", 0, "a"), ("c0", 1, "b"), ("c0", 2, "c"), ("c0", 0, "x"), ("c0", 0, "c"), ("c0", 2, "x"), ("c0", 2, "a"), ("c0", 3, "b"),
            ("c1", 0, "x"), ("c1", 1, "x"), ("c1", 0, "a"), ("c1", 1, "b"), ("c1", 0, "c"), ("c1", 1, "c"), ("c1", 1, "a"), ("c1", 2, "b"), ("c2", 0, "q")}
    assert sorted(map(tuple, single.collect())) == sorted(want)
    rows = search.synonym_expand(chunks_of(spark, ["twice a b", "twice a b", "x"]), groups).collect()
    assert len(rows) == len(set(rows)) and {("c", 1, "x"), ("c", 1, "c"), ("c", 0, "twice")} <= set(map(tuple, rows))


def members(spark, chunks):
    return spark.createDataFrame([(c, "s", n) for c, nodes in chunks.items() for n in nodes], "chunk_id string, section_id string, node_id string")


def test_edges_of_one_direction_hold_both(spark):
    rows = members(spark, {"c1": "abca", "c2": "ab", "c3": "z", "c4": "cb"})
    halves = gr.cooccurrence_halves(rows)
    assert sorted((r.chunk_id, r.src, r.dst) for r in halves.collect()) == [
        ("c1", "a", "b"), ("c1", "a", "c"), ("c1", "b", "c"), ("c2", "a", "b"), ("c4", "b", "c")]
    whole = gr.edges(gr.cooccurrence_rows(rows), "co_occurrence")
    both = gr.mirrored(gr.edges(halves, "co_occurrence"))
    assert both.columns == whole.columns and sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_finding_edges_meet_the_deals_of_the_rarer_end(spark):
    hubs = [("d0", f"f{k}", n, 7) for k, n in enumerate("abz")] + [(f"d{k}", "f", "a", k) for k in range(1, 30)] + [("d3", "f", "c", 2)]
    table = spark.createDataFrame(hubs, "deal_id string, finding_id string, node_id string, findings_on_node bigint")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "z"), ("a", "y"), ("a", "z")], "src string, dst string")
    found = gr.finding_edges(table, pairs)
    assert "near#" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [("d0", "a", "b", 7, 7), ("d0", "a", "z", 7, 7), ("d3", "a", "c", 3, 2)]
