"""Retrieval and routing on a hand-sized corpus."""

import math

import pytest

from briefmill.operators import routing, search

CHUNK = ("chunk_id string, document_name string, text string, section_id string, clause_type string, references_sections array<string>")
QUERY = "query_id string, text string, expanded_terms array<string>, document_name string, clause_types array<string>, size int"


@pytest.fixture(scope="module")
def index(spark):
    rows = [("c1", "d1", "tax return due date", "Section 1", "tax_provision", ["Section 2", "Section 9"]),
            ("c2", "d1", "return of the tax tax", "Section 2", "general", []), ("c3", "d2", "tax return tax return", "Section 1", "tax_provision", []),
            ("c4", "d2", "unrelated words only", "Section 3", "general", ["Section 1"])]
    return search.build_index(spark.createDataFrame(rows, CHUNK))


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), QUERY)


def found(df):
    return {(r["query_id"], r["chunk_id"]) for r in df.collect()}


def test_all_terms_required_and_scored(spark, index):
    got = search.bm25_and(index, ask(spark, ("q", "TAX return", [], None, [], 10), ("none", "tax absent", [], None, [], 10),
                                     ("same", "return tax", [], None, [], 1))).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {("q", "c1"), ("q", "c2"), ("q", "c3"), ("same", "c3")}
    score = next(r["score"] for r in got if (r["query_id"], r["chunk_id"]) == ("q", "c1"))
    lengths, idf = [4, 5, 4, 3], math.log(1 + (4 - 3 + 0.5) / (3 + 0.5))
    norm = 1.2 * (0.25 + 0.75 * 4 / (sum(lengths) / 4))
    assert score == pytest.approx(2 * idf * 1 / (1 + norm), abs=1e-6)


def test_filters_apply_before_ranking(spark, index):
    got = found(search.bm25_and(index, ask(spark, ("doc", "tax", [], "d2", [], 10), ("type", "tax", [], None, ["general"], 10))))
    assert got == {("doc", "c3"), ("type", "c2")}


def test_phrases_are_alternatives(spark, index):
    got = {r["chunk_id"]: r["phrases"] for r in search.phrases_or(index, ask(spark, ("q", "tax return", ["the tax", "absent"], None, [], 10))).collect()}
    assert got == {"c1": 1, "c3": 1, "c2": 1}
    assert search.phrases_or(index, ask(spark, ("q", "return tax", [], None, [], 10))).first()["chunk_id"] == "c3"


def test_section_name_short_circuits(spark, index):
    rows = search.section_or_bm25(index, ask(
        spark, ("s", "what of Section 1", [], None, [], 10), ("f", "Section 1", [], None, ["general"], 10), ("b", "section 1 tax", [], None, [], 10),
        ("d", "Section 1", [], "d2", [], 10), ("t", "tax", [], None, [], 10))).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in rows if r["route"] == "section"} == {("s", "c1"), ("s", "c3"), ("d", "c3")}
    assert {r["query_id"] for r in rows if r["route"] == "bm25"} == {"t"}


def test_pointers_add_missing_sections(spark, index):
    hits = spark.createDataFrame([("q", "c1", 1.0)], "query_id string, chunk_id string, score double")
    got = {(r["chunk_id"], r["is_pointer"]) for r in search.section_pointers(index.chunks, hits).collect()}
    assert got == {("c1", False), ("c2", True)}


def test_highlight_wraps_words(spark, index):
    hits = spark.createDataFrame([("q", "c2")], "query_id string, chunk_id string")
    row = search.highlight(hits, index.chunks, ask(spark, ("q", "Tax of", [], None, [], 10))).first()
    assert row["highlight"] == "return <em>of</em> the <em>tax</em> <em>tax</em>"


def test_compound_query_expands_present_groups(spark):
    registry = spark.createDataFrame([("a", [["tax", "levy"], ["cash", "liquidity"]], ["tax_provision"], 7)],
                                     "agent string, groups array<array<string>>, clause_types array<string>, top_k int")
    row = search.compound_queries(spark.createDataFrame([("q", "a", "Levy rules")], "query_id string, agent string, text string"), registry).first()
    assert (row["expanded_terms"], row["size"], row["clause_types"]) == (["tax", "levy"], 7, ["tax_provision"])


def routed(spark, text, name="plain", kind="general"):
    chunks = spark.createDataFrame([(name, text, kind)], "document_name string, text string, clause_type string")
    deals = spark.createDataFrame([("d", name)], "deal_id string, document_name string")
    return {r["agent"]: (r["matched_terms"], r["used_fallback"]) for r in routing.specialists(deals, chunks).collect()}


def test_routing_terms_and_types(spark):
    assert routed(spark, "A patent and a patent license.") == {"ip_agent": (["patent", "license"], False)}
    assert routed(spark, "words", kind="tax_provision") == {"tax_agent": (["tax_provision"], False)}
    assert routed(spark, "a non-compete duty") == {"hr_agent": (["non-compete"], False)}
    assert routed(spark, "the P&L") == {"finance_agent": (["p&l"], False)}
    assert routed(spark, "words", name="sales_tax-file") == {"tax_agent": (["tax", "sales tax"], False)}


def test_routing_falls_back_to_everyone(spark):
    got = routed(spark, "nothing to see")
    assert len(got) == 16 and all(flag for _, flag in got.values())


def test_unknown_suggestions_keep_the_plan(spark):
    plan = spark.createDataFrame([("d1", "tax_agent", ["tax"], False), ("d2", "ip_agent", ["patent"], False)],
                                 "deal_id string, agent string, matched_terms array<string>, used_fallback boolean")
    asked = spark.createDataFrame([("d1", "hr_agent"), ("d1", "ghost"), ("d2", "ghost")], "deal_id string, agent string")
    got = {(r["deal_id"], r["agent"], r["used_fallback"]) for r in routing.suggested(asked, plan).collect()}
    assert got == {("d1", "hr_agent", False), ("d2", "ip_agent", True)}
