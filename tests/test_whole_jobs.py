"""Queries that do their whole job: nothing is cut before it is looked at."""

import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from briefmill.operators import graph as gr
from briefmill.operators import search
from briefmill.operators import verdict as ops
from briefmill.sources import layout
from briefmill.streaming import jobs


def popular_section(spark):
    """Section 1 has 60 chunks of which the last one alone is a tax provision; Section 2 has one of no type."""
    rows = [(f"c{i:03d}", f"doc-{i % 7}", "Section 1", "tax_provision" if i == 59 else "general", f"word{i} an of") for i in range(60)]
    rows.append(("d1", "doc-1", "Section 2", None, "Section 2 by clause"))
    return spark.createDataFrame(rows, "chunk_id string, document_name string, section_id string, clause_type string, text string")


def test_evidence_beyond_the_first_chunks_of_a_section_counts(spark):
    index = search.build_index(popular_section(spark))
    candidates = spark.createDataFrame(
        [("F1", "Section 1", "an of", "tax_provision"), ("F2", "Section 1", "an of", "ip_assignment"), ("F3", "Section 9", "word7", "general"),
         ("F4", "Section 2", "clause", "general"), ("F5", "clause", "word59", "tax_provision"), ("F6", "no", "word59", "tax_provision")],
        "finding_id string, section_id string, citation string, clause_type string").withColumns(
        {"claim": F.lit("a claim"), "state": F.lit("unresolved")})
    missing = lambda **how: {r[0] for r in ops.evidence_missing(candidates, index, **how).collect()}
    assert missing() == {"F2", "F3", "F4", "F5", "F6"}
    assert missing(whole=False) == {"F1", "F2", "F3", "F4", "F5", "F6"}


def test_whole_sections_under_filters(spark):
    chunks = popular_section(spark)
    rows = [("a", "Section 1", None, [], 3), ("b", "Section 1", "doc-3", ["tax_provision", "general"], 100), ("c", "Section 1", None, ["tax_provision"], 5),
            ("d", "Section 2", None, [], 5), ("e", "Section 2", "doc-2", [], 5), ("f", "Section 1", "doc-1", ["fx_hedging"], 5)]
    queries = spark.createDataFrame(rows, "query_id string, section_id string, document_name string, clause_types array<string>, size int").withColumn(
        "text", F.concat("section_id", F.lit(" q"))).withColumn("expanded_terms", F.array().cast("array<string>"))
    got = search.section_or_bm25(search.build_index(chunks), queries.drop("section_id"), whole=True).filter("route = 'section'").collect()
    held, want = [r.asDict() for r in chunks.collect()], set()
    for q, section, document, types, size in rows:
        fit = sorted(c["chunk_id"] for c in held if c["section_id"] == section and document in (None, c["document_name"])
                     and (not types or c["clause_type"] in types))
        want |= {(q, c, n) for n, c in enumerate(fit[:size], 1)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == want


def test_finding_links_are_all_pairs(spark):
    draw = random.Random(5)
    hubs = {(f"D{f % 3}" if f % 9 else "D9", f"F{f:03d}", f"n{draw.randrange(60)}") for f in range(150) for _ in range(draw.choice([1, 1, 2, 3]))}
    hubs |= {("D1", "Z1", "alone"), ("one", "Y1", "n1"), (None, "X1", "n1"), (None, "X2", "n1"), ("D1", None, "n1")}
    edges = {tuple(sorted(draw.sample([f"n{k}" for k in range(60)], 2))) for _ in range(80)}
    edges |= {(b, a) for a, b in list(edges)[:20]}
    nodes = {}
    for deal, finding, node in hubs:
        if deal and finding:
            nodes.setdefault((deal, finding), set()).add(node)
    want = set()
    for (deal, f), (other, g) in itertools.combinations(sorted(nodes), 2):
        if deal == other:
            a, b = nodes[deal, f], nodes[deal, g]
            if a & b:
                want.add((deal, f, g, "shared_entity"))
            elif any((x, y) in edges or (y, x) in edges for x in a for y in b):
                want.add((deal, f, g, "edge"))
    halves = spark.createDataFrame([e for e in edges if e[0] < e[1]], "src string, dst string")
    held = spark.createDataFrame(sorted(hubs, key=str), "deal_id string, finding_id string, node_id string")
    for block in (7, 4_000):
        got = gr.finding_links(held, halves, block=block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want and {k for *_, k in want} == {"shared_entity", "edge"}


def test_packed_ids_come_back(spark):
    ids = ["entity:org:00ff00ff00ff00ff", "entity::ffffffffffffffff", "entity:org:00FF00ff00ff00ff", "section:00ff00ff00ff00ff", "n1", "", "é:ü", None]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", gr.packed(F.col("id")).alias("p"))
    got = rows.select("id", gr.unpacked(F.col("p")).alias("back"), F.octet_length("p").alias("n")).collect()
    assert all(r.id == r.back for r in got) and {r.id: r.n for r in got}[ids[0]] == 20


def test_edges_travel_with_packed_ids(spark):
    rows = spark.createDataFrame(
        [(f"c{c}", f"Section {c % 2}", f"entity:org:{n:016x}") for c in range(4) for n in range(c + 1)] + [("c9", None, "a"), ("c9", None, "b")],
        "chunk_id string, section_id string, node_id string")
    want = gr.mirrored(gr.edges(gr.cooccurrence_halves(rows), "co_occurrence")).collect()
    found = gr.cooccurrence_edges(rows)
    assert sorted(found.collect()) == sorted(want) and "unhex" in found._jdf.queryExecution().executedPlan().toString().lower()


class HeldState:
    """What ``slice_guard`` needs of a state, with a watermark set by hand."""

    def __init__(self):
        self.value, self.watermark, self.due, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, due):
        self.due = due


def test_deals_of_a_slice_share_a_state():
    draw, moves = random.Random(6), ["created", "indexing", "analyzing", "debating", "error"]
    state, seen, told = HeldState(), {}, {}
    step = jobs.slice_guard(None)
    for _ in range(4):
        rows = [(draw.choice(["a", "b", "c", None]), draw.randrange(40), draw.choice(moves), None) for _ in range(25)]
        seen |= {(d, s): x for d, s, x, _ in rows}
        cut = len(rows) // 2
        batches = [pd.DataFrame(part, columns=["deal", "seq", "status", "ms"]) for part in (rows[:cut], rows[cut:])]
        out = pd.concat(list(step((3, 0), iter(batches), state)))
        told |= {(r.deal, r.seq): (r.previous, r.status) if r.valid else None for r in out[out["valid"].notna()].itertuples()}
        edges = {r.deal: (r.seq, r.last_seq) for r in out[out["valid"].isna()].itertuples()}
        want = {}
        for deal in {d for d, *_ in rows}:
            held = sorted((s, x) for (d, s), x in seen.items() if d == deal)
            assert edges[deal] == (held[0][0], held[-1][0])
        for deal in {d for d, _ in seen}:
            held = sorted((s, x) for (d, s), x in seen.items() if d == deal)
            want |= {(deal, s): (p, x) for (_, p), (s, x) in zip(held, held[1:]) if p != x and (p, x) not in jobs.ALLOWED}
        assert {k: v for k, v in told.items() if v} == want


def test_a_deal_of_a_shared_state_expires_alone():
    state, step = HeldState(), jobs.slice_guard(1_000)
    put = lambda *rows: list(step((0, 0), iter([pd.DataFrame(rows, columns=["deal", "seq", "status", "ms"])]), state))
    held = lambda: set(pa.ipc.open_stream(state.value[0]).read_all()["deal"].to_pylist())
    put(("old", 1, "created", 100), ("new", 1, "created", 5_000))
    assert state.due == 1_100
    state.watermark = 3_000
    put(("third", 1, "created", 3_500))
    assert held() == {"new", "third"} and state.due == 4_500
    state.watermark, state.hasTimedOut = 9_000, True
    assert put() == [] and state.value is None


def test_many_pages_are_ordered_as_one_page_is():
    draw = np.random.default_rng(7)
    sizes = draw.integers(1, 40, 60)
    page = np.repeat(np.arange(len(sizes)), sizes)
    top, left = draw.integers(0, 12, len(page)) * 2.5, draw.integers(0, 30, len(page)) * 20.0
    right = left + draw.integers(10, 60, len(page))
    words, column, line, word = layout.pages_order(page, top, left, right)
    for p in range(len(sizes)):
        here = page == p
        begin = np.flatnonzero(here)[0]
        want = layout.page_order(top[here], left[here], right[here])
        got = words[here] - begin, column[here], line[here]
        assert all(np.array_equal(a, b) for a, b in zip(got, want)) and np.array_equal(word[here], np.arange(here.sum()))


def test_pages_span_batches(spark):
    rows = [(f"d{d}", p, f"w{i}" if i % 50 else None, 40.0 + 50 * (i % 4), 20.0 + 14 * (i // 4), 80.0 + 50 * (i % 4), 30.0 + 14 * (i // 4))
            for d in range(2) for p in range(3) for i in range(1 + 40 * p)]
    frame = pd.DataFrame(rows, columns=["document_name", "page_index", "text", "x0", "top", "x1", "bottom"])
    for cut in (1, 7, 41, 1000):
        parts = [frame.iloc[k : k + cut] for k in range(0, len(frame), cut)]
        pages = [[*zip(r["document_name"], r["page_index"])] for r, _ in layout._whole_pages(iter(parts)) if len(r)]
        assert [x for p in pages for x in p] == [*zip(frame["document_name"], frame["page_index"])]
        assert sum(len(set(p)) for p in pages) == 6
    words = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "document_name string, page_index int, text string, x0 double, top double, x1 double, bottom double")
    found = layout.reading_order(words)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r.document_name, r.page_index): r.text for r in found.collect()}
    lines = lambda p: "\n".join(" ".join(f"w{i}" for i in range(k, min(k + 4, 1 + 40 * p)) if i % 50) for k in range(0, 1 + 40 * p, 4))
    assert {k: v.replace(" ", "").replace("\n", "") for k, v in got.items()} == {(f"d{d}", p): lines(p).replace(" ", "").replace("\n", "") for d in range(2) for p in range(3)}


def test_rows_are_offered_once_where_no_query_asks_inside_a_document(spark):
    rows = spark.createDataFrame([(k, f"d{d}", f"c{d}", t) for k in "ab" for d in range(4) for t in ("x", None)], "k string, document_name string, chunk_id string, clause_type string")
    asked = spark.createDataFrame([("q1", "a", None, []), ("q2", "b", None, ["x"]), ("q3", "c", None, [])], "query_id string, k string, q_document string, q_types array<string>")
    both = [search.filtered_join(asked, rows, "k", inside).select("query_id", "k", "document_name", "chunk_id", "clause_type") for inside in (False, True)]
    assert sorted(both[0].collect(), key=str) == sorted(both[1].collect(), key=str) and both[0].count() == 12
    assert "Generate" not in both[0]._jdf.queryExecution().executedPlan().toString()
    assert not search.asks_inside(asked, "q_document") and search.asks_inside(asked.withColumn("q_document", F.lit("d1")), "q_document")
