"""Segmentation, classification, definitions, layout."""

import re

import pytest
from pyspark.sql import functions as F

from briefmill import domains
from briefmill.functions import text as T
from briefmill.operators import chunking, classify, definitions
from briefmill.sources import layout


def lines(spark, rows):
    return spark.createDataFrame(rows, "document_name string, page_index int, seq int, line string")


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_join_inner_marks(spark):
    assert one(spark, T.count_tokens, "the buyer's well-known co-sale -- right") == 5


def test_split_clauses_keeps_stops(spark):
    assert one(spark, T.split_clauses, "One. Two; three\nfour  . ") == ["One.", "Two;", "three", "four  ."]


def test_lines_break_like_text_files(spark):
    pages = spark.createDataFrame([("d", 0, "a\r\nb\x0bc\x85d\n\n  \ne")], "document_name string, page_index int, text string")
    assert [r["line"] for r in chunking.lines_of(pages).orderBy("seq").collect()] == ["a", "b", "c", "d", "e"]


def test_references_first_spelling_wins(spark):
    got = one(spark, T.section_references, "see Section 4.2(a), SECTION 4.2(A), then Article 9 and subSection 1")
    assert got == ["Section 4.2(a)", "Article 9"]


@pytest.mark.parametrize("line, header", [
    ("Section 4.2 Payment", "Section 4.2"), ("ARTICLE 9: Terms.", "ARTICLE 9"), ("Section 3 applies where the buyer pays;", None),
    ("Section 1 " + "word " * 13, None), ("As in Section 2", None), ("Section 9.4(a) Foo", "Section 9.4"),
])
def test_header(spark, line, header):
    assert one(spark, T.section_header, line) == header


def test_oversized_pieces_have_exact_size(spark):
    text = "- " + ", ".join(f"w{i}" for i in range(23)) + "!"
    pieces = one(spark, lambda c: T.split_oversized(c, 10), text)
    assert [len(re.findall(r"\w+", p)) for p in pieces] == [10, 10, 3]
    assert pieces[0].startswith("w0, w1") and pieces[-1].endswith("w22!")


def test_chunks_follow_sections_pages_and_size(spark):
    rows = [("d", 0, 0, "Opening words here."), ("d", 0, 1, "Section 1 Price"), ("d", 0, 2, "a b c d. e f g h. i j k l."),
            ("d", 1, 0, "still in one."), ("d", 1, 1, "Section 2 Term"), ("d", 1, 2, "x y z.")]
    got = [(r["section_id"], r["absolute_page"], r["text"]) for r in
           chunking.build_chunks(lines(spark, rows), 8).orderBy("chunk_index").collect()]
    assert got == [
        ("document_root", 0, "Opening words here."), ("Section 1", 0, "Section 1 Price a b c d."), ("Section 1", 0, "e f g h. i j k l."),
        ("Section 1", 1, "still in one."), ("Section 2", 1, "Section 2 Term x y z.")]


def test_packing_properties(spark):
    rows = [("d%d" % (i % 3), 0, i, " ".join(f"t{i}x{j}." if j % 4 == 3 else f"t{i}x{j}" for j in range(1 + i * 7 % 40)))
            for i in range(60)]
    chunks = chunking.build_chunks(lines(spark, rows), 25).collect()
    tokens = [t for c in chunks for t in re.findall(r"\w+", c["text"])]
    assert sorted(tokens) == sorted(t for r in rows for t in re.findall(r"\w+", r[3]))
    assert max(c["tokens"] for c in chunks) <= 25
    by_place = sorted(chunks, key=lambda c: (c["document_name"], c["chunk_index"]))
    for a, b in zip(by_place, by_place[1:]):
        if a["document_name"] == b["document_name"]:
            # Neighbours of one section never fit together, so merging them up would do nothing.
            first = re.split(r"(?<=[.;])\s+", b["text"])[0]
            assert a["tokens"] + len(re.findall(r"\w+", first)) > 25


SENTENCES = {name: f"The parties discuss {words[0]} at length." for name, words in domains.TAXONOMY.items() if words}


def test_each_type_is_recognised(spark):
    df = spark.createDataFrame(list(SENTENCES.items()), "want string, text string")
    for row in classify.classify(df).collect():
        assert row["clause_type"] == row["want"], row
        assert row["classification_confidence"] == pytest.approx(0.7)


@pytest.mark.parametrize("text, kind, confidence, terms", [
    ("Employment and insurance.", "general", 0.0, ["employment", "insurance"]), ("Nothing here, taxing.", "general", 0.0, []),
    ("Sales TAX and vat", "tax_provision", 0.9, ["tax", "sales tax", "vat"]),
    ("employment employee compensation benefits severance", "employment_term", 0.99, ["employment", "employee", "compensation", "benefits", "severance"]),
])
def test_leaders_ties_and_none(spark, text, kind, confidence, terms):
    row = classify.classify(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["clause_type"], row["matched_terms"]) == (kind, terms)
    assert row["classification_confidence"] == pytest.approx(confidence)


def test_definitions_block(spark):
    rows = [("d", 0, 0, '"Early" means not yet.'), ("d", 0, 1, "Section 1. Definitions"), ("d", 0, 2, '"Buyer" means the party paying. More.'),
            ("d", 0, 3, "Closing Date shall mean the day of transfer; ok"), ("d", 0, 4, "Closing Date means another day."),
            ("d", 1, 0, "“Buyer” refers to the final payer"), ("d", 1, 1, "Section 2 Price"), ("d", 1, 2, '"Late" means too late.')]
    got = {r["term"]: r["definition"] for r in definitions.definitions(lines(spark, rows)).collect()}
    assert got == {"Buyer": "the final payer", "Closing Date": "another day", "Closing Date shall": "the day of transfer"}


def test_defined_terms_match_case_and_boundary(spark):
    chunks = spark.createDataFrame([("c1", "d", "The Buyer's duty"), ("c2", "d", "the buyer and Buyers"), ("c3", "e", "Buyer")],
                                   "chunk_id string, document_name string, text string")
    terms = spark.createDataFrame([("d", "Buyer", "payer")], "document_name string, term string, definition string")
    assert [(r["chunk_id"], r["defined_terms"]) for r in definitions.defined_terms_map(chunks, terms).collect()] == [("c1", {"Buyer": "payer"})]


def test_key_claim(spark):
    assert one(spark, T.key_claim, "Short one. And more.") == "Short one."
    assert one(spark, T.key_claim, "x" * 250) == "x" * 200 + "..."
    assert one(spark, T.key_claim, "No stop") == "No stop"


def test_two_columns_read_one_after_the_other(spark):
    words = [("a", 40, 20), ("b", 90, 21), ("c", 40, 40), ("x", 340, 20), ("y", 390, 21), ("z", 340, 40)]
    df = spark.createDataFrame([("d", 0, w, float(x), float(t), float(x + 40), float(t + 10)) for w, x, t in reversed(words)],
                               "document_name string, page_index int, text string, x0 double, top double, x1 double, bottom double")
    assert layout.reading_order(df).first()["text"] == "a b\nc\nx y\nz"


def test_table_text_drops_blank_rows(spark):
    cells = spark.createDataFrame([("d", 0, r, c, t) for r, c, t in [(0, 0, " a\n b "), (0, 1, "c"), (1, 0, " "), (1, 1, ""), (2, 1, "z"), (2, 0, "y")]],
                                  "document_name string, table_no int, row_no int, column_no int, cell string")
    assert layout.table_text(cells).first()["text"] == "a b | c\ny | z"


def test_a_long_table_is_one_text(spark):
    cells = spark.range(12_000).selectExpr("'d' as document_name", "0 as table_no", "id as row_no", "0 as column_no", "concat('r', id) as cell")
    assert layout.table_text(cells).first()["text"] == "\n".join(f"r{k}" for k in range(12_000))


def test_phrases_stand_on_word_boundaries_with_one_pass_over_the_text(spark):
    texts = ["of the", "xof the", "of thee", "of  the", "of\x01 the", "\x01of the\x01", "l'of the-end", "of_the", "", "(of the)",
             "été of thé", "an", "an-an", "ban", "an\x01", "c++ c+", "é", None]
    phrases = ["of the", "an", "c++", "é", "(of", "-an"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", T.word_edges(F.col("t")))
    got = rows.select("t", *[T.has_phrase(F.col("t"), F.col("e"), p).alias(str(i)) for i, p in enumerate(phrases)]).collect()
    want = rows.select("t", *[F.col("t").rlike(rf"(?<!{T.WORD})\Q{p}\E(?!{T.WORD})").alias(str(i)) for i, p in enumerate(phrases)]).collect()
    assert got == want
    plan = rows.select(T.has_phrase(F.col("t"), F.col("e"), "of the"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan  # a pattern per phrase made classification the largest cost of a chunk


def test_a_long_clause_is_marked_once_and_not_for_every_piece(spark):
    import time

    text = " ".join(["word"] * 40_000)
    row = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    pieces = row.select(T.split_oversized(F.col("t"), 10).alias("p")).first()["p"]
    assert len(pieces) == 4_000 and set(pieces) == {" ".join(["word"] * 10)}
    assert time.time() - start < 60  # marking per piece is 4,000 passes over the text


def test_references_are_searched_once_and_not_for_every_reference(spark):
    df = spark.createDataFrame([("see Section 1, section 1 and Article 2(a).",)], "x string").select(T.section_references(F.col("x")).alias("y"))
    assert df.first()["y"] == ["Section 1", "Article 2(a)"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_a_document_without_words_has_no_definition_line(spark):
    from briefmill.plans import inputs

    docs = spark.createDataFrame([(1, "--", "web"), (2, "ab cd", "web"), (3, None, "web")], "doc_id long, text string, source string")
    found = inputs.section_lines(docs).filter("seq = -1").collect()
    assert [(r.document_name, r.line) for r in found] == [("doc-2", '"ab" means the web term.')]


def test_pages_are_placed_without_a_frame_per_page():
    import time

    import numpy as np

    r, pages = np.random.default_rng(3), []
    for _ in range(300):
        n = int(r.integers(1, 65))
        left = r.integers(0, 60, n) * 10.0
        pages.append((r.integers(0, 40, n) * 3.0, left, left + r.integers(5, 60, n)))
    start = time.time()
    placed = [layout.page_order(*p) for p in pages]
    assert time.time() - start < 2.5  # frames per page took 16 ms each
    for (top, left, right), (words, column, line) in zip(pages, placed):
        raw = layout.line_numbers(top, left, right)
        assert sorted(words) == list(range(len(top))) and list(line) == sorted(line)
        assert all((raw[a] == raw[b]) == (line[i] == line[j]) for i, a in enumerate(words) for j, b in enumerate(words))


def test_pages_of_a_document_are_placed_apart(spark):
    box = "document_name string, page_index int, text string, x0 double, x1 double, top double, bottom double"
    rows = [("d", 1, "c", 0.0, 9.0, 0.0, 9.0), ("d", 0, "b", 10.0, 19.0, 0.0, 9.0), ("d", 0, "a", 0.0, 9.0, 0.0, 9.0), (None, 0, "z", 0.0, 9.0, 0.0, 9.0)]
    got = layout.reading_order(spark.createDataFrame(rows, box)).collect()
    assert {(r.document_name, r.page_index, r.text) for r in got} == {("d", 0, "a b"), ("d", 1, "c"), (None, 0, "z")}
