import hashlib
import re

from briefmill.llm import decontaminate as d
from tests.llm.fixtures import awkward, awkward_rows, no_docs, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=10):
    w, hit, found = split(text), set(), set()
    for item, body in items:
        q = split(body)
        size = min(width, len(q))
        grams = {tuple(q[k : k + size]) for k in range(max(0, len(q) - size + 1))} if q else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found |= set() if item is None else {str(item)}  # hits without a name
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def items(spark):
    base = awkward_rows()[0][1].split()
    rows = [(10, " ".join(base[20:45])), (9, "x " + "! ".join(base[30:42]).upper() + " y"), (9, "two WORDS"), (11, None), (12, "..."), (13, "one"), (None, "aaaa"),
            (14, "“quoted” — 日本語"), (15, " ".join(words(9, 40))), (16, "aaaa aaaa aaaa")]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


def test_equals_brute_force_for_any_block_size(spark):
    rows, table = items(spark)
    want = sorted(((r[0], *brute(r[1], rows)) for r in awkward_rows()), key=repr)
    got = sorted((tuple(r) for r in d.digests(awkward(spark), table).collect()), key=repr)
    assert got == want
    blocks = d.contamination(awkward(spark).select("doc_id", "text"), table, most_bytes=200)
    assert sorted(((r.doc_id, r.n_hit, len(r["items"])) for r in blocks.collect()), key=repr) == sorted(((w[0], w[2], w[3]) for w in want), key=repr)


def test_spans_cover_the_hit_words_of_the_original_text(spark):
    _, table = items(spark)
    for row in d.contamination(awkward(spark), table).collect():
        covered = [w for s in row.spans for w in split(row.text[s.start : s.end])]
        assert len(covered) == row.n_hit and row.source in ("a.example.de", "b", "b.example.fr", "", None)


def test_empty_tables(spark):
    _, table = items(spark)
    assert d.digests(no_docs(spark), table).collect() == []
    assert {r.n_hit for r in d.digests(awkward(spark), table.limit(0)).collect()} == {0}


def test_clean_documents_take_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, None), (4, "A, b")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    kept = d.uncontaminated(docs, items)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
