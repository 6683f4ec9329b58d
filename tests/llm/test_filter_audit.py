import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from briefmill.llm import filter_audit as a
from tests.llm.fixtures import DOCUMENTS, SF, awkward, awkward_rows, no_docs, words

LABELS = "doc_id bigint, quality int, toxic int, part string, mask string, n string"


def failing(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    upper = len(re.findall("[A-Z]", text))
    return {x for x, bad in zip("ABCD", (
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(text), bool(re.search("[#$%&*|]", text)))) if bad}


def brute(rows, labels):
    """Each order applied to each part, document by document; (doc_id, text, source) rows and (doc_id, quality, toxic) labels."""
    texts = defaultdict(set)
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""].add(i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts = defaultdict(list)
    for i, text, source in rows:
        fails = failing(text or "")
        if i is not None and i > min(texts[text or ""]):
            fails.add("E")
        parts[source or ""].append((fails, i in good, i in toxic))
    out, shapley = [], defaultdict(int)
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failed = [d for d in docs if f in d[0]]
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), len(failed) - len(gone), sum(d[0] == {f} for d in docs),
                            sum(d[1] for d in gone), sum(d[2] for d in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], LABELS)


def documents(spark, rows):
    return spark.createDataFrame([(i, x, "en", s, len(x or ""), *["x"] * 10) for i, x, s in rows], DOCUMENTS)


def made_rows():
    draw = random.Random(4)
    rows = []
    for i in range(300):
        text = " ".join(words(draw.randrange(120), draw.choice([20, 60, 90])))
        text = text.upper() if draw.random() < 0.2 else text
        text += " #" if draw.random() < 0.2 else ""
        text = " ".join([text] * 3) if draw.random() < 0.2 else text
        rows.append((i, text, draw.choice(["a", "a", "b", None, ""])))
    return rows


def test_table_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert got(a.audited(docs, labels)) == want


def test_copies_and_small_sketches(spark):
    rows = made_rows() + [(1000 + i, "one text that a third of all rows hold", "hot") for i in range(150)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 1100, 3)]
    docs, marks, want = documents(spark, rows), labels_of(spark, labels), brute(rows, labels)
    assert got(a.audited(docs, marks)) == want
    assert got(a.audited(docs, marks, most_cells=1500)) == want  # several shards, many false repeats


def test_awkward_documents(spark):
    rows = [(r[0], r[1], r[3]) for r in awkward_rows()]
    labels = [(1, 1, 1), (1, 0, None), (3, 1, 0), (None, 1, 1), (99, 1, 1), (5, None, None)]
    assert got(a.audited(awkward(spark), labels_of(spark, labels))) == brute(rows, labels)
    assert a.audited(no_docs(spark), labels_of(spark, labels)).collect() == []
    assert got(a.audited(awkward(spark), labels_of(spark, []))) == brute(rows, [])


def test_sketch_never_calls_a_repeat_unique(spark):
    hashes = [i * 2654435761 * 977 % (1 << 62) for i in range(3000)]
    table = spark.createDataFrame([(h,) for h in hashes + hashes[::3]], "hash bigint").repartition(50)
    for cells in (1 << 10, 1 << 15):
        packed = np.frombuffer(a.counting_sketch(table, cells), np.uint8)
        counters = a._unpacked(packed.tobytes())
        at = a._cells(np.array(hashes), cells)
        many = (counters[at] > 1).all(axis=0)
        assert many[::3].all()
        assert cells < 1 << 15 or many.mean() < 0.5
    assert a.counting_sketch(table.limit(0), 1 << 10) is None or not any(a.counting_sketch(table.limit(0), 1 << 10))
