import hashlib
import re

from pyspark.sql import functions as F

from briefmill.llm import mixing as m
from tests.llm.fixtures import DOCUMENTS, SF, awkward, awkward_rows, no_docs, words


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows, weights=(5, 2, 1), share=1.5, repeats=2):
    """Sorted (doc_id, size, source_size, target, taken) by plain fair queueing over (doc_id, text, source) rows."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = share * total - sum(repeats * sizes[s] for s in full)
        level = rest / (sum(weight[s] for s in order if s not in full) or 1)
        above = {s for s in order if s not in full and weight[s] * level > repeats * sizes[s]}
        if not above:
            break
        full |= above
    target = {s: repeats * sizes[s] if s in full else weight[s] * level for s in order}
    entries = []
    for place, s in enumerate(order):
        queue = sorted(
            (turn, int(hashlib.md5(f"{turn}:{'' if i is None else i}".encode()).hexdigest()[:15], 16), (i is not None, i or 0), size_of(text), k)
            for turn in range(1, repeats + 1) for k, (i, text, source) in enumerate(rows) if source == s and size_of(text))
        upto = 0
        for turn, key, i, size, k in queue:
            upto += size
            entries.append((upto / target[s], place, turn, key, i, size, k))
    taken, used = {}, 0
    for *_, size, k in sorted(entries):
        used += size
        if used > share * total:
            break
        taken[k] = taken.get(k, 0) + size
    return sorted(((i, size_of(text), sizes[s], target[s], taken.get(k, 0)) for k, (i, text, s) in enumerate(rows)), key=repr)


def agree(got, want):
    got = sorted(map(tuple, got), key=repr)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all(abs(a[3] - b[3]) <= 1e-9 * b[3] for a, b in zip(got, want))


def docs_with_sources(spark, rows):
    return spark.createDataFrame([(i, x, "en", s, len(x or ""), *["x"] * 10) for i, x, s in rows], DOCUMENTS)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    agree(m.taken(docs).collect(), brute([(r.doc_id, r.text, r.source) for r in docs.collect()]))


def test_queues_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(m, "RANGE_ROWS", 7)
    rows = [(i, " ".join(words(i, 1 + i * 37 % 90)), f"s{min(i % 7, 4)}") for i in range(400)]
    agree(m.taken(docs_with_sources(spark, rows)).collect(), brute(rows))


def test_each_source_comes_near_its_target(spark):
    sources = ["a", "a", "a", "b", "c", "d", None]  # a hot one
    rows = [(i, " ".join(words(i, 1 + i * 13 % 60)), sources[i % 7]) for i in range(700)]
    got = m.taken(docs_with_sources(spark, rows)).collect()
    agree(got, brute(rows))
    of = {i: s for i, _, s in rows}
    for s in set(sources):
        own = [r for r in got if of[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_awkward_documents(spark):
    agree(m.taken(awkward(spark)).collect(), brute([(r[0], r[1], r[3]) for r in awkward_rows()]))
    assert m.taken(no_docs(spark)).collect() == []
    blank = docs_with_sources(spark, [(1, None, "a"), (2, "", None)])
    assert sorted(tuple(r) for r in m.taken(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_other_weights_and_the_mix_itself(spark):
    rows = [(i, " ".join(words(i, 1 + i % 20)), "xyz"[i % 3]) for i in range(90)]
    docs = docs_with_sources(spark, rows)
    agree(m.taken(docs, (1, 3), (1, 2), 3).collect(), brute(rows, (1, 3), 0.5, 3))
    mix = m.mixture(docs)
    assert mix.columns == ["doc_id", "source", "turn", "size", "finish"]
    sums = {(r.doc_id): r.s for r in mix.groupBy("doc_id").agg(F.sum("size").alias("s")).collect()}
    assert sums == {r.doc_id: r.taken for r in m.taken(docs).collect() if r.taken}
    assert sorted(map(tuple, mix.collect()), key=repr) == sorted(map(tuple, m.mixture(docs.repartition(3)).collect()), key=repr)
