import random
import re

from pyspark.sql import functions as F

from briefmill.llm import components as c
from briefmill.llm import minhash as m
from tests.llm.fixtures import SF, awkward, awkward_rows, docs_of, no_docs, words


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    size = min(width, len(w))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


def brute(rows, width, percent):
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[k] else i
        out.append((i, len(sets[k]), least, least == i))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_rows():
    draw = random.Random(5)
    rows = [(i, " ".join(words(100 + i, 80))) for i in range(40)]
    base = words(77, 300)
    for i in range(150):  # a group of copies edited to different degrees, linked only through others
        w = list(base)
        for _ in range(draw.randint(0, 16)):
            w[draw.randrange(len(w))] = f"edit{draw.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    boilerplate = words(78, 60)
    rows += [(3000 + i, " ".join(boilerplate + words(500 + i, 25))) for i in range(80)]  # alike, but below the similarity
    rows += [(5000 + i, rows[0][1]) for i in range(30)]
    draw.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = near_rows()
    assert got(m.near_duplicates(docs_of(spark, rows))) == brute(rows, 3, 85)
    assert got(m.near_duplicates(docs_of(spark, rows), 5, 80)) == brute(rows, 5, 80)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(m.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_awkward_documents(spark):
    assert got(m.near_duplicates(awkward(spark))) == brute([r[:2] for r in awkward_rows()], 3, 85)
    assert m.near_duplicates(no_docs(spark)).collect() == []
    assert m.near_duplicates(docs_of(spark, [(1, None), (2, "")])).count() == 2


def test_one_of_each_component_stays(spark):
    rows = near_rows()
    want = brute(rows, 5, 80)
    kept = m.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, keep in want if keep)
    awkward_kept = [r[0] for r in m.one_of_each(awkward(spark)).select("doc_id").collect()]
    assert awkward_kept.count(1) == 1 and 2 not in awkward_kept and 3 not in awkward_kept and {4, 5, 6} <= set(awkward_kept)


def test_bands_miss_one_pair_in_a_million(spark):
    for percent in (80, 85):
        rows = m.rows_a_band(percent)
        assert (1 - (percent / 100) ** rows) ** m.BANDS <= 1e-6


def test_components_equal_union_find(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(1, 1)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = c.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r.node, r.root) for r in df.collect()) == sorted((x, root[x]) for x in linked)


def test_a_pair_meets_on_full_sets_in_its_first_common_bucket_only(spark):
    base, bands = words(9, 400), m.BANDS
    other = [*base[:-2], "edited", "end"]
    docs = docs_of(spark, [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(words(10, 400)))])
    rows = m.rows_a_band(85)
    sketched = m.sketches(docs, 3, 85).collect()
    first, second = (next(r.buckets for r in sketched if r.doc_id == i) for i in (1, 2))
    common = [b for b in range(bands) if first[b] == second[b]]
    assert len(common) > 1
    chosen = spark.createDataFrame([(bytes(r["class"]), r.doc_id, r.text_key) for r in sketched], "node binary, doc_id bigint, text_key bigint")
    sets = m._sets(docs, chosen, 3, rows * bands, bands)
    left = spark.createDataFrame(
        [(b, r.buckets[b], bytes(r["class"]), bytes(r["class"])) for r in sketched for b in range(bands)], "band int, bucket bigint, node binary, label binary")
    kept = m._promising(left, sets, 85, rows * bands).collect()
    assert sorted(r.band for r in kept) == [common[0]] * 2
    assert m._promising(left.withColumn("label", F.lit(b"one")), sets, 85, rows * bands).collect() == []


def test_repeated_rows_give_a_set_once(spark):
    docs = docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (None, "e f g"), (None, "e f g")])
    sketched = m.sketches(docs, 3, 85).dropDuplicates(["class"]).select(F.col("class").alias("node"), "doc_id", "text_key")
    sets = m._sets(docs, sketched, 3, 180, m.BANDS)
    assert sorted((bytes(r.node), r.n) for r in sets.collect()) == sorted((bytes(r.node), 2 if r.doc_id else 1) for r in sketched.collect())


def test_only_named_sets_leave_the_table(spark):
    docs = docs_of(spark, [(i, " ".join(words(i, 40))) for i in range(50)])
    chosen = m.sketches(docs, 3, 85).select(F.col("class").alias("node"), "doc_id", "text_key")
    sets = m.written(m._sets(docs, chosen, 3, 180, m.BANDS), "sets")
    wanted = sets.select("node").limit(2)
    assert m._sets_of(wanted, sets).count() == 2


def test_rows_kept_for_sure_are_not_shuffled(spark):
    text = " ".join(words(1, 60))
    rows = [(1, text), (2, text), (3, "other words here"), (3, "other words here"), (4, "alone in the table"), (None, "no id at all"), (5, None)]
    docs = docs_of(spark, rows)
    sketched, placed = m._placed(docs, 5, 80, m.BANDS)
    order = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_key")
    chosen = placed.groupBy("component").agg(F.min(order).alias("least")).select("least.doc_id", "least.text_key")
    keys = {r.key for r in m._not_once(sketched, chosen).collect()}
    doubtful = docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("key")).collect()
    assert {r.doc_id for r in doubtful if r.key in keys} == {2, 3}
    assert sorted(repr(r.doc_id) for r in m.one_of_each(docs).collect()) == ["1", "3", "4", "5", "None"]
