"""What the plans of retrieval read: the postings once for the rarest terms and once for the others, in buckets."""

import re

from pyspark.sql import functions as F

from briefmill.operators import search
from tests.test_search import CHUNK, QUERY


def stored_index(spark, folder):
    rows = [(f"c{k}", f"d{k % 5}", " ".join(f"w{(k * j) % 17}" for j in range(1, 30)), "Section 1", "general", []) for k in range(60)]
    chunks = spark.createDataFrame(rows, CHUNK)
    search.write_postings(search.postings(chunks), folder)
    return search.Index(chunks, spark.read.parquet(folder), search.term_stats(chunks), search.corpus_stats(chunks)), search.build_index(chunks)


def scans(df, folder):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan parquet" in line and "bucket#" in line], plan


def test_postings_are_read_twice_and_pruned_by_bucket(spark, tmp_path):
    folder = str(tmp_path / "postings")
    stored, plain = stored_index(spark, folder)
    queries = spark.createDataFrame([("a", "w3 w5", [], None, [], 10), ("b", "w7", [], "d1", [], 10), ("c", "w2 w3 w4", [], None, ["general"], 3)], QUERY)
    got = search.bm25_and(stored, queries)
    found, plan = scans(got, folder)
    print("\n".join(found))
    assert len(found) == 2, len(found)
    assert all(re.search(r"PartitionFilters: \[[^\]]*bucket", line) for line in found)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.bm25_and(plain, queries).collect()))


def test_phrases_read_the_postings_twice(spark, tmp_path):
    folder = str(tmp_path / "postings")
    stored, plain = stored_index(spark, folder)
    phrases = spark.createDataFrame([("p", ["w3", "w6"]), ("q", ["w5"])], "lookup_id string, words array<string>")
    got = search.phrase_hits(stored, phrases)
    found, plan = scans(got, folder)
    assert len(found) == 2
    key = lambda df: sorted((r.lookup_id, r.chunk_id, r.tf, round(r.idf, 9)) for r in df.collect())
    assert key(got) == key(search.phrase_hits(plain, phrases)) != []


def test_postings_table_is_sorted_in_bucket_directories(spark, tmp_path):
    folder = str(tmp_path / "postings")
    stored, _ = stored_index(spark, folder)
    assert stored.postings.filter(F.col("bucket") != search.bucket_of(F.col("term"))).count() == 0
    assert len({p.name for p in (tmp_path / "postings").glob("bucket=*")}) == stored.postings.select("bucket").distinct().count()


def test_postings_come_out_of_their_chunk_without_a_shuffle(spark):
    texts = ["a b a", "", "B é b_c b", "...", "x", "b " * 400]
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", t, "Section 1", "general", []) for i, t in enumerate(texts)], CHUNK)
    found = search.postings(chunks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in enumerate(texts):
        for place, w in enumerate(re.findall(r"\w+", t.lower())):
            want.setdefault((w, f"c{i}"), []).append(place)
    assert {(r.term, r.chunk_id): r.positions for r in found.collect()} == want
    assert all(r.tf == len(r.positions) for r in found.collect())
    assert sorted(map(tuple, search.stats_of_postings(found).collect())) == sorted(map(tuple, search.term_stats(chunks).collect()))


def test_chunks_that_lack_a_term_go_before_the_next_shuffle(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", t, "Section 1", "general", []) for i, t in enumerate(["a b", "a", "a", "b c", "b"])], CHUNK)
    index = search.build_index(chunks)
    lookups = spark.createDataFrame([("q", "a", "a", 1), ("q", "b", "b", 1), ("r", "c", "c", 1)], "lookup_id string, place string, term string, weight int")
    rarest, others = search.split_rarest(lookups, index.terms)
    found = search.with_others(rarest, others).join(index.postings.select("term", "chunk_id"), "term").select("lookup_id", "chunk_id", "others")
    rows = search.probed(index, found, others, "tf", "weight", "df").collect()
    assert sorted((r.lookup_id, r.chunk_id, r.p_tf) for r in rows) == [("q", "c0", 1), ("r", "c3", None)]
