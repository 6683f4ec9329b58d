import math
from collections import Counter

import numpy as np

from briefmill.llm import language_id as g
from tests.llm.fixtures import SF, awkward, docs_of, no_docs


def test_languages_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = g.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert sum(r.language == r.lang for r in rows) / len(rows) > 0.98
    assert sum(r.kept for r in rows) / len(rows) > 0.99


def test_text_alone_identifies_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = g.learn(g._evidence(docs.filter("doc_id % 2 = 0"), docs.text, docs.lang, docs.source))
    rows = docs.filter("doc_id % 2 = 1").collect()
    right = [profiles.languages[int(np.argmax(profiles.likelihoods(r.text.encode())))] == r.lang for r in rows if len(r.text) > 200]
    assert sum(right) / len(right) > 0.97


def test_scores_equal_brute_force(spark):
    """The fused posterior, computed document by document in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "concat(source, case when doc_id % 2 = 0 then '.example.de' else '' end) as source")
    rows = docs.collect()
    profiles = g.learn(g._evidence(docs, docs.text, docs.lang, docs.source))
    known = profiles.languages[:-1]
    like = {r.doc_id: profiles.likelihoods(r.text.encode()) for r in rows}
    text_language = {i: profiles.languages[int(np.argmax(x))] for i, x in like.items() if x is not None}
    suffix = lambda s: s.split(".")[-1] if "." in s else None
    share = lambda own, above, weight: {c: (own[c] + weight * above[c]) / (sum(own[x] for x in known) + weight) for c in known}
    overall = Counter(text_language.values())
    prior = {c: (overall[c] + 1) / (sum(overall[x] for x in known) + len(known)) * (1 - g.UNKNOWN_PRIOR) for c in known}
    by_suffix = {s: share(Counter(text_language.get(r.doc_id) for r in rows if suffix(r.source) == s), prior, g.SUFFIX_WEIGHT) for s in {suffix(r.source) for r in rows} if s}
    by_host = {}
    for host in {r.source for r in rows}:
        own = Counter(text_language.get(r.doc_id) for r in rows if r.source == host)
        by_host[host] = share(own, by_suffix.get(suffix(host), prior), g.HOST_WEIGHT)
    pairs = Counter((r.lang, text_language.get(r.doc_id)) for r in rows)
    got = {r.doc_id: r for r in g.identify(docs).collect()}
    for r in rows:
        if like[r.doc_id] is None:
            assert not got[r.doc_id].kept
            continue
        scores = [like[r.doc_id][k] + math.log(by_host[r.source][c]) + math.log((pairs[r.lang, c] + 1) / (sum(pairs[x, c] for x in known) + len(known))) for k, c in enumerate(known)]
        scores.append(like[r.doc_id][-1] + math.log(g.UNKNOWN_PRIOR) - math.log(len(known)))
        top = max(scores)
        assert got[r.doc_id].language == profiles.languages[scores.index(top)]
        assert abs(got[r.doc_id].confidence - 1 / sum(math.exp(s - top) for s in scores)) < 1e-5


def test_priors_decide_short_texts_and_junk_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame(
        [(-1, "12345 !!!", "en", "src1"), (-2, "qx zjw xqk vvkq jxz qqwx " * 40, "en", "src1"), (-3, None, "en", "src1"), (-4, "", "en", None), (-5, "e", "de", "src1"), (-6, "e", "fr", "src1")],
        "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in g.identify(docs.unionByName(more)).collect() if r.doc_id < 0}
    assert [got[-k].kept for k in (1, 2, 3, 4)] == [False] * 4
    assert got[-5].language == "de" and got[-6].language == "fr"
    assert sorted(r.doc_id for r in g.keep_identified(more.unionByName(docs)).filter("doc_id < 0").collect()) == [-6, -5]


def test_awkward_documents(spark):
    rows = g.identify(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    kept = g.keep_identified(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == sum(r.kept for r in rows)
    assert g.identify(no_docs(spark)).collect() == []
    undeclared = docs_of(spark, [(1, "some text"), (2, None)]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.doc_id: r.kept for r in g.identify(undeclared).collect()} == {1: True, 2: False}
    assert [r.doc_id for r in g.keep_identified(undeclared).collect()] == [1]


def test_a_rare_language_is_kept(spark):
    """Three declared documents among four hundred are enough, and with no declarations nothing with letters goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' and length(text) > 100").limit(400).select("doc_id", "text", "lang", "source")
    rare = "La rapida bruna vulpo saltas trans la maldiligenta hundo kaj ĉiuj najbaroj aŭdas ĝian bojadon dum la longa nokto en nia vilaĝo "
    more = spark.createDataFrame([(-k, rare * k + "ŝi diris ke jes", "eo", "src1") for k in (1, 2, 3)], "doc_id bigint, text string, lang string, source string")
    both = docs.unionByName(more)
    got = {r.doc_id: (r.language, r.kept) for r in g.identify(both).collect() if r.doc_id < 0}
    assert got == {-k: ("eo", True) for k in (1, 2, 3)}
    bare = both.withColumn("lang", g.F.lit(None).cast("string"))
    assert g.keep_identified(bare).count() == both.count()


def test_evidence_of_pages(spark):
    page = spark.createDataFrame([('<!DOCTYPE html><html class=x lang="de-AT"><p lang=fr>', "www.x.example.FR:80"), (None, "localhost")], "html string, host string")
    row, none = page.select(g.declared_code(g.markup_language(page.html)).alias("d"), g.suffix_of(page.host).alias("s")).collect()
    assert (row.d, row.s, none.d, none.s) == ("de", "fr", None, None)
