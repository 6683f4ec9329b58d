"""Name resolution and graph against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from briefmill.functions import name_blocks
from briefmill.functions import similarity as sim
from briefmill.operators import entities as ent
from briefmill.operators import graph as gr


def slow_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b))


def ratio(a, b):
    return round(slow_ratio(a, b), 12)


def words(count, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < count:
        word = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))).strip()
        if word:
            out.add(word)
            cut = rng.randrange(len(word))
            if len(word) > 1 and (word[:cut] + word[cut + 1:]).strip() == word[:cut] + word[cut + 1:]:
                out.add(word[:cut] + word[cut + 1:])
    return sorted(out)


def test_ratio_is_twice_the_common_subsequence(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("ab ") for _ in range(n)) for n in (61, 62, 63, 90)]
    rows = [*itertools.product(words(12, 1), words(12, 2)), *itertools.product(long, long), *itertools.product(long, ["a", "é🙂b"])]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("masks", sim.position_masks(F.col("a")))
    for r in df.withColumn("ratio", sim.indel_ratio(F.col("a"), F.col("masks"), F.col("b"))).collect():
        assert r.ratio == pytest.approx(slow_ratio(r.a, r.b))
    both_empty = spark.createDataFrame([("", "")], "a string, b string").withColumn("masks", sim.position_masks(F.col("a")))
    assert both_empty.select(sim.indel_ratio(F.col("a"), F.col("masks"), F.col("b"))).first()[0] == 1.0


@pytest.mark.parametrize("minimum", [0.85, 0.80, 0.7, 0.55])
def test_similar_pairs_are_complete(spark, minimum):
    left, right = words(80, 3), words(80, 4)
    frame = lambda names: spark.createDataFrame([("t", n) for n in names], "entity_type string, norm string")
    rows = ent.similar_pairs(frame(left), frame(right), minimum).collect()
    got = {(r["norm"], r["other"]) for r in rows}
    assert len(rows) == len(got)
    want = {(a, b) for a in left for b in right if ratio(a, b) >= minimum}
    assert got == want


def resolve(spark, names, candidates):
    n = spark.createDataFrame(names, "deal_id string, entity_type string, name string")
    c = spark.createDataFrame(candidates, "deal_id string, entity_type string, candidate string")
    return {r["name"]: (r["canonical"], r["tier"], r["confidence"]) for r in ent.resolve(n, c).collect()}


def test_tiers(spark):
    got = resolve(spark, [("x", "organization", n) for n in (
        "ACME holdings, ", "Director Acme Holdings", "Acme Holdigs", "Something else", "Acme Holdxxxx")],
        [("y", "organization", "Acme Holdings"), ("y", "organization", "Zeta")])
    assert got["ACME holdings, "][:2] == ("Acme Holdings", 1)
    assert got["Director Acme Holdings"][:2] == ("Acme Holdings", 1)
    assert got["Acme Holdigs"][:2] == ("Acme Holdings", 2)
    assert got["Something else"][1] is None
    assert got["Acme Holdxxxx"][1] is None and got["Acme Holdxxxx"][2] == pytest.approx(ratio("acme holdxxxx", "acme holdings"))


def test_ties_and_bundle_bonus(spark):
    tie = resolve(spark, [("x", "asset", "alpha beta gamma")], [("y", "asset", "alpha beta gammaa"), ("y", "asset", "alpha beta gammab")])
    assert tie["alpha beta gamma"][1] is None and tie["alpha beta gamma"][2] > 0.85
    bonus = resolve(spark, [("x", "asset", "alpha beta gamma")], [("x", "asset", "alpha beta gammaa"), ("y", "asset", "alpha beta gammab")])
    assert bonus["alpha beta gamma"][:2] == ("alpha beta gammaa", 2)


def test_contenders_equal_all_pairs(spark):
    """The search by levels finds every candidate close to a name's best one, and nothing else."""
    found, known = (sorted({" ".join(w.split()) for w in words(70, seed)}) for seed in (5, 6))
    deals = ["x", "y", "z"]
    names = [(deals[k % 3], "t", n) for k, n in enumerate(found)] + [(deals[(k + 1) % 3], "t", n) for k, n in enumerate(found[:20])]
    candidates = [(deals[k % 3], "t", c) for k, c in enumerate(known)]
    want = set()
    for deal, _, n in names:
        score = {c: min(ratio(n, c) + 0.05, 1.0) if (deal, "t", c) in candidates else ratio(n, c) for c in known}
        best = max(score.values())
        if best >= 0.6 - 1e-9:
            want |= {(deal, n, c, round(v, 9)) for c, v in score.items() if v >= max(best - 0.05, 0.6) - 1e-12}
    got = ent.contenders(spark.createDataFrame(names, "deal_id string, entity_type string, name string"),
                         spark.createDataFrame(candidates, "deal_id string, entity_type string, candidate string")).collect()
    got = {(r["deal_id"], r["name"], r["candidate"], round(r["score"], 9)) for r in got}
    edge = {w for w in want ^ got}  # only scores on the very bound may differ by rounding
    best = {}
    for deal, n, c, v in want:
        best[deal, n] = max(best.get((deal, n), 0), v)
    assert [(w, w in got, best.get(w[:2])) for w in edge if min(abs(best.get(w[:2], 0) - w[3] - 0.05), abs(w[3] - 0.6)) > 1e-6] == []


@pytest.mark.parametrize("a, b, same", [
    ("J Smith", "John Smith", True), ("Smith J", "John Smith", True), ("John Smith", "Smith, J.", True), ("Jo Smith", "John Smith", False),
    ("J Smith", "Anna Smith", False), ("J Smith Jr", "John Smith", False),
])
def test_person_match(spark, a, b, same):
    n = spark.createDataFrame([("person", a)], "entity_type string, name string")
    c = spark.createDataFrame([("person", b)], "entity_type string, candidate string")
    assert bool(ent.person_pairs(n, c).collect()) is same


def test_canonical_names_follow_chains(spark):
    seen = [("t", "alpha beta gamma delta", 1), ("t", "Alpha, beta gamma delta", 2), ("t", "alpha beta gamma delt", 3),
            ("t", "alpha beta gamma del", 4), ("t", "unlike", 5)]
    got = {r["name"]: r["canonical"] for r in ent.canonicalise(spark.createDataFrame(seen, "entity_type string, name string, seq int")).collect()}
    assert got == {"alpha beta gamma delta": "alpha beta gamma delta", "alpha beta gamma delt": "alpha beta gamma delta",
                   "alpha beta gamma del": "alpha beta gamma delta", "unlike": "unlike"}


def test_decisions(spark):
    queue = spark.createDataFrame([("x", "t", n, "Acme", 0.7) for n in "abcdef"], "deal_id string, entity_type string, name string, candidate string, score double")
    registry = spark.createDataFrame([("y", "t", "Acme"), ("z", "t", "Acme"), ("y", "t", "Zeta"), ("y", "u", "Other")], "deal_id string, entity_type string, candidate string")
    rows = [("x", "t", "f", True, "Zeta", 0.8, "far", False), ("x", "t", "a", True, "Acme", 0.9, "same", False), ("x", "t", "b", False, None, 0.9, "no", False), ("x", "t", "c", True, "Other", 0.9, "?", False),
            ("x", "t", "d", None, None, None, None, True)]
    decisions = spark.createDataFrame(rows, "deal_id string, entity_type string, name string, merge boolean, canonical_name string, confidence double, reason string, failed boolean")
    got = {r["name"]: (r["canonical"], r["tier"], r["reason"]) for r in ent.apply_decisions(queue, decisions, registry).collect()}
    assert got == {"a": ("Acme", 3, "same"), "b": ("b", None, "llm_rejected_merge"), "c": ("c", None, "llm_returned_unknown_canonical_name"),
                   "d": ("d", None, "llm_resolution_failed"), "f": ("Zeta", 3, "far"), "e": ("e", None, "no_llm_resolution_available")}


def test_links_equal_pairwise_comparison(spark):
    rng = random.Random(5)
    held = {f"c{i}": {f"n{rng.randrange(9)}" for _ in range(rng.randint(0, 2))} for i in range(8)}
    members = [(c, n) for c, nodes in held.items() for n in nodes]
    edges = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(4)}
    findings = [(f"d{i % 2}", f"f{i}", f"c{rng.randrange(8)}") for i in range(20)]
    want = set()
    for (d1, f1, c1), (d2, f2, c2) in itertools.permutations(findings, 2):
        crossing = any((a, b) in edges or (b, a) in edges for a in held[c1] for b in held[c2])
        if d1 == d2 and (held[c1] & held[c2] or crossing):
            want.add((f1, f2))
    found = spark.createDataFrame(findings, "deal_id string, finding_id string, citation_chunk_id string")
    rows = spark.createDataFrame(members, "chunk_id string, node_id string")
    hubs = gr.finding_hubs(found, rows)
    got = gr.links_of(found, hubs, spark.createDataFrame(sorted(edges), "src string, dst string"))
    assert {(r["finding_id"], r["linked_id"]) for r in got.collect()} == want


def test_edges_are_symmetric(spark):
    rows = spark.createDataFrame([("c1", "s", n) for n in "abc"] + [("c2", "s", "a")], "chunk_id string, section_id string, node_id string")
    pairs = {(r["src"], r["dst"]) for r in gr.cooccurrence_rows(rows).collect()}
    assert pairs == set(itertools.permutations("abc", 2))


def test_encoded_graph_restores(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], {"k": 1})], "node_id string, aliases array<string>, extra map<string,int>")
    gr.save_encoded(df, str(tmp_path / "g"))
    assert gr.load_encoded(spark, str(tmp_path / "g"), df.schema).collect() == df.collect()


def test_the_whole_review_queue_holds_candidates_far_below_the_best(spark):
    resolutions = spark.createDataFrame(
        [("D0", "organization", "abcdefgh", "unconfirmed_node", 0.75), ("D0", "organization", "settled", "confirmed", 1.0)],
        "deal_id string, entity_type string, name string, status string, confidence double")
    candidates = spark.createDataFrame(
        [("D1", "organization", "abcdefxy"), ("D1", "organization", "abcdexyz"), ("D1", "organization", "zzzzzzzz"), ("D1", "organization", "settles")],
        "deal_id string, entity_type string, candidate string")
    got = {(r.name, r.candidate): round(r.score, 6) for r in ent.whole_review_queue(resolutions, candidates).collect()}
    assert got == {("abcdefgh", "abcdefxy"): 0.75, ("abcdefgh", "abcdexyz"): 0.625}


def test_blocks_of_names_find_the_pairs_that_single_comparisons_find(spark, monkeypatch):
    """Names of any length in several blocks a type; names far below a name's best one may be left out, none within reach."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abñ é") for _ in range(n))
    texts = sorted({word(rng.choice([1, 2, 5, 9, 14, 61, 62, 63, 80])) for _ in range(220)} | {"", "a" * 90, "a" * 88})
    left, right = texts[::2], texts[1::2] + texts[:20:2]
    monkeypatch.setattr(ent, "BLOCK_NAMES", 40)
    frame = lambda xs: spark.createDataFrame([(t, x) for t in ("person", None) for x in [*xs, None]], "entity_type string, norm string")
    want = {(a, b): r for a in left for b in right if (r := name_blocks._one_ratio(a, b)) >= 0.55}
    got = ent.similar_pairs(frame(left), frame(right), 0.55).collect()
    assert {(r.norm, r.other): r.ratio for r in got} == want and len(got) == len(want)
    best = {a: max(r for (x, _), r in want.items() if x == a) for a, _ in want}
    near = {(r.norm, r.other) for r in ent.similar_pairs(frame(left), frame(right), 0.55, 0.1).collect()}
    assert {k for k, r in want.items() if r >= best[k[0]] - 0.1} <= near <= set(want)
    own = ent.similar_pairs(frame(texts), None, 0.7).collect()
    assert {(r.norm, r.other): r.ratio for r in own} == {
        (a, b): r for a in texts for b in texts if a != b and (r := name_blocks._one_ratio(a, b)) >= 0.7} and len(own) == len({(r.norm, r.other) for r in own})
