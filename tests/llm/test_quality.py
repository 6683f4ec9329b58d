import numpy as np
from pyspark.sql import functions as F

from briefmill.llm import quality as q
from tests.llm.fixtures import SF, awkward, awkward_rows, no_docs

SPACE = " \t\n\v\f\r"


def brute(text):
    text = text or ""
    words, word = [], ""
    for ch in text + " ":
        if ch in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += ch
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 3000 else None
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_base_counts_equal_brute_force(spark):
    extra = [(50, "a b c a b c d\n\n x \n x \n x\n| a b c |"), (51, "a a a a a"), (52, "l\nl \nl")]
    rows = [r[:2] for r in awkward_rows()] + extra + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for _, text in rows:
        got, want = q.statistics(None if text is None else text.encode())[0], brute(text)
        assert all(w is None or g == w for g, w in zip(got, want)), text[:80]


def held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    model = q.train(docs, labels.filter(~fold))
    rows = q.scored(docs, model).join(labels.filter(fold).select("doc_id", "quality"), "doc_id").collect()
    return model, rows


def test_held_out_accuracy(spark):
    _, rows = held_out(spark, "/root/testdata/sf0.01")
    right = [(r.score >= q.KEEP_FROM) == (r.quality == 1) for r in rows]
    assert len(right) > 80 and sum(right) / len(right) > 0.9


def test_scores_are_monotone_and_flat_trees_equal_a_walk():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) - x[:, 2] + draw.normal(0, 0.3, 3000)) > 0).astype(float)
    model = q.fit(x, y, [1, 0, -1])
    assert ((model.probability(x) > 0.5) == y).mean() > 0.8
    for f, sign in ((0, 1), (2, -1)):
        probe = np.repeat(x[:200], 50, 0)
        probe[:, f] = np.tile(np.linspace(0, 1, 50), 200)
        steps = np.diff(model.probability(probe).reshape(200, 50), axis=1) * sign
        assert steps.min() >= -1e-12

    def walk(row):
        total = model.bias
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.probability(x[:50]), [walk(r) for r in x[:50]])


def test_without_labels_only_base_rules_judge(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = q.judged(awkward(spark), labels).collect()
    assert len(rows) == awkward(spark).count() and all(r.kept != r.base_failed for r in rows)
    assert q.judged(no_docs(spark), labels).collect() == []
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    assert q.judged(awkward(spark), one).count() == len(rows)
