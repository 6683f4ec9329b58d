"""Ranks of a brief do not depend on the order in which arguments are added up."""

import random

from pyspark.sql import functions as F

from briefmill.operators import verdict


def test_confidences_and_ranks_do_not_depend_on_row_order(spark):
    draw = random.Random(7)
    rows = [(f"F{i}", f"a{i}-{k}", draw.choice(["high", "medium", "speculative"]), draw.random() < 0.1) for i in range(80) for k in range(draw.randint(1, 18))]
    arguments = spark.createDataFrame(rows, "finding_id string, argument_id string, confidence string, dropout_flag boolean")
    findings = spark.createDataFrame([(f"F{i}", "D0", ["critical", "low"][i % 2]) for i in range(81)], "finding_id string, deal_id string, severity string")
    seen = set()
    for seed, parts in ((1, 1), (2, 3), (3, 8), (4, 20)):
        shuffled = arguments.orderBy(F.rand(seed)).repartition(parts, F.rand(seed))
        confidence = verdict.calibrated_confidence(findings, shuffled)
        ranked = verdict.ranked(findings.join(confidence.withColumnRenamed("calibrated_confidence", "confidence"), "finding_id"))
        seen.add(tuple(sorted((r.finding_id, r.confidence, r["rank"]) for r in ranked.collect())))
    assert len(seen) == 1
    [only] = seen
    want = {}
    for finding, _, confidence, dropped in rows:
        if not dropped:
            want.setdefault(finding, []).append({"high": 9, "medium": 5, "speculative": 1}[confidence])
    assert all(abs(c - (sum(want[f]) / len(want[f]) / 10 if f in want else 0.5)) < 1e-6 for f, c, _ in only)
    by_rank = sorted(only, key=lambda r: r[2])
    kind = {f"F{i}": i % 2 for i in range(81)}
    assert by_rank == sorted(only, key=lambda r: (kind[r[0]], -r[1], r[0]))
