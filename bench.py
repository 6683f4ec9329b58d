"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Results are consumed by a sink
that drops them, so the time is the query's own."""

from __future__ import annotations

import json
import os
import sys
import time

from briefmill.plans import catalog, hitl_queries, inputs
from briefmill.session import build_session

HEADLINE = [
    "src_dedup_fingerprint", "txt_chunk_build", "txt_classify_clause", "ir_postings", "ir_bm25_and_topk", "ir_phrase_should",
    "ir_section_pointers", "route_specialists", "fnd_dedup", "fnd_dimension_gate", "deb_gate_passage", "deb_finding_consensus",
    "ent_tier1", "gr_nodes", "gr_cooccurrence_edges", "hitl_transition_check", "hitl_delta_scope", "vrd_severity_counts",
    "vrd_brief",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        times[name] = round(time.time() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    # Chunks, their documents' digests and postings are stored tables; building and writing them is timed on its own.
    timed("store_chunks", lambda: inputs.chunks(spark, sf_dir))
    timed("store_digests", lambda: hitl_queries.document_digests(spark, sf_dir))
    timed("store_postings", lambda: inputs.index(spark, sf_dir))
    for key in wanted:
        timed(key, lambda: catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
