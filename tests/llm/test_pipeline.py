"""The pipeline against its stages' brute-force versions on a small fixture."""

from tokenizers import Tokenizer

import corpus_pipeline as p
from briefmill.llm import bpe
from tests.llm import test_decontaminate, test_line_templates, test_minhash
from tests.llm.fixtures import words


def fixture(spark, folder):
    docs = []
    for k in range(40):
        lines = [" ".join(words(100 * k + j, 25)) for j in range(4)]
        if k % 2:
            lines.insert(2, f"Visit number {k} of this page was logged here")
        docs.append((k, "\n".join(lines), "en", "src0", 0))
    docs += [(50, docs[3][1], "en", "src0", 0), (51, docs[4][1].replace("\n", " added\n", 1), "en", "src1", 0)]
    docs += [(60, None, "en", "src0", 0), (61, "", "en", "src0", 0), (62, "0123 !!", None, None, 0), (None, docs[5][1] + " x", "en", "src0", 0), (7, docs[7][1], "en", "src0", 0)]
    bench = [(1, docs[8][1].split("\n")[0]), (2, "nothing like it"), (3, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_each_stage_on_its_own_input(spark, tmp_path):
    _, bench = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(p.STAGES):
        out = p.written(stage(spark, docs, str(tmp_path)), name)
        kept.append((docs, out))
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    before, after = kept[0]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {60, 61, 62}
    before, after = kept[1]
    drop = test_line_templates.brute([t for _, t in rows(before)], 2, 10, 0.7, 3, 0.5)
    assert drop and rows(after) == sorted(((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop.get(t, ()))) for i, t in rows(before)), key=repr)
    before, after = kept[2]
    want = {i for i, _, _, keep in test_minhash.brute(rows(before), 5, 80) if keep}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    before, after = kept[3]
    items = [(i, t) for i, t in bench if t]
    assert rows(after) == [r for r in rows(before) if not test_decontaminate.brute(r[1], items)[4]] and after.count() < before.count()
    before, after = kept[4]
    library = Tokenizer.from_file(bpe.TOKENIZER)
    assert sorted((r.doc_id, list(r.ids)) for r in after.collect()) == sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in rows(before))


def test_run_equals_the_stages_and_empty_tables_pass(spark, tmp_path):
    fixture(spark, f"{tmp_path}/a")
    got = p.run(spark, f"{tmp_path}/a")
    assert got.count() > 20 and got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert p.run(spark, f"{tmp_path}/b").collect() == []
