import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from briefmill.llm import bpe
from tests.llm.fixtures import SF, awkward, awkward_rows, no_docs

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def own():
    with open(bpe.TOKENIZER, encoding="utf-8") as file:
        return bpe.TextEncoder(bpe.Vocabulary(file.read()))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_awkward_documents_equal_the_library(spark, library):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(awkward(spark)).collect()), key=repr)
    assert got == sorted(((r[0], *expected(library, r[1])) for r in awkward_rows()), key=repr)


def test_table_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in docs.collect()}


def test_other_columns_stay_and_round_trip(spark):
    rows = bpe.decode(bpe.encode(awkward(spark))).collect()
    assert all(r.decoded == (r.text or "") and r.source == s for r, s in zip(rows, [x[3] for x in awkward_rows()]))
    assert bpe.digests(no_docs(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["the", " th", "ing", "aa", "a", "  ", "\n", "'s", "ß", "日", "12", "--", "<|endoftext|>"]), st.text(max_size=4)), max_size=30))
def test_any_text_equals_the_library(own, library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    flat, ends = own.encode([text])
    assert flat.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(flat)]


def test_memory_bound_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    texts = [r[1] for r in awkward_rows() if r[1] and len(r[1]) < 5000]
    flat, ends = own.encode(texts)
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
