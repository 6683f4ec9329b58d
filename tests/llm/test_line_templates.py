from collections import Counter, defaultdict

from briefmill.llm import line_templates as x
from tests.llm.fixtures import awkward, docs_of, no_docs, words


def brute(texts, depth, least, constant, least_tokens, copy_share):
    """The lines to drop of each distinct text."""
    mask = lambda t: "<*>" if any(c in "0123456789" for c in t) else t
    lines = {}
    for text in set(texts):
        for k, line in enumerate((text or "").split("\n")):
            tokens = line.encode().split()
            if len(tokens) >= least_tokens:
                lines[text, k] = tuple(mask(t.decode()) for t in tokens)
    leaf = lambda tokens: (len(tokens), tokens[:depth])
    votes = Counter()
    for text, tokens in {(text, tokens) for (text, _), tokens in lines.items()}:
        votes.update((leaf(tokens), p, t) for p, t in enumerate(tokens))
    template = {}
    for tokens in set(lines.values()):
        pattern = tuple(t if votes[leaf(tokens), p, t] >= least else "<*>" for p, t in enumerate(tokens))
        if sum(t != "<*>" for t in pattern) >= constant * len(pattern):
            template[tokens] = (leaf(tokens), pattern)
    found = defaultdict(set)
    for (text, _), tokens in lines.items():
        if tokens in template:
            found[template[tokens]].add(text)
    drop = defaultdict(list)
    for (text, k), tokens in lines.items():
        if tokens in template and len(found[template[tokens]]) >= least:
            drop[text].append(k)
    return {text: set(ks) for text, ks in drop.items() if sum(len(lines[text, k]) for k in ks) <= copy_share * len(text.encode().split())}


def rows():
    out = []
    for k in range(60):
        prose = [" ".join(words(1000 * k + j, 20)) for j in range(4)]
        if k % 2:
            prose.insert(1, f"User {k}17 logged in from host{k} at port {k} with status ok")
        if k % 3 == 0:
            prose.append("All rights reserved by the company forever")
        if k % 5 == 0:
            prose.insert(0, f"Posted by {words(k, 1)[0]}x in the section for all readers today")
        prose.append("too short")
        out.append((k, "\n".join(prose)))
    out += [(100 + k, out[0][1]) for k in range(20)]  # copies of one text are one document
    whole = [" ".join(words(5000 + j, 12)) for j in range(5)]
    out += [(200 + k, "\n".join([*whole, f"and {words(9000 + k, 1)[0]}"])) for k in range(15)]  # near copies are left to near-duplicate removal
    return out


def check(spark, rows, **options):
    defaults = {"depth": 2, "least_documents": 10, "least_constant": 0.7, "least_tokens": 3, "copy_share": 0.5} | options
    drop = brute([t for _, t in rows], *defaults.values())
    want = sorted((i, None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop.get(t, ())), len(drop.get(t, ()))) for i, t in rows)
    out = x.cleaned(docs_of(spark, rows), filter_bytes=1 << 10, **options)
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in out.collect()) == want
    whole = x.drop_recurring_lines(docs_of(spark, rows), filter_bytes=1 << 10, **options).collect()
    assert sorted((r.doc_id, r.text) for r in whole) == [w[:2] for w in want] and all(r.n_chars == len(r.text) for r in whole)
    return drop


def test_equals_brute_force(spark):
    drop = check(spark, rows())
    assert len(drop) > 30
    check(spark, rows(), least_documents=3)
    check(spark, rows(), depth=1, least_constant=0.5)


def test_variable_fields_are_generalised_and_copies_left(spark):
    got = {r.doc_id: r.text for r in x.cleaned(docs_of(spark, rows()), **x.SHORT).collect()}
    assert not any("logged in" in t or "All rights" in t for t in got.values())
    assert all("Posted by" not in got[k] for k in range(0, 60, 5))
    assert got[205] == dict(rows())[205]


def test_patterns_of_templates(spark):
    docs = docs_of(spark, rows())
    leaves = x._leaves(docs, 2, 10, 3)
    found, _ = x.recurring(x._candidates(docs, leaves, 2, 3, 1 << 12), 10, 0.7)
    patterns = {r.pattern: r.n_documents for r in found.collect()}
    assert patterns["All rights reserved by the company forever"] == 20
    assert patterns["Posted by <*> in the section for all readers today"] == 12


def test_awkward_documents(spark):
    rows_ = awkward(spark).collect()
    out = x.drop_recurring_lines(awkward(spark))
    assert out.columns == awkward(spark).columns
    assert sorted((repr(r.doc_id), repr(r.text)) for r in out.collect()) == sorted((repr(r.doc_id), repr(r.text)) for r in rows_)
    assert x.drop_recurring_lines(no_docs(spark)).collect() == []
    same = docs_of(spark, [(k, "one line of boilerplate\n" + " ".join(words(k, 30)) + "\n") for k in range(12)] + [(50, None), (51, "")])
    got = {r.doc_id: r.text for r in x.drop_recurring_lines(same).collect()}
    assert got[50] is None and got[51] == "" and got[3] == " ".join(words(3, 30)) + "\n"


def test_every_document_is_cleaned_and_only_near_copies_are_spared(spark):
    line = "read more of this story on our site today"
    passage = " ".join(words(77, 55))
    rows_ = [(k, " ".join(words(k, 30)) + "\n" + line) for k in range(12)]
    rows_ += [(100 + k, line + "\n" + " ".join(words(100 + k, 4))) for k in range(12)]  # more than half of it recurs
    rows_ += [(200 + k, passage + "\n" + " ".join(words(200 + k, 25))) for k in range(12)]
    rows_ += [(300 + k, f"user{k} logged in from host{k} at port {k} with status code ok\nsession of user{k} was closed by the server") for k in range(12)]
    copies = [" ".join(words(400 + j, 12)) for j in range(12)]
    rows_ += [(400 + k, "\n".join([*copies, words(9000 + k, 1)[0]])) for k in range(12)]
    rows_ += [(500, "\n".join([*copies, line]))]
    want = {i: "\n".join(x for x in t.split("\n") if x not in (line, passage) and "user" not in x) for i, t in rows_}
    got = {r.doc_id: r.text for r in x.cleaned(docs_of(spark, rows_), **x.SHORT).collect()}
    assert got == want
    assert got[100] == " ".join(words(100, 4)) and got[300] == "" and got[400] == dict(rows_)[400]


def test_long_short_and_unspaced_lines_recur(spark):
    long = " ".join(words(78, 52))
    rows_ = [(k, " ".join(words(k, 30))) for k in range(12)]
    rows_ = [(k, t + (f"\n{long}" if k < 3 else "") + "\nLes." + f"\n版权所有保留一切权利第{k}页" + "\n}\nshort line") for k, t in rows_[:9]] + [
        (k, t + "\nLes." + f"\n版权所有保留一切权利第{k}页" + "\n}") for k, t in rows_[9:]]
    got = {r.doc_id: r.text for r in x.cleaned(docs_of(spark, rows_), **x.SHORT).collect()}
    assert got == {k: " ".join(words(k, 30)) + ("\n}\nshort line" if k < 9 else "\n}") for k in range(12)}
    two = docs_of(spark, rows_[1:3])
    assert all(r.n_dropped == 0 for r in x.cleaned(two, **x.SHORT).collect())
