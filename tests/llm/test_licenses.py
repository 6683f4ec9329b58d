import random

from briefmill.llm import licenses as x
from tests.llm.fixtures import awkward, docs_of, no_docs, words


def brute(text, least=x.LEAST):
    """Names of templates that some passage of any size reaches, by comparing all passages."""
    w = x.normal_words(text.encode())
    out = set()
    for name, template in x.TEMPLATES.items():
        t = x.normal_words(template.encode())
        want = set(zip(t, t[1:]))
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + 2 * len(t)) + 1):
                if x.dice(set(zip(w[a:b], w[a + 1 : b])), want) >= least:
                    out.add(name)
    return out


NOTICES = [n for n in x.TEMPLATES if n.startswith("notice")]


def cases():
    prose = " ".join(words(3, 40))
    out = [f"{prose}\n{x.TEMPLATES[n]}\n{prose}" for n in NOTICES]
    out += [f"{prose} {x.TEMPLATES[n].upper()} {prose}" for n in NOTICES]
    out += [prose, "the license of the version", "Licensed under | CC | BY-NC 4.0", "All rights are reserved", "a licensed work under the general public"]
    return out


def test_notices_equal_brute_force(spark):
    rows = list(enumerate(cases()))
    got = {r.doc_id: {m.license for m in r.matches} for r in x.licences(docs_of(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_whole_licences_with_edits(spark):
    rows = []
    for k, (name, text) in enumerate(x.TEMPLATES.items()):
        w = text.split()
        if len(w) > 25:
            w[len(w) // 2] = "edited"
            w.insert(len(w) // 3, "extra words")
        rows.append((k, "é head\n\n" + " ".join(w) + "\n\ntail"))
    got = {r.doc_id: r.matches for r in x.licences(docs_of(spark, rows)).collect()}
    for k, name in enumerate(x.TEMPLATES):
        rivals = [m for m in got[k] if name.startswith("notice") or not m.license.startswith("notice")]  # a header holds its notice
        best = max(rivals, key=lambda m: m.dice)
        assert best.license == name, (name, got[k])
        body = rows[k][1][best.start : best.end]
        sets = [set(zip(w, w[1:])) for w in (x.normal_words(body.encode()), x.normal_words(x.TEMPLATES[name].encode()))]
        assert x.dice(*sets) == best.dice


def test_awkward_documents(spark):
    assert x.summary(awkward(spark)).count() == awkward(spark).count()
    assert {r.n_matches for r in x.summary(awkward(spark)).collect()} == {0}
    assert x.summary(no_docs(spark)).collect() == []
    twice = x.summary(docs_of(spark, [(1, "All rights reserved. All rights reserved."), (1, "All rights reserved. All rights reserved.")])).collect()
    assert [r.n_matches for r in twice] == [2, 2]


def test_versions_full_texts_and_long_insertions(spark):
    prose = " ".join(words(5, 30)) + " of the work in the terms of the copy "
    every = x.all_templates()
    names = [n for n in every if n not in x.TEMPLATES]
    rows = [(k, f"{prose}\n{every[n]}\n{prose}") for k, n in enumerate(names)]
    rows.append((900, prose + "\nThis work is licensed under the GNU General Public License, version 2."))
    mit = x.TEMPLATES["MIT"].split()
    rows.append((901, " ".join([*mit[:80], *words(6, 50), *mit[80:]])))
    got = {r.doc_id: {m.license for m in r.matches} for r in x.licences(docs_of(spark, rows)).collect()}
    for k, n in enumerate(names):
        found = {m for m in got[k] if n.startswith("notice") or not m.startswith("notice")}
        assert n in found and (n.startswith("text") or found == {n}), (n, got[k])
    assert got[900] == {"notice-GPL-2.0"} and got[901] == {"MIT"}


def test_variants_that_are_not_held_do_not_match(spark):
    text = x.all_templates()["text-GPL-3.0"].replace("GNU General Public", "GNU Affero General Public")
    assert not any(m.license == "text-GPL-3.0" for r in x.licences(docs_of(spark, [(1, text)])).collect() for m in r.matches)


def test_repeated_licences_are_all_found():
    """Copies of one licence, next to each other or with words between them, as in third-party notices."""
    templates = x.all_templates()
    matcher = x.Matcher(templates)
    draw = random.Random(3)
    filler = lambda n: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))
    for name, body in templates.items():
        inside = {m[2] for m in matcher.matches(x.normal_words(body.encode()))}
        for n in (0, 1, 7, 50, 150):
            for copies in (2, 3):
                text = f" {filler(n)} ".join([body] * copies)
                found = [m[2] for m in matcher.matches(x.normal_words(f"{filler(20)} {text} {filler(9)}".encode()))]
                assert found.count(name) == copies and set(found) <= inside, (name, n, found)
