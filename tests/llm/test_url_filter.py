from pyspark.sql import functions as F

from briefmill.llm import url_filter as u

URLS = {
    "http://a.net/x": ("a.net", "/x", "net/", "block"),
    "https://www.EXAMPLE.net/en/1?q=/": ("www.example.net", "/en/1", "example.net/en/", "allow"),
    "https://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"),
    "http://a.net?x=/": ("a.net", "", None, "allow"),
    "http://a.net": ("a.net", "", None, "allow"),
    "x://example.com/de/#a/b": ("example.com", "/de/", "example.com/de/", "block"),
    "x://m.example.com/de": ("m.example.com", "/de", None, "allow"),
    "x://cheap-pills.example.com/fr/": ("cheap-pills.example.com", "/fr/", None, "block"),
    "x://cheap-pills.example.org/fr/2": ("cheap-pills.example.org", "/fr/2", "org/fr/", "allow"),
    "x://a.b://c/d": ("a.b:", "//c/d", None, "allow"),
    "no scheme/net/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "x://h.org/fr/a\nb?c": ("h.org", "/fr/a\nb", "org/fr/", "allow"),
}


def test_rules_and_method(spark):
    rows = [(k, url, "x", "y") for k, url in enumerate(URLS)] + [(0, "http://a.net/x", "x", "y"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judged(pages).collect()}
    assert got == {(k, *v) for k, v in enumerate(URLS.values())} | {(None, "", "", None, "allow")}
    assert u.judged(pages).count() == len(rows)
    assert u.judged(pages.limit(0)).collect() == []


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(u, "BITS", 2)  # many false positives, so many levels
    universe = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    for most_bytes in (16_000_000, 2_000):
        built = u.cascades(universe, most_bytes)
        assert max(map(len, built)) > 2 and (len(built) > 1) == (most_bytes == 2_000)
        wrong = universe.filter(u.listed(F.col("key"), built) != F.col("listed"))
        assert wrong.count() == 0


def test_no_listed_key(spark):
    universe = spark.createDataFrame([("a", False)], "key string, listed boolean")
    built = u.cascades(universe)
    assert built == [[]]
    assert universe.filter(u.listed(F.col("key"), built)).count() == 0
