from pyspark.sql import functions as F

from meteorium.llm import q_urls, url_filter

from .helpers import rows


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(rule), rule) for _, rule in q_urls.RULES for name, slash, tail in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith(slash + tail)]
    return host, path, max(fits)[1] if fits else None


URLS = [None, "", "no scheme/path", "http://", "http://COM/", "https://a.com", "https://a.com?x=/y", "https://a.com/#/z", "http://example.com/en/1", "http://www.EXAMPLE.com/en/2?q#f",
        "http://x.www.example.com/en/3", "http://notexample.com/en/4", "http://a.net/es/1", "http://a.net/es", "http://a.net/fr/\n2", "ftp://a.net/de/://b.net/fr/", "http://Ünet.NET/fr/a",
        "http://a.org/" + "s/" * 40, "http://net/es/"]


def test_rules_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("id", F.lit("x"))
    verdict = {rule: v for v, rule in q_urls.RULES}
    got = url_filter.judge(df, q_urls.RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule = brute((URLS * 2)[r["id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict[rule] if rule else r["verdict"] in ("allow", "block")


def test_query_on_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in q_urls.op8_url_filter(spark, folder).collect()}
    assert got == {i: brute(u) for i, u in pages.items()}


def test_segments(spark):
    path = spark.createDataFrame([("/a/12/b34.html",), ("/0123abcdef/x",), ("/" + "/".join("abcdefghijkl"),), ("",), ("/",)], "p string").select(url_filter.segments(F.col("p")))
    assert [r[0] for r in rows(path)] == [["a", "{n}", "b{n}.html"], ["{id}", "x"], [*"abcdefg", "h/i/j/k/l"], [""], [""]]


def tables(spark):
    """One host whose pages below /spam are blocked, and whose slugs below /spam and /blog differ for every page."""
    data = [("h", f"/spam/s{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", 1) for i in range(100)] + [("h", f"/blog/t{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", 0) for i in range(100)]
    data += [("h", "/spam/new", None), ("h", "/blog/new", None), ("h", "/other/new", None), ("g", "/spam/new", None)]
    return spark.createDataFrame(data, "host string, path string, label int")


def test_slugs_become_wildcards_and_keep_their_branch(spark):
    got = {(r["host"], "/".join(r["raw"])): ("/".join(r["kept"]), r["labelled"], r["purity"]) for r in url_filter.purities(url_filter.template_table(tables(spark))).collect()}
    assert got["h", "spam/new"] == ("spam/{*}", 100, (100 + 2 * 0.5) / 102)
    assert got["h", "blog/new"] == ("blog/{*}", 100, (0 + 2 * 0.5) / 102)
    assert got["h", "other/new"] == ("other/new", 0, None) and got["g", "spam/new"] == ("spam/new", 0, None)


def names(n):
    return ["n" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in range(n)]


def test_volume_does_not_switch_wildcards_off(spark):
    kept = lambda df: {(r["host"], *r["raw"]): tuple(r["kept"]) for r in url_filter.template_table(df).collect()}
    once = kept(tables(spark))
    assert once == kept(tables(spark).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))))
    shops = [("h", f"/shop/{name}/{page}", 1 if name != "nak" else None) for name in names(60) for page in ("about", "cart", "faq", "home", "items")]
    got = kept(spark.createDataFrame(shops, "host string, path string, label int"))
    assert got["h", "shop", "nak", "cart"][:2] == got["h", "shop", "nbk", "cart"][:2] == ("shop", "{*}")


def test_few_labelled_branches_do_not_speak_for_the_rest(spark):
    urls = [f"http://a.net/{branch}/x{k}" for branch in ["es", "fr", *names(30)] for k in "ab"]
    for repeats in (1, 4):
        df = spark.createDataFrame(list(enumerate(urls * repeats)), "page_id long, url string")
        got = {(r["path"].split("/")[1], r["verdict"]) for r in url_filter.judge(df, q_urls.RULES).collect()}
        assert got == {("es", "block"), ("fr", "block"), *((n, "allow") for n in names(30))}


def test_a_branch_that_differs_stays_out_of_the_wildcard(spark):
    data = [("h", f"/{name}/{k}", 0) for name in names(40) for k in "abcdefgh"] + [("h", f"/bad/{k}", 1) for k in "abcdefgh"] + [("h", "/new/a", None)]
    got = {r["raw"][0]: r["kept"][0] for r in url_filter.template_table(spark.createDataFrame(data, "host string, path string, label int")).collect()}
    assert got == {**{n: "{*}" for n in names(40)}, "bad": "bad", "new": "{*}"}


def test_repeated_rows_do_not_change_verdicts(spark):
    rules = [("block", "h.x/s/" + n) for n in names(12)] + [("allow", "h.x/s/" + n) for n in names(30)[12:]]
    urls = [f"http://h.x/s/{n}" for n in names(35)]
    said = [{(r["path"], r["template"], r["purity"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(u)), "page_id long, url string"), rules).collect()}
            for u in (urls, urls * 3, urls + urls[:12] * 9)]
    assert said[0] == said[1] == said[2]


def test_branches_that_look_alike_are_merged(spark):
    data = [("h", f"/{branch}/x", label) for branch, shares in {"a": (9, 1), "b": (8, 2), "c": (0, 40)}.items() for label, n in zip((1, 0), shares) for _ in range(n)]
    table = url_filter.template_table(spark.createDataFrame(data, "host string, path string, label int"))
    # a and b differ from the rest through c; a second look at a and b alone is not taken
    assert {r["raw"][0]: r["kept"][0] for r in table.collect()}["c"] == "c"
    even = [("h", f"/{branch}/x", label) for branch in "ab" for label in (1, 0) for _ in range(20)]
    table = url_filter.template_table(spark.createDataFrame(even, "host string, path string, label int"))
    assert {r["kept"][0] for r in table.collect()} == {"{~}"}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert rows(url_filter.judge(df, []).select("rule", "verdict")) == [(None, "allow")]
    assert url_filter.judge(df.limit(0), q_urls.RULES).count() == 0
