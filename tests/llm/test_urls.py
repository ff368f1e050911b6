from pyspark.sql import functions as F

from terragrain.llm import common, urls

ROWS = [
    (1, "http://WWW.Example.com/en/1?x#y"), (2, "https://a.example.com/en/"), (3, "https://example.com"), (4, "x://net/es/"), (5, "://a.net/fr/é?q=1&r=2"),
    (6, None), (7, ""), (8, "no scheme/en/"), (9, "http://xexample.com/en/1"), (10, "http://a.org?x=/net/es/"), (11, "http://b://c/d"), (12, "http://" + "a" * 50_000 + ".net/es/x"),
    (13, "http://É.NET/es/\nline"), (13, "http://É.NET/es/\nline"), (None, "http://user:pw@h.com:80/p"), (14, "http://spam.org/1"),
]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def check(got, rows):
    wanted = sorted([(i, *host_path(u), rule_of(*host_path(u))[0]) for i, u in rows], key=repr)
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=repr) == wanted
    for r in got:
        assert r.verdict == (rule_of(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block")


def test_awkward_rows(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS rule", "1 AS label", "1 AS features")
    check(urls.judge_urls(df).collect(), ROWS)


def test_generated_urls(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    got = urls.judge_urls(df).collect()
    check(got, [tuple(r) for r in df.collect()])
    assert sorted(got) == sorted(urls.judge_urls(df).collect())
    assert all(0 <= r.block_score <= 1 for r in got if r.rule is None)


def test_the_trees_learn_what_rules_label(spark):
    rules = (("block", "org", "/a/"), ("allow", "org", "/b/"))
    rows = [(k, f"http://h{k % 7}.org/a/{k * 7919}/{k}?a={k}&b=1") for k in range(80)] + [(100 + k, f"http://h{k % 7}.org/b/about-page-{'abc'[k % 3]}") for k in range(80)]
    rows += [(300, "http://h3.org/c/99817/12?a=5&b=1"), (301, "http://h3.org/c/about-page-b")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert (got[300], got[301]) == ("block", "allow")


def labelled_pages(spark):
    rules = (("block", "org", "/a/"), ("allow", "org", "/b/"))
    rows = [(k, f"http://h{k % 7}.site{k % 20}.org/a/{k * 7919}/{k}?a={k}&b=1") for k in range(600)] + [(1000 + k, f"http://h{k % 7}.site{k % 20}.org/b/about-page-{k}") for k in range(600)]
    return spark.createDataFrame(rows, "page_id long, url string"), rules


def test_held_out_quality(spark):
    r = urls.held_out_quality(*labelled_pages(spark)).first()
    assert r.urls > 150 and r.agree / r.urls > 0.95


def test_a_label_says_nothing_about_its_own_feature(spark):
    pages, rules = labelled_pages(spark)
    featured = urls.materialise(urls.featured_urls(pages, rules), "urls")
    rows = urls.with_suffix_statistics(featured, F.lit(True)).select("suffix", "fold", "label", "suffix_blocked").collect()
    by_fold = {}
    for r in rows:
        by_fold.setdefault((r.suffix, r.fold), set()).add(r.suffix_blocked)
        others = [o.label for o in rows if o.suffix == r.suffix and o.fold != r.fold]
        assert abs(r.suffix_blocked - (sum(others) + urls.PRIOR * 0.5) / (len(others) + urls.PRIOR)) < 1e-9
    assert all(len(v) == 1 for v in by_fold.values())


def test_frequent_suffixes_in_parts(spark, monkeypatch):
    pages, rules = labelled_pages(spark)
    whole = sorted(urls.judge_urls(pages, rules).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted(urls.judge_urls(pages, rules).collect()) == whole


def test_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge_urls(df).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0)).count() == 0
