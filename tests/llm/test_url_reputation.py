from pyspark.sql import functions as F

from piisieve.llm.url_reputation import ReputationSettings, UrlRule, domain_and_suffix, host_and_path, judge_urls

RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
         UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[end:]
    return host, path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]


URLS = ["http://A.Example.NET/en/x?q=/a#b", "https://example.net/de/", "ftp://x.net", "http://x.net?y", "http://notexample.net/en/",
        "http://a.example.com/de/1", "http://example.com/de", "http://org/fr/", "http://É.org/fr/é?://z", None, "", "no scheme/en/",
        "://", "http://u:p@host.net:80/a#c", "http://a.co.uk/", "http://10.0.0.1/x", "a://b://c/d", "http://x.net\n/en/"]


def pages(spark, urls=URLS):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark):
    df = pages(spark).withColumns({"host": F.lit("x"), "bad": F.lit(1), "rule": F.lit("r"), "n": F.lit(1), "suffix": F.lit("s")})
    got = {r.page_id: r for r in judge_urls(df, labels(spark), RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path) == (host, path), url
        assert got[i].rule == (best.name if best else None), url
        assert got[i].verdict == (best.verdict if best else "allow"), url


def test_learned_verdicts_shrink(spark):
    urls, truth = [], []
    for i in range(400):
        kind = i % 4
        host = ["spam.bad.com", "fine.good.com", f"h{i}.bad.com", f"h{i}.good.com"][kind]
        urls.append(f"http://{host}/")
        truth.append((i, 0 if kind == 0 or kind == 2 and i % 8 else 1, 0))
    few = [*urls, "http://once.good.com/", "http://never.bad.com/"]
    found = judge_urls(pages(spark, few), labels(spark, [*truth, (400, 0, 0), (400, 1, 0), (None, 0, 0), (7, None, None)]), [])
    got = {r.host: r for r in found.collect()}
    assert got["spam.bad.com"].verdict == "block" and got["fine.good.com"].verdict == "allow"
    assert got["once.good.com"].verdict == "allow"  # one bad outcome against a clean domain
    assert got["never.bad.com"].bad_rate > got["fine.good.com"].bad_rate
    assert all(0 <= r.bad_rate <= 1 and r.bad_bound <= r.bad_rate for r in got.values())


def test_no_rows_and_no_outcomes(spark):
    assert judge_urls(pages(spark, []), labels(spark), RULES).collect() == []
    found = judge_urls(pages(spark, ["http://a.com/"]), labels(spark), [], ReputationSettings()).collect()
    assert [r.verdict for r in found] == ["allow"] and abs(found[0].bad_rate - 0.5) < 1e-9


def test_domains(spark):
    df = spark.createDataFrame([(h,) for h in ["a.b.co.uk", "b.com:8080", "u@x.y.org", "com", "10.0.0.1", ""]], "host string")
    domain, suffix = domain_and_suffix(F.col("host"))
    got = {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.com:8080": ("b.com", "com"), "u@x.y.org": ("y.org", "org"),
                   "com": ("com", "com"), "10.0.0.1": ("10.0.0.1", "address"), "": ("", "")}


def test_url_columns_of_every_character(spark):
    df = spark.createDataFrame([("http://" + chr(c) + "x/",) for c in [*range(1, 128), 0xE9, 0x130]], "url string")
    host, path = host_and_path(F.col("url"))
    for r in df.select("url", host.alias("host"), path.alias("path")).collect():
        assert (r.host, r.path) == parts(r.url)


def test_public_suffixes(spark, tmp_path):
    from piisieve.llm.url_reputation import read_suffixes

    want = {"a.b.com.sg": ("b.com.sg", "com.sg"), "u1.github.io": ("u1.github.io", "github.io"), "x.u2.github.io": ("u2.github.io", "github.io"),
            "a.b.c.ck": ("b.c.ck", "c.ck"), "a.www.ck": ("www.ck", "ck"), "ck": ("ck", "ck"), "com.sg": ("com.sg", "com.sg"), "a.b.com": ("b.com", "com"),
            "x.y.z.kawasaki.jp": ("y.z.kawasaki.jp", "z.kawasaki.jp"), "x.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp"),
            "10.0.0.1:80": ("10.0.0.1", "address"), "me@a.co.uk:1": ("a.co.uk", "co.uk"), "": ("", ""), "xcom.sg": ("xcom.sg", "sg")}
    domain, suffix = domain_and_suffix(F.col("h"))
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r.h: (r.d, r.s) for r in df.select("h", domain.alias("d"), suffix.alias("s")).collect()} == want
    (tmp_path / "list.dat").write_text("// comment\ncom\n\n*.Foo.bar\nco.xx  x\n!a.foo.bar\n")
    assert read_suffixes(spark, str(tmp_path / "list.dat")) == ("!a.foo.bar", "*.foo.bar", "co.xx")
    alone = domain_and_suffix(F.col("h"), ("co.xx",))
    assert tuple(spark.createDataFrame([("a.b.com.sg",)], "h string").select(*alone).first()) == ("com.sg", "sg")


def test_strangers_under_a_shared_suffix_do_not_judge_each_other(spark):
    urls = [f"http://bad{i}.github.io/{j}" for i in range(5) for j in range(40)] + ["http://clean.github.io/"]
    found = judge_urls(pages(spark, urls), labels(spark, [(i, 0, 0) for i in range(200)]), []).collect()
    assert all(r.verdict == "block" for r in found if r.page_id < 200)
    domains = domain_and_suffix(F.col("host"))[0]
    hosts = spark.createDataFrame([("bad1.github.io",), ("clean.github.io",)], "host string").select(domains.alias("d")).collect()
    assert len({r.d for r in hosts}) == 2
