from loomgraph.llm import urls


def judged(spark, rows, outcomes=()):
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    known = spark.createDataFrame(list(outcomes), "host string, bad int")
    return {r["id"]: r for r in urls.judge(pages, known).collect()}


def test_hosts_paths_rules(spark):
    rows = [
        "http://A.Example.ORG/es/x?y#z", "https://x.org", "ftp://x.org/?q", "http://fr.com/fr/1", "http://notorg/", "http://a.com/de/?x", None, "no scheme", "http://example.org/en/12",
        "http://É.COM/De/", "x://y://z/a", "http://example.org.evil/es/", "", "http://#f",
    ]
    got = judged(spark, rows)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(rows))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("x.org", "", None, "allow"), ("x.org", "/", "org/", "allow"), ("fr.com", "/fr/1", "com/fr/", "allow"),
        ("notorg", "/", None, "allow"), ("a.com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("É.com", "/De/", None, "allow"), ("y:", "//z/a", None, "allow"), ("example.org.evil", "/es/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]


def test_reputation_shrinks(spark):
    rows = [("good.a.net", 0)] * 200 + [("bad.b.net", 1)] * 60 + [("bad.b.net", 0)] * 20 + [("once.a.net", 1)] + [("new.b.net", None)]
    r = {x["host"]: x for x in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert r["bad.b.net"]["blocked"] and not r["good.a.net"]["blocked"]
    assert r["once.a.net"]["rate"] < 0.6  # one bad page of a good domain
    assert r["new.b.net"]["rate"] > r["once.a.net"]["rate"] - 0.3 and r["new.b.net"]["n"] == 0
    assert urls.reputation(spark.createDataFrame([], "host string, bad int")).count() == 0


def test_hot_host_and_unknown(spark):
    rows = ["http://hot.net/x"] * 500 + ["http://cold.net/"]
    got = judged(spark, rows, [("hot.net", 1)] * 50 + [("ok.net", 0)] * 500)
    assert len(got) == 501 and got[0]["verdict"] == "block" and got[500]["verdict"] == "allow"


def test_suffixes_and_domains(spark):
    rows = {
        "a.bbc.co.uk": ("co.uk", "bbc.co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1",) * 2, "10.0.0.1:80": ("10.0.0.1:80",) * 2,
        "x.example.com": ("com", "example.com"), "example.com:8080": ("com", "example.com"), "localhost": ("localhost",) * 2, "": ("", ""), "me.github.io": ("github.io", "me.github.io"),
    }
    df = spark.createDataFrame([(h,) for h in rows], "host string")
    got = {r["host"]: (r["s"], r["d"]) for r in df.select("host", urls.suffix_of(df.host).alias("s"), urls.domain_of(df.host).alias("d")).collect()}
    assert got == rows


def test_a_hot_host_by_either_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7 if i % 3 else 0}.net/{i}", "x") for i in range(3000)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    outcomes = pages.selectExpr("coalesce(regexp_extract(url, '://([^/]*)', 1), '') AS host", "page_id % 2 AS bad")
    want = sorted(map(str, urls.judge(pages, outcomes).collect()))
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    assert sorted(map(str, urls.judge(pages, outcomes).collect())) == want and len(want) == 3001
