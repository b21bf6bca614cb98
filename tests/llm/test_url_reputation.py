import pytest
from pyspark.sql import functions as F

from tabloom.llm import url_reputation as ur


def judged(spark, urls, outcomes):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, verdict string, good string")
    labels = spark.createDataFrame(outcomes, "url string, good boolean")
    return {r["page_id"]: r for r in ur.judge_urls(pages, labels).collect()}


def test_rules_hosts_and_paths(spark):
    urls = [
        "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/", "http://example.com/EN/", "http://x.net/es/1", "http://x.net/esx",
        None, "no scheme", "a://b://c/d", "http://notexample.com", "http://h.org?q", "http://com",
    ]
    got = judged(spark, urls, [])
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 5, 6, 7, 9)] == [
        ("www.example.com", "/en/1"), ("", ""), ("", ""), ("b:", "//c/d"), ("h.org", "")]
    assert [got[i]["rule"] for i in range(11)] == [
        "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, "com/", None, "com/"]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 5)] == ["allow", "block", "allow", "block", "allow", "allow"]


def test_a_host_goes_only_on_evidence(spark):
    bad, good = [("http://bad.org/1", False)] * 40, [("http://good.org/1", True)] * 40
    few, null = [("http://few.org/1", False)], [("http://null.org/1", None)] * 9
    urls = ["http://bad.org/x", "http://good.org/x", "http://few.org/x", "http://null.org/x", "http://new.org/x"]
    got = judged(spark, urls, bad + good + few + null)
    assert [got[i]["verdict"] for i in range(5)] == ["block", "allow", "allow", "allow", "allow"]


def test_shrinking_takes_the_level_above(spark):
    rows = [(f"http://h{i}.spam.org/", False) for i in range(30) for _ in range(3)] + [("http://new.spam.org/", True)]
    rows += [(f"http://h{i}.fine.org/", True) for i in range(30) for _ in range(3)]
    table = spark.createDataFrame(rows, "url string, good boolean")
    hosts, _ = ur.reputations(table.select(ur.host_of(table.url).alias("host"), "good"))
    found = {r["host"]: r for r in hosts.collect()}
    mean = {h: r["alpha"] / (r["alpha"] + r["beta"]) for h, r in found.items()}
    assert found["h1.spam.org"]["above"] < 0.2 < 0.8 < found["h1.fine.org"]["above"]
    assert found["new.spam.org"]["above"] < found["h1.spam.org"]["above"]
    assert mean["h1.spam.org"] < mean["new.spam.org"] < 0.6


def test_a_host_without_labels_is_judged_by_the_levels_above(spark):
    outcomes = [(f"http://h{i}.spam.org/", False) for i in range(30) for _ in range(20)]
    outcomes += [(f"http://h{i}.d{j}.org/", True) for i in range(5) for j in range(20) for _ in range(20)]
    outcomes += [(f"http://h{i}.d{j}.bad/", False) for i in range(5) for j in range(20) for _ in range(20)]
    urls = ["http://new.spam.org/x", "http://new.d1.org/x", "http://h1.spam.org/x", "http://a.new.org/x", "http://a.new.bad/x",
            "http://a.new.other/x", None]
    got = judged(spark, urls, outcomes)
    assert [got[i]["verdict"] for i in range(7)] == ["block", "allow", "block", "allow", "block", "allow", "allow"]
    table = spark.createDataFrame(outcomes, "url string, good boolean").select(ur.host_of(F.col("url")).alias("host"), "good")
    asked = spark.createDataFrame([("new.spam.org",), ("h1.spam.org",)], "host string")
    alone, before = ur.reputations(table)
    wide, after = ur.reputations(table, asked=asked)
    assert after.mean == before.mean and (after.suffix, after.domain, after.host) == pytest.approx((before.suffix, before.domain, before.host))
    new = wide.where("host = 'new.spam.org'").first()
    assert wide.count() == alone.count() + 1 and (new["n"], new["g"]) == (0, 0)
    assert new["alpha"] / (new["alpha"] + new["beta"]) == pytest.approx(new["above"]) and new["above"] < 0.1


@pytest.mark.parametrize("excess, trials, want", [(None, None, 2.0), (-5.0, 100, 1000.0), (50.0, 100, 1.0), (10.0, 110, 10.0)])
def test_strength(excess, trials, want):
    assert ur.strength_of(excess, trials) == pytest.approx(want)


def levels_of(spark, hosts, rules=ur.TWO_LABEL_SUFFIXES):
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    found = table.select("host", ur.domain_of(F.col("host"), rules).alias("d"), ur.suffix_of(F.col("host"), rules).alias("s")).collect()
    return {r["host"]: (r["d"], r["s"]) for r in found}


def test_addresses_ports_and_suffix_rules(spark):
    got = levels_of(spark, ["10.0.0.1", "99.7.0.1:8080", "a.com:80", "x.y.co.uk", "co.uk", "com", "", "[::1]:80"])
    assert got == {
        "10.0.0.1": ("10.0.0.1", ur.ADDRESSES), "99.7.0.1:8080": ("99.7.0.1", ur.ADDRESSES), "a.com:80": ("a.com", "com"),
        "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "": ("", ""), "[::1]:80": ("[::1]", ur.ADDRESSES),
    }
    rules = ("com", "*.ck", "!www.ck", "a.b.jp", "gov.au")
    got = levels_of(spark, ["x.y.z.ck", "www.ck", "q.www.ck", "s.a.b.jp", "t.s.a.b.jp", "m.n.gov.au", "k.jp"], rules)
    assert got == {
        "x.y.z.ck": ("y.z.ck", "z.ck"), "www.ck": ("www.ck", "ck"), "q.www.ck": ("www.ck", "ck"), "s.a.b.jp": ("s.a.b.jp", "a.b.jp"),
        "t.s.a.b.jp": ("s.a.b.jp", "a.b.jp"), "m.n.gov.au": ("n.gov.au", "gov.au"), "k.jp": ("k.jp", "jp"),
    }


def test_a_better_record_never_ranks_lower(spark):
    rows = [(f"http://h{g}.d.org/", i < g) for g in range(11) for i in range(10)]
    rows += [(f"http://x{i}.e{j}.org/", (i + j) % 3 > 0) for i in range(4) for j in range(6) for _ in range(5)]
    table = spark.createDataFrame(rows, "url string, good boolean").select(ur.host_of(F.col("url")).alias("host"), "good")
    found = {r["host"]: r["alpha"] / (r["alpha"] + r["beta"]) for r in ur.reputations(table)[0].collect()}
    ranked = [found[f"h{g}.d.org"] for g in range(11)]
    assert ranked == sorted(ranked) and len(set(ranked)) == 11
