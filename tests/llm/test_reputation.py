from pyspark.sql import functions as F

from grainflow.llm import reputation
from tests.llm.helpers import SF  # noqa: F401


def judged(spark, urls, outcomes=(), **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    bad = spark.createDataFrame(list(outcomes), "page long, bad long")
    return {r["page_id"]: tuple(r)[1:5] for r in reputation.judge(pages, bad, "page_id", "url", **more).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://M.Example.COM/en/72?x#y", "x://example.com/en/8", "x://badexample.com/en/7", "x://a.net/de/1", "x://example.net/de/81", "x://b.org/es/", "x://b.org/es", "x://c.com?q=/en/", None, "no scheme", "x://ÄÖ.com/EN/", "x://", "y://h:80/p?u=x://other/"]
    got = judged(spark, urls)
    assert [got[i] for i in range(len(urls))] == [
        ("m.example.com", "/en/72", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("badexample.com", "/en/7", "com/en/", "block"),
        ("a.net", "/de/1", "net/de/", "allow"), ("example.net", "/de/81", "example.net/de/8", "block"), ("b.org", "/es/", "org/es/", "block"),
        ("b.org", "/es", None, "allow"), ("c.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("ÄÖ.com", "/EN/", None, "allow"), ("", "", None, "allow"), ("h:80", "/p", None, "allow"),
    ]
    assert judged(spark, []) == {}


def test_bad_hosts_are_blocked_and_lend_to_their_domain(spark):
    urls = [f"x://spam.bad.xyz/{i}" for i in range(60)] + [f"x://www.good.xyz/{i}" for i in range(60)] + ["x://new.bad.xyz/", "x://new.good.xyz/"]
    got = judged(spark, urls, [(i, 1) for i in range(60)] + [(60 + i, int(i % 20 == 0)) for i in range(60)] + [(0, None), (1, 0), (999, 1)])
    assert got[0][3] == "block" and got[60][3] == "allow" and got[121][3] == "allow"
    means = {r["host"]: r["mean"] for r in reputation.reputations(spark.createDataFrame([("spam.bad.xyz", 60, 60), ("www.good.xyz", 60, 3), ("new.bad.xyz", 0, 0), ("new.good.xyz", 0, 0), ("one.good.xyz", 1, 1)], "host string, n long, bad long")).collect()}
    assert means["new.bad.xyz"] > means["new.good.xyz"] and means["spam.bad.xyz"] > means["new.bad.xyz"]
    assert means["one.good.xyz"] < 1


def test_registered_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("",), ("x.y.gov.uk:8080",), ("me@10.0.0.4:80",), ("[::1]:80",), ("a.b.com.",), ("org.uk",), ("co.b.info",)], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in reputation.with_suffix(hosts, None).collect()}
    assert got == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "a.b.com": ("com", "b.com"), "com": ("com", "com"), "": ("", ""), "x.y.gov.uk:8080": ("gov.uk", "y.gov.uk"),
        "me@10.0.0.4:80": ("address", "10.0.0.4"), "[::1]:80": ("address", "[::1]"), "a.b.com.": ("com", "b.com"), "org.uk": ("org.uk", "org.uk"), "co.b.info": ("info", "b.info"),
    }


def test_suffixes_from_a_table(spark, tmp_path):
    (tmp_path / "list").write_text("// a comment\ncom\nuk\nco.uk\ngithub.io\n*.ck\n!www.ck\n\n")
    table = reputation.read_suffixes(spark, str(tmp_path / "list"))
    hosts = spark.createDataFrame([("a.b.co.uk",), ("me.github.io",), ("x.y.z.ck",), ("a.www.ck",), ("q.unknown",), ("1.2.3.4",), ("",)], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in reputation.with_suffix(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "me.github.io": ("github.io", "me.github.io"), "x.y.z.ck": ("z.ck", "y.z.ck"), "a.www.ck": ("ck", "www.ck"), "q.unknown": ("unknown", "q.unknown"), "1.2.3.4": ("address", "1.2.3.4"), "": ("", "")}


def test_limit_follows_the_whole_rate(spark):
    """With half of all outcomes bad, only hosts worse than that beyond doubt are blocked; hosts alike are all allowed."""
    urls = [f"x://h{i % 40}.xyz/{i}" for i in range(1600)]
    alike = judged(spark, urls, [(i, int((i * 7919) % 1601 < 640)) for i in range(1600)])
    assert {v[3] for v in alike.values()} == {"allow"}
    differ = judged(spark, urls, [(i, int((i * 7919) % 1601 < (1500 if i % 40 < 4 else 500))) for i in range(1600)])
    assert all((v[3] == "block") == (i % 40 < 4) for i, v in differ.items())


def test_null_keys_and_repeated_pages(spark):
    pages = spark.createDataFrame([(None, "x://a.b/1"), (None, "x://a.b/2"), (1, "x://a.b/3"), (1, "x://a.b/3")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (None, 1)], "page long, bad long")
    got = reputation.judge(pages, outcomes, "page_id", "url").collect()
    assert len(got) == 4 and {r["host"] for r in got} == {"a.b"}
    assert reputation.judge(pages, outcomes.limit(0), "page_id", "url").where("verdict = 'allow'").count() == 4


def test_hosts_of_the_standard_tables(spark):
    """The hosts of the standard pages are alike: every host's bound is below the limit, and none is blocked but by rule. A host made bad is."""
    got = reputation.query(spark, "/root/testdata/sf0.01")
    assert got.where("rule is null and verdict = 'block'").count() == 0 and got.where("bound > limit").count() == 0
    assert got.where("rule is null and verdict = 'allow'").count() > 0
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = got.where("rule is null").groupBy("host").count().orderBy(F.desc("count"), "host").first()["host"]
    outcomes = pages.select(F.col("page_id").alias("page"), F.when(reputation.host_of(F.col("url")) == host, 1).otherwise((F.col("page_id") % 5 == 0).cast("int")).cast("long").alias("bad"))
    again = reputation.judge(pages, outcomes, "page_id", "url").where("rule is null").groupBy("host", "verdict").count().collect()
    assert [r["host"] for r in again if r["verdict"] == "block"] == [host]
