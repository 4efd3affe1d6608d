from grainflow.llm import boilerplate
from tests.llm.helpers import documents


def clean(spark, rows, **more):
    df = documents(spark, rows).withColumnRenamed("lang", "n_dropped")
    out = boilerplate.drop_lines(df, "source", "text", **more)
    assert out.columns == [*df.columns, "n_lines", "n_dropped_"]
    return {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped_"]) for r in out.collect()}


def test_only_frequent_lines_of_the_own_host_go(spark):
    rows = [(i, f"body {i}\n Menu \n\nend {i}", "en", "a") for i in range(20)] + [(100 + i, f"other {i}" + ("\nMenu" if i < 2 else ""), "en", "b") for i in range(40)]
    got = clean(spark, rows, ratio=0.1, min_pages=3)
    assert (3, "body 3\n\nend 3", 4, 1) in got
    assert (100, "other 0\nMenu", 2, 0) in got and len(got) == 60


def test_copies_of_a_page_count_once(spark):
    rows = [(i, "same\npage", "en", "a") for i in range(30)] + [(50 + i, f"page {i}", "en", "a") for i in range(5)]
    assert (0, "same\npage", 2, 0) in clean(spark, rows, ratio=0.3, min_pages=2)


def test_nulls_empty_long_and_null_host(spark):
    long_ = "\n".join(["top"] + [f"x{i}" for i in range(30_000)])
    rows = [(1, None, "en", "a"), (2, "", "en", None), (None, "top\nz", "en", None), (4, "top\ny", "en", None), (5, long_, "en", None), (5, long_, "en", None)]
    got = clean(spark, rows, ratio=0.5, min_pages=3)
    assert {(1, None, 0, 0), (2, "", 1, 0), (None, "z", 2, 1), (4, "y", 2, 1)} <= got
    assert any(r[0] == 5 and r[2:] == (30_001, 1) for r in got)
    assert clean(spark, []) == set()


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [(i, f"body {i}\nMenu", "en", "a" if i % 3 else None) for i in range(40)]
    first = clean(spark, rows)
    monkeypatch.setattr(boilerplate, "BROADCAST_BYTES", -1)
    assert clean(spark, rows) == first and any(r[3] for r in first)


def test_no_python_on_the_main_path(spark):
    plan = boilerplate.drop_lines(documents(spark, [(1, "a", "en", "s")]), "source", "text")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_hosts_of_pages_equal_brute_force(spark):
    """On real hosts: a line goes if it is on enough of the host's different pages."""
    from pyspark.sql import functions as F

    from grainflow.llm.reputation import host_of
    from tests.llm.helpers import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), F.regexp_replace("html", ">", ">\n").alias("text"))
    pages = pages.unionByName(pages.withColumn("text", F.concat(F.lit("top\n"), "text")))
    given = pages.collect()
    texts = {}
    for r in given:
        texts.setdefault(r["host"], set()).add(r["text"])
    gone = {}
    for host, own in texts.items():
        count = {}
        for t in own:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        gone[host] = {x for x, n in count.items() if n >= 5 and n > 0.5 * len(own)}
    assert sum(map(len, gone.values())) > 20
    want = sorted((r["page_id"], "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in gone[r["host"]])) for r in given)
    got = boilerplate.drop_lines(pages, "host", "text", ratio=0.5, min_pages=5).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == want and any(r["n_dropped"] for r in got)


def test_small_hosts_have_the_same_rule(spark):
    """A host of three pages: what stands on two of them goes, a page's own lines stay, as they do on a host of one page."""
    rows = [(1, "menu\none", "en", "a"), (2, "menu\ntwo", "en", "a"), (3, "three", "en", "a"), (4, "menu\nalone", "en", "b")]
    assert clean(spark, rows) == {(1, "one", 2, 1), (2, "two", 2, 1), (3, "three", 1, 0), (4, "menu\nalone", 2, 0)}
