import random

from pyspark.sql import types as T

from wattframe.llm import urls as U
from wattframe.tables import local_table

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("verdict", T.StringType())])


def pages(spark, urls):
    return local_table(spark, [(i, u, "h", "v") for i, u in enumerate(urls)], PAGES)


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
        path = rest[cut:end]
    fits = [r for r in rules if (host == r[0] or host.endswith(f".{r[0]}")) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def addresses():
    rng = random.Random(7)
    hosts = ["com", "example.com", "WWW.Example.com", "a.b.example.com", "notexample.com", "x.net", "net", "net.", "example.com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/english", "/es/x?q=/en/", "/fr/#/en/", "//en/", "?/en/", "/en%2F", "#x"]
    out = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths]
    return [*out, None, "", "example.com/en/", "x://y://z/en/", "http://example.com/en/" + "d/" * 500, *rng.choices(out, k=20)]


def check(spark, rules, **more):
    urls = addresses()
    df = U.filtered(pages(spark, urls), spark.createDataFrame(rules, U.RULE_SCHEMA), **more)
    found = {r.page_id: tuple(r)[1:] for r in df.collect()}
    assert found == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_rules_of_the_query(spark):
    check(spark, U.RULES)


def test_rules_that_end_inside_a_word_and_many_rules(spark):
    rules = [*U.RULES, ("example.com", "/engl", "block"), ("com", "", "block"), ("b.example.com", "/en/a", "allow"), ("com", "/", "block")]
    check(spark, rules)
    check(spark, rules, broadcast_rules=2)


def test_edge_cases(spark):
    none = spark.createDataFrame([], U.RULE_SCHEMA)
    assert [r.verdict for r in U.filtered(pages(spark, ["http://a.com/"]), none).collect()] == ["allow"]
    assert U.filtered(pages(spark, []), none).collect() == []
    same = local_table(spark, [(1, "http://a.com/", "", ""), (1, "http://a.com/", "", ""), (None, None, "", "")], PAGES)
    rows = U.filtered(same, spark.createDataFrame(U.RULES, U.RULE_SCHEMA)).collect()
    assert sorted((str(r.page_id), r.rule) for r in rows if r.rule) == [("1", "com/")] * 2 and len(rows) == 3


def test_a_url_of_a_megabyte(spark):
    urls = ["http://" + "a." * 200_000 + "example.com/en/" + "d/" * 400_000, "http://x.net/" + "/" * 900_000]
    rows = U.filtered(pages(spark, urls), local_table(spark, U.RULES, U.RULE_SCHEMA)).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [("example.com/en/", "block"), (None, "allow")]
