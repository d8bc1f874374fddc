import itertools
import random

from opinara.llm import queries, urls


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_equals_brute_force(spark):
    rng = random.Random(4)
    hosts = ["net", "Example.NET", "a.example.net", "xexample.net", "example.com", "b.a.org", "org", "", "net:80", "deep.a.b.c.example.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/de/a/b/c", "/fr/", "//en/", "/en/x?y=/fr/", "#/en/", "?q", "/de/ü/"]
    found = [f"{s}{h}{p}" for s, h, p in itertools.product(["http://", "x://a://", "", "mailto:"], hosts, paths)] + [None, "", "://", "http://"]
    rules = list(queries.URL_RULES)
    for _ in range(30):
        rules.append((rng.choice(["a.org", "b.a.org", "example.net", "c.example.com", "net", "org"]), rng.choice(["/", "/e", "/en/x", "/de/a/b", "", "/fr/"]), rng.choice(["block", "allow"])))
    for some in (list(queries.URL_RULES), rules, []):
        table = spark.createDataFrame(some, "host string, path string, verdict string")
        rows = urls.judge_urls(spark.createDataFrame([(u,) for u in found], "url string"), table).collect()
        assert {(r.url, *r[1:]) for r in rows} == {(u, *judged(u, some)) for u in found}
        assert len(rows) == len(found)


def test_edges(spark, edge_docs):
    rules = spark.createDataFrame([("net", None, "block"), (None, "/", "block"), ("org", "/", None)], "host string, path string, verdict string")
    pages = edge_docs.withColumnRenamed("text", "url")
    assert [r.verdict for r in urls.judge_urls(pages, rules).collect()] == ["allow"] * 8
    net = spark.createDataFrame([("http://x.net",), ("http://x.net",), ("http://" + "a." * 3000 + "net/" + "b/" * 3000,)], "url string")
    assert [r.verdict for r in urls.judge_urls(net, rules).collect()] == ["block"] * 3
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert set(urls.judge_urls(pages, rules).columns) == set(pages.columns)
