"""Hosts, paths and rules against plain Python; templates and verdicts on planted hosts."""

from trackmill.llm import url_filter as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end].translate(LOWER), rest[end:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:end]


def plain_rule(host, path):
    best = None
    for rule, verdict in U.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and (not start or path.startswith("/" + start)) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://A.Example.NET/en/1?q#f", "https://example.net/en", "https://example.net/EN/", "http://x.net", "http://notnet/", "http://net/en/", "http://a.example.com/de/x", "http://a.example.com/de",
    "http://example.com/fr?x=/de/", "http://b.org/fr/1", "http://b.org/fr", "http://org#/fr/", "http://h?://y/z", "http://ÀB.org/fr/é\n/x", "http://h.org//fr/", "http://a.com/x/y/z/1/2/3/4/5/6/7", "http://u:p@h.com:80/p",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[5], "x", "y"), (None, URLS[5], "x", "y")], "page_id long, url string, host string, rule string")
    got = U.judge(pages, None).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[5] if r["page_id"] is None or (r["page_id"] == 0 and r["host"]) else URLS[r["page_id"]]
        assert (r["host"], r["path"]) == plain(url)
        rule, verdict = plain_rule(*plain(url))
        assert (r["rule"], r["verdict"]) == (rule, verdict or "allow")


def test_templates_learn_from_labels(spark):
    rows, labels = [], []
    for i in range(400):
        section = ("spam", "news", "blog", "shop")[i % 4]
        rows.append((i, f"http://site.com/{section}/{1000 + i}/item-{i}.html"))
        if i % 3:
            labels.append((i, int(section != "spam")))
    rows += [(1000 + i, f"http://other.com/{i}") for i in range(50)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, quality int")).collect()
    for r in got:
        if r["page_id"] < 1000:
            assert (r["verdict"] == "block") == ("/spam/" in r["path"]), r
            assert r["template"] == ("/spam/*/*" if "/spam/" in r["path"] else "/*/*/*"), r
        else:
            assert (r["verdict"], r["template"]) == ("allow", "/*")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
