"""Several kinds of branches give several templates, at any depth; held-out labels show what a threshold rejects."""

from trackmill.llm import url_filter as U

LETTERS = "abcdefghijklmnop"


def test_two_kinds_of_branches_are_two_templates(spark):
    rows, labels = [], []
    for i, x in enumerate(LETTERS):
        for k in range(30):
            last = ("posts", "photos", "about") if i % 2 else ("cart", "offers", "stock")
            rows.append((len(rows), f"http://site.com/{x}{x}/{last[0] if k < 20 else last[k % 3]}/{1000 + k}"))
            labels.append((rows[-1][0], 1))
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    for r in got:
        i = LETTERS.index(r["path"][1])
        assert r["template"].startswith("/*(posts)/" if i % 2 else "/*(cart)/"), r
        assert r["verdict"] == "allow"


def test_a_bad_section_below_any_depth(spark):
    deep = "/a/b/c/d/e/f/g/h"
    rows = [(i, f"http://site.com{deep}/{'junk' if i % 2 else 'fine'}/{1000 + i}") for i in range(80)]
    labels = [(i, 1 - i % 2) for i in range(80)]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {(r["verdict"], r["template"]) for r in got} == {("block", f"{deep}/junk/*"), ("allow", f"{deep}/fine/*")}


def test_curve_and_long_urls(spark):
    rows = [(i, f"http://site.com/{'bad' if i % 4 == 0 else 'good'}/{1000 + i}") for i in range(400)] + [(900, "http://h.com/" + "x/" * 40 + "y" * 100_000), (900, "http://h.com/" + "x/" * 40 + "y" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    curve = {round(r["below"], 2): (r["pages"], r["good"]) for r in U.purity_curve(pages, labels).collect()}
    assert len(curve) == 20 and curve[0.5][0] > 0 and curve[0.5][1] == 0 and curve[1.0][1] > 0
    assert sum(r["page_id"] == 900 for r in U.judge(pages, labels).collect()) == 2
