"""A branch is tested whatever its rank among its siblings."""

from trackmill.llm import url_filter as U


def test_small_bad_branch_among_many(spark):
    rows, labels = [], []
    for s in range(40):
        bad = s in (30, 38)
        # All sections are larger than the two bad ones.
        for i in range(8 if bad else 12):
            name = "".join(chr(97 + int(d)) for d in f"{s:02d}") + "zone"
            rows.append((len(rows), f"http://site.com/{name}/{1000 + i}", bad))
            labels.append((len(rows) - 1, int(not bad)))
    got = U.judge(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["verdict"] == "block") == rows[r["page_id"]][2], r
        assert (r["template"] == "/*/*") != rows[r["page_id"]][2], r


def test_many_single_pages_stay_a_wildcard(spark):
    rows = [(i, f"http://people.com/{a}{b}{a}/{a}{b}page") for i, (a, b) in enumerate((x, y) for x in "abcdefgh" for y in "ijklmnop")]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string"), None).collect()
    assert {(r["template"].split("/")[1], r["verdict"]) for r in got} == {("*", "allow")}
