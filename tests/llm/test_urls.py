"""URL filters, with awkward input."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare
from pyspark.sql import functions as F

from keyloom.llm import registry, url_filter
from keyloom.llm.registry import RULES
from keyloom.llm.url_filter import Reputation, Rule

SCHEMA = "page_id long, url string, html string, host string, path string, fit int, bad boolean, n int, domain string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None, "h", "p", 1, True, 2, "d") for i, u in rows], SCHEMA)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, good int")


URLS = [
    (1, "http://Example.COM/en/7x?q#f", "example.com", "/en/7x", "example.com/en/7", "allow"),
    (2, "https://a.example.com/en/", "a.example.com", "/en/", "com/en/", "block"),
    (3, "https://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
    (4, "https://b.example.net/de/7", "b.example.net", "/de/7", "net/de/", "allow"),
    (5, "x://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    (6, "ftp://org/es/", "org", "/es/", "org/es/", "block"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, "", "", "", None, "allow"),
    (10, "http://", "", "", None, "allow"),
    (11, "http://host?x=/a", "host", "", None, "allow"),
    (12, "http://host#/a://b", "host", "", None, "allow"),
    (13, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (14, "http://ÄB.Com/\n/x", "Äb.com", "/\n/x", None, "allow"),
    (15, "http://h/" + "p" * 100_000, "h", "/" + "p" * 100_000, None, "allow"),
    (15, "http://h/again", "h", "/again", None, "allow"),
    (None, "http://h/null", "h", "/null", None, "allow"),
]


def test_parts_and_rules(spark):
    got = url_filter.judge_urls(pages(spark, [u[:2] for u in URLS]), outcomes(spark, []), RULES).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r) for r in got), key=key) != []
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(
        ((u[0], *u[2:]) for u in URLS), key=key
    )


def test_no_pages(spark):
    assert url_filter.judge_urls(pages(spark, []), outcomes(spark, [(1, 0)]), RULES).count() == 0


def test_bad_hosts_go_and_few_labels_do_not(spark):
    rows, labels, n = [], [], 0
    for host, good, bad in (("bad.a.com", 0, 60), ("good.a.com", 60, 0), ("new.b.com", 0, 1), ("mixed.c.org", 30, 30)):
        for k in range(good + bad):
            rows.append((n, f"http://{host}/{k}"))
            labels.append((n, int(k < good)))
            n += 1
    rows += [(n + i, f"http://bad.a.com/more{i}") for i in range(200)] + [(n + 300, "http://unseen.org/")]
    labels += [(3, None), (None, 1)]
    got = url_filter.judge_urls(pages(spark, rows), outcomes(spark, labels), (), Reputation()).collect()
    verdict = {r.host: {x.verdict for x in got if x.host == r.host} for r in got}
    assert len(got) == len(rows)
    assert verdict["bad.a.com"] == {"block"}
    assert all(verdict[h] == {"allow"} for h in ("good.a.com", "new.b.com", "mixed.c.org", "unseen.org"))


def test_posterior_shrinks_to_its_domain(spark):
    rows = [("x.d.com", 0)] * 2 + [("y.d.com", 1)] * 50 + [("z.e.com", 0)] * 2 + [("w.e.com", 0)] * 50
    rows = spark.createDataFrame(rows, "host string, good int")
    known = {r.name: r.mean for r in url_filter.reputation(rows).collect() if r.level == "host"}
    assert known["x.d.com"] > known["z.e.com"] and known["y.d.com"] > 0.8


def test_hosts_without_labels_have_the_verdict_of_domain_or_suffix(spark):
    good = [(f"h{i}.good{i % 4}.com", 1) for i in range(200)] + [(f"h{i}.fine{i % 3}.co.uk", 1) for i in range(90)]
    bad = [(f"h{i % 3}.spam.com", 0) for i in range(120)] + [(f"b{i}.bad{i}.zz", 0) for i in range(300)]
    bad += [(f"h{i % 3}.spam.co.uk", 0) for i in range(90)]
    kept = [("ok.bad7.zz", 1)] * 40
    rows = [(n, f"http://{h}/", g) for n, (h, g) in enumerate(good + bad + kept)]
    unseen = ["new.spam.com", "new.good1.com", "new.other.com", "any.new.zz", "zz", "n.fine1.co.uk", "n.spam.co.uk", "n.new.co.uk", "x.org", ""]
    urls = [r[:2] for r in rows] + [(1000 + i, f"http://{h}/") for i, h in enumerate(unseen)]
    got = url_filter.judge_urls(pages(spark, urls), outcomes(spark, [(n, g) for n, _, g in rows])).collect()
    verdict = {r.host: r.verdict for r in got}
    assert {h: verdict[h] for h in unseen} == {
        "new.spam.com": "block", "new.good1.com": "allow", "new.other.com": "allow", "any.new.zz": "block", "zz": "block",
        "n.fine1.co.uk": "allow", "n.spam.co.uk": "block", "n.new.co.uk": "allow", "x.org": "allow", "": "allow",
    }
    assert verdict["ok.bad7.zz"] == "allow" and verdict["h1.spam.com"] == "block"


def test_reputation_at_every_level_equals_its_sql(spark, tmp_path):
    rows = [(f"h{i}.good{i % 4}.com", 1) for i in range(200)] + [(f"h{i}.fine{i % 3}.co.uk", 1) for i in range(90)]
    rows += [(f"h{i % 3}.spam.com", 0) for i in range(120)] + [(f"b{i}.bad{i}.zz", 0) for i in range(300)]
    rows += [(f"h{i % 3}.spam.co.uk", 0) for i in range(90)] + [("ok.bad7.zz", 1)] * 40 + [("", 0)] * 200
    rows += [("lone.fair.com", 0)] * 60 + [(f"f{i}.fair.com", 1) for i in range(60)]
    unseen = ["new.spam.com", "new.good1.com", "new.other.com", "any.new.zz", "zz", "n.spam.co.uk", "x.org", "f1.fair.com", ""]
    urls = [(n, f"http://{h}/" if h else "no host") for n, (h, _) in enumerate(rows)] + [(5000 + i, f"http://{h}/en/7" if h else None) for i, h in enumerate(unseen)]
    save = lambda name, **columns: pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    save("pages", page_id=[u[0] for u in urls], url=[u[1] for u in urls])
    labels = [(n, g if n % 50 else None, 0) for n, (_, g) in enumerate(rows)]
    save("labels", doc_id=[x[0] for x in labels], quality=[x[1] for x in labels])
    df = registry.op7_url_filter(spark, str(tmp_path))
    assert compare(df, registry.ORACLES["op7_url_filter"], str(tmp_path)) == len(urls)
    verdict = {(r.host, r.rule): r.verdict for r in df.collect()}
    assert verdict["lone.fair.com", None] == "block" and verdict["f1.fair.com", None] == "allow"  # a host against its domain
    assert verdict["h0.spam.com", None] == "block" and verdict["h0.good0.com", None] == "allow"  # a domain against its suffix
    assert verdict["any.new.zz", None] == "block" and verdict["x.org", None] == "allow" and verdict["", None] == "allow"


def test_suffix_and_domain(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("com", "x.com"), "com": ("com", "com"),
        "a.x.com": ("com", "x.com"), "": ("", ""), "b.co.example": ("example", "co.example"), "q.xco.uk": ("uk", "xco.uk"),
        "a..": ("", "."), "x.com.\n": ("\n", "com.\n"),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string")
    host = F.col("host")
    assert {r[0]: (r[1], r[2]) for r in rows.select(host, url_filter.suffix_of(host), url_filter.domain_of(host)).collect()} == want


def test_too_many_rules():
    with pytest.raises(ValueError):
        url_filter.matching_rule(None, None, [Rule("allow", "h", f"/{i}") for i in range(1001)])
