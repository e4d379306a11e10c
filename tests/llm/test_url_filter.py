import sys, os  # noqa: E401

sys.path.insert(0, os.path.dirname(__file__))

import re  # noqa: E402

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lakeprofile.llm import url_filter  # noqa: E402

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("sub.net", "/", "block"), ("net", "/abcdefghij", "allow"), ("", "/", "block"), (None, "/", "block"), ("two.net", "/x", "allow"), ("two.net", "/x", "block"),
         ("ab.xy", "/c", "allow"), ("xy", "/cab", "block"), ("bare.io", None, "block")]
URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/123?q#f", "http://notexample.org/es/1", "http://org", "http://org/",
    "http://x.com/fr/", "http://x.com/de", "http://x.com/de/", "x://y://com/de/", "http://sub.net/abcdefghij", "http://a.sub.net/abcdefghijk", "http://two.net/xyz",
    "http://q.ab.xy/cab", "http://bare.io", "http://c.bare.io?x", "http://www.Listed.net:80/p/?b=2&utm_source=z&a=1#top", "https://listed.net/p?a=1&b=2",
    "http://listed.net/p?a=2&b=1", "http://listed.net/P?a=1&b=2", "http://É.net/é", "http://x.net/" + "y" * 100_000, "http://" + "a." * 20_000 + "org/q",
]
LISTED = ["http://listed.net/p/?a=1&b=2", None, "nothing", "http://x.org/listed", "http://É.net/é#x"]


def brute_canonical(url):
    m = re.search(r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "", re.S)
    if not m or not m[1]:
        return None
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", lower(m[1])))
    kept = sorted(p for p in (m[3] or "").split("&") if p and not re.search(url_filter.TRACKING, p))
    return host + m[2].rstrip("/") + ("?" + "&".join(kept) if kept else "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(url, rules, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p or ""), len(h), v, h + (p or "")) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    if fits:
        best = max(fits)
        return host, path, best[3], best[2]
    return host, path, None, "block" if brute_canonical(url) in {brute_canonical(u) for u in listed} - {None} else "allow"


def tables(spark, urls, rules=RULES, listed=LISTED):
    pages = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in urls], "page_id long, url string, key string, host string, rule string")
    return (pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in listed], "url string"))


@pytest.mark.parametrize("settings", [{}, {"max_blocks": 1}, {"hot_share": 2}])
def test_same_verdicts_as_brute_force(spark, settings):
    # Of one block nearly everything passes; the join removes it again.
    rows = list(enumerate(URLS)) + [(0, URLS[4]), (0, URLS[4]), (None, URLS[5])]
    got = url_filter.url_verdicts(*tables(spark, rows), **settings).collect()
    assert sorted((str(r.id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted(
        (str(i), h, p, str(rule), v) for i, u in rows for h, p, rule, v in [brute(u, RULES, LISTED)])


def test_a_rule_and_a_url_that_most_pages_have(spark):
    urls = [(i, f"http://h{i % 7}.org/{i}") for i in range(3000)] + [(i, "http://listed.net/p?a=1&b=2") for i in range(3000)] + [(1, "http://other.net")]
    got = url_filter.url_verdicts(*tables(spark, urls), hot_share=10).groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict): r["count"] for r in got} == {("org/", "allow"): 3000, (None, "block"): 3000, (None, "allow"): 1}


def test_empty_tables(spark):
    pages, rules, listed = tables(spark, list(enumerate(URLS)))
    assert url_filter.url_verdicts(pages.limit(0), rules, listed).count() == 0
    got = url_filter.url_verdicts(pages, rules.limit(0), listed.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in got] == [(None, "allow")]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    table = url_filter.blocked_bloom(hashes, 20_000)

    def share(frame):
        rows = frame.select("h", F.xxhash64("h", F.lit(1).cast("long")).alias("b")).toPandas()
        return url_filter.passing(table, rows.h.to_numpy(np.int64), rows.b.to_numpy(np.int64)).mean()

    assert share(hashes) == 1.0
    assert share(spark.range(20_000, 60_000).select(F.xxhash64("id").alias("h"))) < 0.03


def test_drop_blocked_keeps_columns(spark):
    pages, rules, listed = tables(spark, list(enumerate(URLS)))
    kept = url_filter.drop_blocked(pages, rules, listed)
    assert kept.columns == pages.columns
    assert sorted(r.page_id for r in kept.collect()) == [i for i, u in enumerate(URLS) if brute(u, RULES, LISTED)[3] == "allow"]
