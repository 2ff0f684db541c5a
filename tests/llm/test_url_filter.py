import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeflow.llm.url_filter import filter_urls, intervals, keep_urls

D = lambda n: dt.date(2024, 1, n)
ENTRIES = [
    ("domain", "bad.com", D(5), "add", "b"), ("domain", "bad.com", D(10), "remove", None), ("domain", "bad.com", D(15), "add", "again"), ("domain", "bad.com", D(15), "remove", None), ("domain", "bad.com", D(5), "add", "a"),
    ("prefix", "ok.org/x", D(3), "add", "x"), ("prefix", "ok.org/x/y", D(4), "add", "y"), ("prefix", "ok.org/", D(20), "add", "root"), ("url", "http://ok.org/x/y?q=1", D(8), "add", "u"), ("url", "http://ok.org/x/y?q=1", D(9), "remove", None),
    (None, "k", D(1), "add", "n"), ("domain", None, D(1), "add", "n"), ("domain", "ok.org", None, "add", "n"),
]
ENTRY, CAPTURE = "kind string, key string, at date, action string, reason string", "page_id long, url string, fetched_at date, html string, kind string"
URLS = ["http://bad.com", "https://a.b.BAD.com:80/x#f", "http://notbad.com/", "http://u:p@bad.com/", "http://ok.org/x", "http://ok.org/xy", "http://ok.org/x/y?q=1", "http://ok.org//x/y/z", "http://ok.org", "no url", "", None, "http:///x", "http://" + "a." * 300 + "bad.com/" + "p/" * 300]


def brute(url, at):
    from urllib.parse import urlsplit

    if not url or at is None or "://" not in url:
        return None
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if not host:
        return None
    labels, segments = host.split("."), [x for x in parts.path.split("/") if x]
    keys = [(0, "domain", ".".join(labels[i:])) for i in range(len(labels))] + [(1, "prefix", host + "/" + "/".join(segments[:i])) for i in range(len(segments) + 1)] + [(2, "url", url)]
    hits = []
    for rank, kind, key in keys:
        states = {}
        for k, e, when, action, reason in ENTRIES:
            if (k, e) == (kind, key) and when is not None and when <= at:
                states.setdefault(when, []).append((action, reason))
        if states:
            adds = [r for a, r in states[max(states)] if a == "add"]
            if adds:
                hits.append((rank, len(key), kind, key, max(states), min(adds)))
    return max(hits)[2:] if hits else None


def test_against_brute_force(spark):
    rows = [(i * 100 + d, u, D(d) if d else None, None, "own") for i, u in enumerate(URLS) for d in (0, 1, 3, 4, 5, 8, 9, 10, 15, 20, 31)] + [(1, URLS[0], D(6), None, None)] * 2
    captures = spark.createDataFrame(rows, CAPTURE)
    got = filter_urls(captures, spark.createDataFrame(ENTRIES, ENTRY)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.url, r.fetched_at)
        assert r.blocked == (want is not None) and (r.kind, r.key, r.listed_from, r.reason) == (want or (None,) * 4), r
    kept = keep_urls(captures, spark.createDataFrame(ENTRIES, ENTRY))
    assert kept.columns == captures.columns
    assert kept.count() == sum(brute(u, a) is None for _, u, a, _, _ in rows)


def test_intervals(spark):
    got = {(r.key, r.listed_from, r.listed_to, r.reason) for r in intervals(spark.createDataFrame(ENTRIES, ENTRY)).where("key = 'bad.com'").collect()}
    assert got == {("bad.com", D(5), D(10), "a"), ("bad.com", D(15), None, "again")}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    captures, entries = spark.createDataFrame([(1, URLS[0], D(6), None, None)][:n], CAPTURE), spark.createDataFrame(ENTRIES[: 1 - n], ENTRY)
    assert [r.blocked for r in filter_urls(captures, entries).collect()] == [False] * n


def test_very_long_paths_and_hosts(spark):
    urls = ["http://ok.org/x/" + "p/" * 30_000, "http://" + "a." * 20_000 + "bad.com/", "http://ok.org/" + "q/" * 30_000]
    captures = spark.createDataFrame([(i, u, D(6), None, None) for i, u in enumerate(urls)], CAPTURE)
    got = {r.page_id: r.key for r in filter_urls(captures, spark.createDataFrame(ENTRIES, ENTRY)).collect()}
    assert got == {0: "ok.org/x", 1: "bad.com", 2: None}


def test_extra_columns_of_captures_stay(spark):
    captures = spark.createDataFrame([(1, "http://bad.com", D(6), None, None), (2, "http://fine.com", D(6), None, None)], CAPTURE)
    for name in ("_url", "_at", "at_url", "AT_TIME", "host", "key", "blocked"):
        captures = captures.withColumn(name, F.lit("own"))
    kept = keep_urls(captures, spark.createDataFrame(ENTRIES, ENTRY))
    assert kept.columns == captures.columns and [(r.page_id, r._url, r.at_url) for r in kept.collect()] == [(2, "own", "own")]
