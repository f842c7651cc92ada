import datetime as dt

from lexloom.llm import urlfilter

CAPTURES = "id long, url string, fetched date, key string, host string"
ENTRIES = "key string, since date, action string, note string"
D = dt.date


def brute(captures, entries):
    best = {}
    for key, since, action, *_ in entries:
        if key is not None and since is not None and action in urlfilter.ACTIONS:
            k = (key.lower(), since)
            best[k] = max(best.get(k, action), action, key=urlfilter.ACTIONS.index)
    out = []
    for cid, url, day, *_ in captures:
        rest = url.split("://", 1)[1] if url and "://" in url else None
        place = rest and rest.split("?")[0].split("#")[0]
        host = place and place.split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
        found = []
        if host and day:
            segments = [s for s in place.split("/")[1:] if s]
            labels = host.split(".")
            keys = [".".join(labels[i:]) for i in range(len(labels))] + ["/".join([host, *segments[:i]]) for i in range(1, len(segments) + 1)]
            for k in keys:
                active = [(s, a) for (x, s), a in best.items() if x == k and s <= day]
                if active and max(active)[1] != "clear":
                    found.append((len(k), k, *max(active)))
        top = max(found, default=(None, None, None, None))
        out.append((cid, host or None, *top[1:], top[3] == "block"))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.id, r.host, r.rule_key, r.rule_since, r.action, r.blocked) for r in df.collect()), key=repr)


ENTRY_ROWS = [
    ("example.com", D(2024, 1, 10), "block", ""), ("example.com", D(2024, 3, 1), "clear", ""), ("good.example.com", D(2024, 1, 20), "allow", ""), ("example.com", D(2024, 6, 1), "block", ""),
    ("example.com", D(2024, 6, 1), "allow", ""), ("good.example.com/ads", D(2024, 2, 1), "block", ""), ("com", D(2025, 1, 1), "block", ""), ("X.ORG", D(2023, 1, 1), "block", ""),
    (None, D(2024, 1, 1), "block", ""), ("y.org", None, "block", ""), ("y.org", D(2024, 1, 1), "odd", ""), ("x.org", D(2023, 1, 1), "block", ""),
]
URLS = ["http://example.com/", "https://user@good.example.com:8080/ads/1?q=/x", "http://good.example.com/adsx", "http://EXAMPLE.com./a//b#f", "http://x.org", "http://y.org/p", "nonsense", "", None, "ftp://1.2.3.4/a"]
DAYS = [D(2023, 12, 31), D(2024, 1, 10), D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 1), D(2024, 7, 4), D(2025, 1, 1), None]


def test_brute_force(spark):
    rows = [(i, u, d, "k", "h") for i, (u, d) in enumerate((u, d) for u in URLS for d in DAYS)]
    rows += rows[:3] + [(None, "http://example.com/", D(2024, 2, 1), "k", "h"), (999, "http://x.org/" + "p/" * 300, D(2024, 2, 1), "k", "h")]
    got = urlfilter.url_filter(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(ENTRY_ROWS, ENTRIES))
    assert result(got) == brute(rows, ENTRY_ROWS) and "key" in got.columns


def test_empty_tables(spark):
    captures, entries = spark.createDataFrame([(1, "http://example.com/", D(2024, 2, 1), "k", "h")], CAPTURES), spark.createDataFrame(ENTRY_ROWS, ENTRIES)
    none, nothing = spark.createDataFrame([], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert urlfilter.url_filter(none, entries).count() == 0
    assert result(urlfilter.url_filter(captures, nothing)) == [(1, "example.com", None, None, None, False)]


def test_native_plan(spark):
    plan = urlfilter.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_long_urls_take_linear_time(spark):
    """A path of a megabyte, a host of a hundred thousand labels and a listed key of many segments."""
    import time

    deep = "x.org/" + "/".join("ab" for _ in range(300))
    entries = [*ENTRY_ROWS, (deep, D(2024, 1, 1), "block", ""), ("p.net", D(2024, 1, 1), "block", "")]
    rows = [(1, "http://x.org/" + "ab/" * 350_000, D(2024, 2, 1), "k", "h"), (2, "http://" + "a." * 100_000 + "p.net/", D(2024, 2, 1), "k", "h"), (3, "http://x.org/" + "ab/" * 299, D(2024, 2, 1), "k", "h")]
    rows += [(4, "http://x.org/" + "y" * 1_000_000, D(2024, 2, 1), "k", "h")]
    began = time.time()
    got = {r.id: r.rule_key for r in urlfilter.url_filter(spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {1: deep, 2: "p.net", 3: "x.org", 4: "x.org"}
    assert time.time() - began < 20


def test_keys_have_listed_sizes_only(spark):
    entries = spark.createDataFrame([("a.b.c", None, "block", ""), ("x.org/p/q", None, "block", ""), (None, None, "block", "")], ENTRIES)
    assert urlfilter.listed_sizes(entries) == ([3], [2])
