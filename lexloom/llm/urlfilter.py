"""URL filters: dated list entries as validity intervals, met by captures as of their fetch date.

An entry names a host, a domain above it, or a host with leading path segments, from a date on. A capture has a key
for each of these; of its keys whose entry is in force at its fetch date, the longest decides. All of it is native:
the as-of join runs on distinct (key, day) pairs and on intervals cut by month, so that no key, however hot in
captures or entries, makes a group of more than a month's days, and no capture is compared with a key's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions by strength: of entries with one key and day the strongest counts.
ACTIONS = ("clear", "allow", "block")
_FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def place_of(url: Column) -> Column:
    """host/segment/segment..., the longest key of the URL."""
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    return F.concat_ws("/", F.array_insert(segments, 1, host_of(url)))


def listed_sizes(entries: DataFrame) -> tuple[list[int], list[int]]:
    """(numbers of labels, numbers of path segments) that the listed keys have: small sets, got by one job.

    A URL has so many keys at most as there are sizes, whatever its length.
    """
    key = entries.filter("key is not null").select(F.split("key", "/").alias("parts"))
    size = F.struct(F.when(F.size("parts") == 1, F.size(F.split(F.col("parts")[0], r"\."))).alias("labels"), (F.size("parts") - 1).alias("segments"))
    found = key.select(size.alias("s")).distinct().collect()
    return sorted({r["s"]["labels"] for r in found} - {None}), sorted({r["s"]["segments"] for r in found} - {0})


def keys_of(place: Column, labels: list[int], segments: list[int]) -> Column:
    """The keys of a place that a list with keys of these sizes may hold: the host and the domains above it, by their
    numbers of labels, and the host with leading path segments, by their number."""
    host = F.substring_index(place, "/", 1)
    dots, slashes = F.regexp_count(host, F.lit(r"\.")), F.regexp_count(place, F.lit("/"))
    domains = [F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in labels]
    paths = [F.when(slashes >= n, F.substring_index(place, "/", n + 1)) for n in segments]
    return F.array_distinct(F.array_compact(F.array(*domains, *paths, F.lit(None).cast("string"))))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (key, since, action) to (key, since, until, action): in force from since up to, not including, until.

    An entry ends where the next of its key begins; clear only ends. Entries without key, date or known action are
    passed over. A key has at most one interval a day, which bounds the window's group by the days of the history.
    """
    strength = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    day = F.to_date("since")
    one = (
        entries.select(F.lower("key").alias("key"), day.alias("since"), strength.alias("s"))
        .filter("key is not null and since is not null and s > 0").groupBy("key", "since").agg(F.max("s").alias("s"))
    )
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    out = one.select("key", "since", F.coalesce(until, F.to_date(F.lit(_FOREVER))).alias("until"), F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("s").cast("int")).alias("action"))
    return out.filter("action != 'clear'")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, rule_key, rule_since, action and blocked (columns of these names are replaced).

    Unlisted captures, and those without a host or a date, have null rule columns and are not blocked. Repeated
    captures agree. Of one key's entries on one day the strongest counts; of a capture's listed keys the longest, then
    the greatest by code point. Long URLs are read whole: a URL has a key for each size (labels, segments) that listed
    keys have, so its cost grows with its length. Empty captures: empty result; empty entries: nothing is blocked.
    Two small jobs run when the frame is made: the sizes of the listed keys, and the captures' last day.
    """
    rest = [c for c in captures.columns if c not in ("host", "rule_key", "rule_since", "action", "blocked")]
    placed = captures.select(*rest, host_of(F.col(url)).alias("host"), place_of(F.col(url)).alias("__place"), F.to_date(fetched).alias("__day"))
    asked = placed.filter("host is not null and __day is not null").select("__place", "__day").distinct()
    asked = asked.select("__place", "__day", F.explode(keys_of(F.col("__place"), *listed_sizes(entries))).alias("key"))
    probes = asked.select("key", "__day").distinct().withColumn("month", _month(F.col("__day")))
    # no interval needs to reach past the captures' last day: one value, got beforehand
    last = captures.agg(F.max(F.to_date(fetched))).first()[0]
    held = intervals(entries).withColumn("end", F.least(F.date_sub("until", 1), F.lit(last).cast("date"))).filter("since <= end")
    held = held.withColumn("month", F.explode(F.sequence(_month(F.col("since")), _month(F.col("end"))))).drop("end")
    active = probes.join(held, ["key", "month"]).filter("since <= __day and __day < until").select("key", "__day", "since", "action")
    rule = F.max(F.struct(F.length("key").alias("n"), "key", "since", "action"))
    ruled = asked.join(active, ["key", "__day"]).groupBy("__place", "__day").agg(rule.alias("__rule"))
    out = placed.join(ruled, ["__place", "__day"], "left")
    return out.select(
        *rest, "host", F.col("__rule.key").alias("rule_key"), F.col("__rule.since").alias("rule_since"), F.col("__rule.action").alias("action"),
        F.coalesce(F.col("__rule.action") == "block", F.lit(False)).alias("blocked"),
    )


# The test tables have neither fetch dates nor lists. The query derives both from pages by fixed rules: a date from
# the id, and for every host some entries that depend on its MD5.


def _draw(host: Column) -> Column:
    return F.conv(F.substring(F.md5(host.cast("binary")), 1, 6), 16, 10).cast("long") % 97


def derived_entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct().withColumn("e", _draw(F.col("host")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("e") * 3 % 300).cast("int"))
    e = F.col("e")
    entry = lambda key, since, action, when: F.when(when, F.struct(key.alias("key"), since.alias("since"), F.lit(action).alias("action")))
    own = F.array_compact(F.array(
        entry(F.col("host"), day, "block", e % 3 != 0), entry(F.col("host"), F.date_add(day, 45), "clear", e % 2 == 0),
        entry(F.col("host"), F.date_add(day, 45), "allow", e % 2 != 0), entry(F.col("host"), F.date_add(day, 90), "block", e % 5 == 0),
        entry(F.concat("host", F.lit("/en")), F.lit("2024-03-15").cast("date"), "allow", e % 4 == 0),
    ))
    listed = hosts.select(F.explode(own).alias("x")).select("x.*")
    domains = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("key")).filter("key != ''").distinct()
    dated = F.explode(F.array(
        F.struct(F.lit("2024-06-01").cast("date").alias("since"), F.lit("block").alias("action")),
        F.struct(F.lit("2024-07-01").cast("date").alias("since"), F.lit("clear").alias("action")),
    ))
    return listed.unionByName(domains.select("key", dated.alias("x")).select("key", "x.*"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int")))
    return url_filter(captures, derived_entries(pages)).select("page_id", "url", "fetched", "host", "rule_key", "rule_since", "action", "blocked")


def oracle() -> str:
    host = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '')"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
    return f"""
    WITH c AS (SELECT page_id, url, (DATE '2024-01-01' + (page_id * 37 % 365)::INT)::DATE AS fetched, {host} AS host,
        list_filter(string_split({path}, '/'), lambda s: s <> '') AS seg FROM pages),
    h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT % 97 AS e FROM c WHERE host IS NOT NULL),
    d AS (SELECT host, e, (DATE '2024-01-01' + (e * 3 % 300)::INT)::DATE AS day FROM h),
    raw AS (
      SELECT host AS key, day AS since, 'block' AS action FROM d WHERE e % 3 <> 0
      UNION ALL SELECT host, (day + 45)::DATE, CASE WHEN e % 2 = 0 THEN 'clear' ELSE 'allow' END FROM d
      UNION ALL SELECT host, (day + 90)::DATE, 'block' FROM d WHERE e % 5 = 0
      UNION ALL SELECT host || '/en', DATE '2024-03-15', 'allow' FROM d WHERE e % 4 = 0
      UNION ALL SELECT key, since, action FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS key FROM h) k,
        (VALUES (DATE '2024-06-01', 'block'), (DATE '2024-07-01', 'clear')) AS v(since, action) WHERE key <> ''),
    best AS (SELECT key, since, max(CASE action WHEN 'clear' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS s FROM raw GROUP BY key, since),
    iv AS (SELECT key, since, coalesce(lead(since) OVER (PARTITION BY key ORDER BY since), DATE '9999-12-31') AS until, s FROM best),
    k AS (
      SELECT page_id, fetched, list_aggregate(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), 'string_agg', '.') AS key
      FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host IS NOT NULL) x
      UNION SELECT page_id, fetched, host || '/' || list_aggregate(list_slice(seg, 1, i), 'string_agg', '/')
      FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS i FROM c WHERE host IS NOT NULL) y),
    m AS (SELECT page_id, k.key, since, s, row_number() OVER (PARTITION BY page_id ORDER BY length(k.key) DESC, k.key DESC) AS r
      FROM k JOIN iv ON k.key = iv.key AND since <= fetched AND fetched < until WHERE s > 1)
    SELECT c.page_id, c.url, c.fetched, c.host, m.key AS rule_key, m.since AS rule_since,
      CASE m.s WHEN 2 THEN 'allow' WHEN 3 THEN 'block' END AS action, coalesce(m.s = 3, false) AS blocked
    FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1"""
