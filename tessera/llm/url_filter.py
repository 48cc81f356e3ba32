"""URL filters by a temporal list join, in DataFrame functions alone.

Dated entries (kind, pattern, action, at) become validity intervals: an ``add`` opens one, the next entry of the same
pattern closes it. An as-of join then evaluates each capture (url, fetched date) against the intervals that hold its
date. A capture is looked up under keys that it spells out itself: its host and each parent domain of two labels or more
(kind ``domain``), and its host with each leading run of path segments (kind ``prefix``), so there is no range or
substring join: one equality on the key, with the dates as a filter, finds at most one interval for each key.

Contract. Entries with a null field or another action than add and remove are ignored; entries that repeat count once; of
an add and a remove on one date, the remove holds. The interval includes its first date and excludes its last. Hosts, of
patterns too, compare in lower case, trimmed, without a final dot; paths compare as they are; user info, port, query and fragment don't matter. A null or hostless url, or a null date, is never blocked. Of
several rules that hold, the longest pattern is named, then the smallest. Every capture row is returned once, repeated
rows too; ``url_filter`` ignores other columns of its inputs.

Captures that repeat url and date are evaluated once. A capture spells no key longer than the longest pattern listed, so
keys stay linear in a url's length. Keys under which more than ``HOT`` captures ask are counted first: their intervals are
copied once for each ``HOT`` of them and the captures dealt over the copies, so a host with a third of all captures is spread over
as many tasks as it needs, and other entries aren't copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage

HOT = 20_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"  # an address in brackets holds colons
PATH = r"^[^:/?#]+://[^/?#]*([^?#]*)"


def host_of(url):
    """The lower-case host of a url column, empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until): until is null for entries that still hold."""
    cut = F.instr("pattern", "/")
    host = F.when((F.col("kind") == "domain") | (cut == 0), F.col("pattern")).otherwise(F.expr("left(pattern, instr(pattern, '/') - 1)"))
    path = F.when(F.col("kind") == "domain", F.lit("")).otherwise(F.expr("substring(pattern, length(host) + 1)"))
    own = entries.select("kind", F.trim("pattern").alias("pattern"), F.lower(F.trim("action")).alias("action"), F.col("at").cast("date").alias("at"))
    own = own.dropna().where("action in ('add', 'remove')").withColumn("host", host).withColumn("path", path)
    own = own.select("kind", F.concat(F.regexp_replace(F.lower("host"), r"\.$", ""), "path").alias("pattern"), "action", "at").distinct()
    last = own.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action"))  # add < remove
    later = F.lead("at").over(Window.partitionBy("kind", "pattern").orderBy("at"))
    return last.withColumn("until", later).where("action = 'add'").select("kind", "pattern", F.col("at").alias("since"), "until")


def _keys(labels_listed: int, parts_listed: int):
    """All keys of a capture that can be listed: host suffixes of two labels or more, and leading path runs, no longer than the longest pattern."""
    labels = F.split("host", r"\.")
    shortest = F.greatest(F.lit(1), F.size(labels) - 1)
    domains = F.transform(F.sequence(F.least(shortest, F.greatest(F.lit(1), F.size(labels) - labels_listed + 1)), shortest), lambda i: F.concat(F.lit("domain "), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda x: x != "")
    most = F.least(F.size(parts), F.lit(parts_listed))
    runs = F.when(most > 0, F.transform(F.sequence(F.lit(1), most), lambda i: F.concat(F.lit("prefix "), F.col("host"), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.array_distinct(F.concat(domains, F.coalesce(runs, F.array().cast("array<string>"))))


def _dealt(rows: DataFrame, other: DataFrame, counts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows dealt over salts and other copied to them, for the keys that counts(keys, n) gives more than HOT rows."""
    hot = counts.where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("salts")
    copied = other.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt, copied


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched) with blocked, rule and since."""
    own = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched"))
    captured = stage(own.groupBy("url", "fetched").agg(F.count("*").alias("n")).where("url is not null and fetched is not null"), "url-captures")
    listed = intervals(entries)
    longest = listed.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))).alias("labels"), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("parts")
    ).first()  # two numbers
    listed = listed.select(F.concat_ws(" ", "kind", "pattern").alias("key"), "pattern", "since", "until")
    asked = captured.withColumn("host", host_of(F.col("url"))).where("host <> ''").select("url", "fetched", F.explode(_keys(longest["labels"] or 0, longest["parts"] or 0)).alias("key"))
    asked, listed = _dealt(asked, listed, asked.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    held = asked.join(listed, ["key", "salt"]).where("fetched >= since and (until is null or fetched < until)")
    best = held.groupBy("url", "fetched").agg(F.min(F.struct((-F.length("pattern")).alias("short"), "pattern", "since")).alias("hit"))
    own, best = _dealt(own, best, captured, ["url", "fetched"])
    return own.join(best, ["url", "fetched", "salt"], "left").select(
        "page_id", "url", "fetched", F.col("hit").isNotNull().alias("blocked"), F.col("hit.pattern").alias("rule"), F.col("hit.since").alias("since")
    )


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of pages(url) by rule, for tables that come without one.

    By the first 16 bits of md5(host): one host in eight is listed for 60 days, one in eight for good, and one in eight has
    its first path segment listed for 90 days, lifted, and listed again; dates spread over 2024. Besides, two domains are
    listed throughout.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH, 1).alias("path")).where("host <> ''")
    part = F.get(F.filter(F.split("path", "/"), lambda x: x != ""), F.lit(0))
    seen = seen.select("host", part.alias("part")).distinct()
    draw = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"cast((m div 8) % 250 + {n} as int)"))
    drawn = seen.withColumn("m", draw)
    entry = lambda kind, pattern, action, n: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("at"))
    host, prefix = F.col("host"), F.concat_ws("/", "host", "part")
    made = drawn.select(
        F.explode(
            F.when(F.expr("m % 8 = 0"), F.array(entry("domain", host, "add", 0), entry("domain", host, "remove", 60)))
            .when(F.expr("m % 8 = 1"), F.array(entry("domain", host, "add", 0)))
            .when(F.expr("m % 8 = 2 and part is not null"), F.array(entry("prefix", prefix, "add", 0), entry("prefix", prefix, "remove", 90), entry("prefix", prefix, "add", 120)))
        ).alias("e")
    ).select("e.*")
    fixed = pages.sparkSession.createDataFrame([("domain", "cheap-pills.example.com", "add"), ("domain", "example.org", "add")], "kind string, pattern string, action string")
    return made.unionByName(fixed.withColumn("at", F.when(F.col("pattern") == "example.org", F.lit("2024-11-01")).otherwise(F.lit("2024-01-01")).cast("date")))


def fetched_on():
    """A date for captures that come without one: 2024-01-01 and page_id mod 366 days."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(366)).cast("int"))
