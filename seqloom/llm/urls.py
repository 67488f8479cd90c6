"""URL filters: dated list entries as validity intervals, evaluated as of each capture's fetch time.

An entry adds or removes a domain at a time. The entries of one (list, domain) become
non-overlapping intervals [added, next entry); a capture is blocked if, at its fetch time, an
interval of its host or of a parent domain of its host is open.

Defined cases: a null or unparsable URL has no host and is not blocked; a null fetch time matches
no interval; of entries with equal times a removal comes last; entries with a null domain or time
are no entries; repeated captures each get a row, repeated entries change nothing; with an empty
list nothing is blocked; an empty URL has no host; a URL of any length is read as far as its host; other columns are not
read, and may be called like the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A host in lower case: what stands after the scheme and user info, before port and path.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def domains(host: Column, depths: list[int] | None = None) -> Column:
    """The host and each of its parent domains: a.b.c, b.c, c; with depths only those of so many labels."""
    labels = F.split(host, r"\.")
    if depths is None:
        return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    wanted = F.array(*[F.lit(n) for n in depths]).cast("array<int>")
    return F.transform(F.filter(wanted, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) of entries (list, domain, action add/remove, since)."""
    w = Window.partitionBy("list", "domain").orderBy("since", "action")
    e = entries.where("domain is not null and since is not null").select("list", F.lower("domain").alias("domain"), "action", "since").distinct()
    e = e.withColumn("valid_to", F.lead("since").over(w)).where("action = 'add' and (valid_to is null or valid_to > since)")
    return e.select("list", "domain", F.col("since").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", key: str = "page_id") -> DataFrame:
    """captures' key, host, fetch time, n_active (open intervals of host and parents),
    listed_as (longest such domain), listed_since (its interval's start), blocked.

    Only key, url and time travel, and domains of as many labels as some entry has: a bare top label, which is a key as large as
    the table, travels only if it is listed itself. Equality on the domain makes this a hash or sort-merge join:
    Spark broadcasts the intervals when their size is under its limit, and else splits a hot
    host's partition of captures (adaptive skew join). A capture meets one interval of each
    (list, domain) at most, so the join never multiplies more than by lists times labels.
    """
    c = captures.select(F.monotonically_increasing_id().alias("_row"), F.col(key), host_of(F.col(url)).alias("host"), F.col(fetched))
    v = intervals(entries)
    depths = sorted(r[0] for r in v.select(F.size(F.split("domain", r"\.")).alias("n")).distinct().collect())  # a number for each count of labels
    keys = c.select("*", F.explode_outer(domains(F.col("host"), depths)).alias("_domain"))
    hit = keys.join(v, (keys["_domain"] == v["domain"]) & (keys[fetched] >= v["valid_from"]) & (v["valid_to"].isNull() | (keys[fetched] < v["valid_to"])), "left")
    return (
        hit.groupBy("_row", key, "host", fetched)
        .agg(F.count("domain").alias("n_active"), F.max(F.when(F.col("domain").isNotNull(), F.struct(F.length("domain").alias("n"), "domain", "valid_from"))).alias("_m"))
        .select(key, "host", fetched, "n_active", F.col("_m.domain").alias("listed_as"), F.col("_m.valid_from").alias("listed_since"), (F.col("n_active") > 0).alias("blocked"))
    )


#: Number k of a domain's digest, as SQL that both engines read alike.
_DIGIT = {"spark": "cast(conv(substring(md5(domain), {at}, 7), 16, 10) as bigint)", "duckdb": "('0x' || substring(md5(domain), {at}, 7))::BIGINT"}
#: (list, which domains, action, day) of the registered query's list, over the numbers a, b, c of a domain's digest.
_DATED = (
    ("spam", "a % 4 = 0", "add", "b % 200"),
    ("spam", "a % 4 = 0 AND c % 3 > 0", "remove", "b % 200 + 1 + c % 90"),
    ("spam", "a % 4 = 0 AND c % 3 = 1", "add", "b % 200 + 31 + c % 90"),
    ("malware", "a % 7 = 0", "add", "c % 365"),
    ("malware", "a % 14 = 0", "remove", "c % 365 + 1"),
)


def _entries_sql(engine: str) -> str:
    """SELECT list, domain, action, since FROM d(domain): a domain's entries hang on its digest alone."""
    numbers = ", ".join(f"{_DIGIT[engine].format(at=at)} AS {n}" for n, at in zip("abc", (1, 9, 17), strict=True))
    parts = (f"SELECT '{name}' AS list, domain, '{action}' AS action, {day} AS since FROM (SELECT domain, {numbers} FROM d) WHERE {which}" for name, which, action, day in _DATED)
    return " UNION ALL ".join(parts)


def dated_entries(hosts: DataFrame) -> DataFrame:
    """(list, domain, action, since): a list made of the hosts (host) and their parent domains of two labels or more,
    with additions, removals and further additions, on two lists, so that it grows with its table."""
    d = hosts.select(F.explode(domains(F.col("host"))).alias("domain")).where(F.col("domain").contains(".")).distinct()
    return hosts.sparkSession.sql("WITH d AS (SELECT * FROM {d}) " + _entries_sql("spark"), d=d)


def url_report(pages: DataFrame) -> DataFrame:
    """All pages against the entries of `dated_entries`. The table has no fetch time: page_id * 37 mod 365 is taken as the day."""
    entries = dated_entries(pages.select(host_of(F.col("url")).alias("host")))
    return filter_urls(pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("long").alias("fetched")), entries)


ORACLE = rf"""
WITH c AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, (page_id * 37 % 365)::BIGINT AS fetched, row_number() OVER () AS rid FROM pages),
l AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM c WHERE host IS NOT NULL),
d AS (SELECT DISTINCT array_to_string(p[k:], '.') AS domain FROM (SELECT p, unnest(range(1, len(p))) AS k FROM l)),
e AS ({_entries_sql("duckdb")}),
x AS (SELECT host, array_to_string(p[k:], '.') AS domain FROM (SELECT host, p, unnest(range(1, len(p) + 1)) AS k FROM l)),
last AS (SELECT rid, list, e.domain, arg_max(action, since * 2 + (action = 'remove')::INT) AS action, max(since) AS since
  FROM c JOIN x USING (host) JOIN e ON x.domain = e.domain AND since <= fetched GROUP BY ALL),
a AS (SELECT rid, count(*) AS n_active, arg_max(domain, (length(domain), domain, since)) AS listed_as, arg_max(since, (length(domain), domain, since))::BIGINT AS listed_since FROM last WHERE action = 'add' GROUP BY rid)
SELECT page_id, host, fetched, coalesce(n_active, 0)::BIGINT AS n_active, listed_as, listed_since, n_active IS NOT NULL AS blocked FROM c LEFT JOIN a USING (rid)
"""
