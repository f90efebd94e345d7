"""URL filters by a sort-merge range join of reversed-host keys with nested rule prefixes.

A host becomes a key of its labels in reverse order (``blog.example.net`` ->
``net.example.blog.``), so a rule on a host covers one interval of keys, its own key up to
the key followed by the byte FF, which no UTF-8 text contains. Rule intervals nest or are
disjoint. One sorted sweep over rule starts, rule ends and points carries the stack of the
rules that are open: each start and end event holds the stack as it is after the event, and
a point takes the stack of the last event before it. The sweep runs in ranges of the sorted
order; the stack open at the start of a range is the last one of the ranges before it.

The sweep is done twice: over distinct hosts for the open rule hosts, then over (rule host,
path) for the longest rule path. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mirador.sources.tables import stage

from .registry import query, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ABOVE_ALL = b"\xff"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, starts: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``stack``, the open prefixes outermost first, to points.

    ``points``: ``key`` text and the ``carried`` columns, which also break ties of the sorted
    order so that one frequent key spreads over ranges. ``starts``: ``key`` text (distinct)
    and ``stack``, the prefixes open from there on, the last of which is the key's own.
    The sorted rows are written before ranges are numbered, so the numbers stay as they are
    when an executor is lost.
    """
    spark = points.sparkSession
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried]
    key = F.encode("key", "UTF-8")
    events = starts.select(key.alias("at"), F.lit(0).alias("kind"), "stack", F.col("key"), *blank).unionByName(
        starts.select(
            F.concat(key, F.lit(ABOVE_ALL)).alias("at"),
            F.lit(0).alias("kind"),
            F.slice("stack", 1, F.size("stack") - 1).alias("stack"),
            F.col("key"),
            *blank,
        )
    )
    rows = events.unionByName(
        points.select(
            key.alias("at"),
            F.lit(1).alias("kind"),
            F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"),
            "key",
            *carried,
        )
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(
        rows.repartitionByRange(ranges, "at", "kind", *carried).withColumn("range_no", F.spark_partition_id()),
        "url-sweep",
    )
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy("range_no")
        .agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("at"))).alias("last_stack"))
        .select("range_no", F.last("last_stack", ignorenulls=True).over(before).alias("carry"))
    )
    so_far = Window.partitionBy("range_no").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.array().cast(starts.schema["stack"].dataType)
    return (
        rows.withColumn("own", F.last("stack", ignorenulls=True).over(so_far))
        .filter("kind = 1")
        .join(F.broadcast(carry), "range_no")  # one row per range
        .select("key", *carried, F.coalesce("own", "carry", nothing).alias("stack"))
    )


def nested(keys: DataFrame, prefixes: Column) -> DataFrame:
    """(key, stack): the given keys that are prefixes of each key, itself last."""
    every = keys.select("key", F.explode(prefixes).alias("prefix"))
    found = every.join(keys.select(F.col("key").alias("prefix")), "prefix")
    return (
        found.groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct(F.length("prefix").alias("n"), "prefix"))).alias("s"))
        .select("key", F.col("s.prefix").alias("stack"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the url's path
    starts with its path; the longest ``host + path`` wins, then the longer host, then
    ``block``. Without a fitting rule, ``rule`` is null and the verdict is ``default``.
    A null url, or one without ``://``, has an empty host and path, which no rule fits.
    Repeated rows are returned as often as they come; other columns are not looked at; rules
    with a null or empty host are left out and a null path is empty. An empty rule table
    gives every page the default, an empty page table no rows.

    Both joins on hosts are plain shuffles; a frequent host is split by the skew settings of
    ``mirador.session`` and, in the sweeps, by page id and url.
    """
    known = (
        rules.select(
            lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict"
        )
        .filter("r_host <> ''")
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("r_verdict"))  # block sorts after allow
        .withColumn("node", host_key(F.col("r_host")))
    )
    urls = (
        pages.groupBy("page_id", "url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("page_id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    )
    labels = F.split(F.regexp_replace("key", r"\.$", ""), r"\.")
    host_stacks = nested(
        known.select(F.col("node").alias("key")).distinct(),
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")),
        ),
    )
    hosts = sweep(urls.select(host_key(F.col("host")).alias("key")).distinct(), host_stacks, [])
    at_host = urls.join(
        hosts.filter(F.size("stack") > 0).withColumnRenamed("key", "host_key"),
        host_key(F.col("host")) == F.col("host_key"),
        "left",
    ).drop("host_key")

    # \u0000 cannot be in a host label's key and a path's start at once: it parts the two
    path_stacks = nested(
        known.select(F.concat("node", F.lit("\u0000"), "r_path").alias("key")).distinct(),
        F.transform(F.sequence(F.instr("key", "\u0000"), F.length("key")), lambda n: F.substring("key", F.lit(1), n)),
    )
    carried = ["page_id", "url", "copies", "host", "path", "node"]
    points = at_host.filter("stack is not null").select(
        "page_id", "url", "copies", "host", "path", F.explode("stack").alias("node")
    )
    points = points.withColumn("key", F.concat("node", F.lit("\u0000"), "path"))
    found = sweep(points, path_stacks, carried).select(*carried, F.try_element_at("stack", F.lit(-1)).alias("hit"))
    by_key = known.select(
        F.concat("node", F.lit("\u0000"), "r_path").alias("hit"),
        F.struct(
            F.length(F.concat("r_host", "r_path")).alias("n"),
            F.length("r_host").alias("h"),
            F.col("r_verdict"),
            F.concat("r_host", "r_path").alias("name"),
        ).alias("best"),
    )
    blank = F.lit(None).cast(by_key.schema["best"].dataType).alias("best")
    basic = ["page_id", "url", "copies", "host", "path"]
    both = found.join(by_key, "hit", "left").select(*basic, "best").unionByName(
        at_host.filter("stack is null").select(*basic, blank)
    )
    return (
        both.groupBy(*basic)
        .agg(F.max("best").alias("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.name").alias("rule"),
            F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
        )
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules of a configuration as a table: (host, path, verdict)."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

ORACLE = """
WITH u AS (
    SELECT page_id,
           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') AS raw,
           coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
    FROM pages
), h AS (
    SELECT page_id, path,
           translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM u
), r AS (
    SELECT page_id, host, path,
           CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@query("op10_url_filters", ORACLE)
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by four nested host and path rules."""
    return judge(table(spark, folder, "pages").select("page_id", "url"), rule_table(spark, RULES))
