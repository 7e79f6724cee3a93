"""URL filters: a sort-merge range join of pages with prefix rules.

A host becomes a key with its labels reversed, each ended by a dot; the keys of
a host and all its subdomains are those with its own key as prefix, which is
one interval of the sorted order. Likewise the paths that a rule fits are one
interval of the paths below its host. Two sweeps over sorted rows use that: the
first finds the rule hosts around each page's host, the second, for each of
them, the rules of that host that are prefixes of the page's path. At each page
the last mark begun before it names a stack of nested prefixes, innermost last;
what is on the stack and still a prefix of the page is active there. A stack
holds lengths, not rules, so it is no longer than the mark that names it. A
sweep runs over range partitions of (mark, page), so a host or path with many
pages is spread, and each partition starts with the mark that the ones before
it left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.common import join_skewed, written

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels reversed, each ended by a dot: ``www.example.com`` gives ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _sweep(points: DataFrame, marks: DataFrame, by: list[str], salt: str) -> DataFrame:
    """``points`` with ``mark``: of ``marks`` (columns ``by``, ``mark``) the last that is not after the point in the order of ``by``."""
    none = marks.schema["mark"].dataType
    rows = points.withColumns({"q_kind": F.lit(1), "mark": F.lit(None).cast(none), "q_salt": F.xxhash64(salt)})
    begin = marks.select(*by, "mark").withColumns({"q_kind": F.lit(0), "q_salt": F.lit(0).cast("long")})
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = begin.unionByName(rows, allowMissingColumns=True).repartitionByRange(n, *by, "q_kind", "q_salt").withColumn("q_part", F.spark_partition_id())
    dealt = written(dealt, "url-events")
    last = dealt.where("q_kind = 0").groupBy("q_part").agg(F.max_by("mark", F.struct(*by)).alias("mark"))
    parts = dealt.sparkSession.range(n).select(F.col("id").cast("int").alias("q_part"))  # as many rows as partitions
    before = F.last("mark", True).over(Window.orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1))
    carry = parts.join(last, "q_part", "left").select("q_part", before.alias("q_open"))
    inside = Window.partitionBy("q_part").orderBy(*by, "q_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("q_now", F.last("mark", True).over(inside)).where("q_kind = 1").join(F.broadcast(carry), "q_part")
    return swept.select(*points.columns, F.coalesce("q_now", "q_open").alias("mark"))


def _prefixes(marks: DataFrame, by: list[str], text: str, length: Column) -> DataFrame:
    """``by``, ``stack``: the lengths of the prefixes of ``text`` (those that end in a place of ``length``) that are marks too, itself included."""
    own = marks.select(*by).distinct()
    part = own.select(*by, F.explode(length).alias("n")).withColumn("q_of", F.substring(F.col(text), F.lit(1), F.col("n")))
    outer = own.select(*(F.col(c).alias("q_of" if c == text else c) for c in by))
    return part.join(outer, ["q_of", *(c for c in by if c != text)], "left_semi").groupBy(*by).agg(F.array_sort(F.collect_list("n")).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    Of the rules that fit, the one with the most characters in host and path wins; on a tie the longer
    host, then ``block``, then the larger path. No rule: null and ``default``. A null url, or one without
    ``://``, has an empty host and path; a very long one is read whole. Repeated rows and null ids are judged as
    any other; other columns are ignored; an empty table of pages gives no rows, an empty table of rules judges
    all by ``default``. Rules with a null part are passed over.
    """
    url = F.col(url_col)
    own = rules.where("verdict is not null and host is not null and path is not null").select("verdict", "path", F.translate("host", UPPER, LOWER).alias("host"))
    own = own.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict")).alias("v"))
    own = written(own.select(key_of(F.col("host")).alias("key"), "host", "path", "v.block", "v.verdict"), "url-rules")
    ends = F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring(F.col("key"), i, F.lit(1)) == ".")
    hosts = _prefixes(own, ["key"], "key", ends).select("key", F.struct("key", "stack").alias("mark"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", key_of(F.col("host"))).withColumn("row", F.monotonically_increasing_id())
    met = _sweep(rows, hosts, ["key"], "id")
    around = F.transform("mark.stack", lambda n: F.substring(F.col("mark.key"), F.lit(1), n))
    met = met.select("id", "host", "path", "row", F.explode_outer(F.filter(around, lambda k: F.col("key").startswith(k))).alias("key"))
    each = F.sequence(F.lit(0), F.length("path"))
    paths = _prefixes(own, ["key", "path"], "path", each).select("key", "path", F.struct("key", "path", "stack").alias("mark"))
    swept = _sweep(met, paths, ["key", "path"], "row")
    fits = F.filter("mark.stack", lambda n: F.col("path").startswith(F.substring(F.col("mark.path"), F.lit(1), n)))
    swept = swept.withColumn("n", F.when(F.col("mark.key") == F.col("key"), F.array_max(fits)))
    found = swept.select("id", "host", "path", "row", "key", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("fit"))
    rank = F.struct(F.length(F.concat("of.host", "of.path")).alias("n"), F.length("of.host").alias("h"), "of.block", "of.path", "of.host", "of.verdict")
    count = found.where("fit is not null").groupBy("key", "fit").agg(F.count("*").alias("q_n"))
    of = own.select("key", F.col("path").alias("fit"), F.struct("host", "path", "block", "verdict").alias("of")).join(count, ["key", "fit"])
    judged = join_skewed(found, of, ["key", "fit"], "q_n", left=True)
    best = judged.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("of").isNotNull(), rank)).alias("best"))
    rule = F.concat("best.host", "best.path")
    return best.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _sql(rules=RULES, default="allow") -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    upper = f"'{UPPER}', '{LOWER}'"
    return rf"""WITH r(v, h, p) AS (VALUES {values}),
    u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {upper}) AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
    SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule,
           coalesce(max_by(v, length(h || p)), '{default}') AS verdict
    FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY u.page_id, host, path"""


SQL = _sql()
