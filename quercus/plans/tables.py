"""The query kernels on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quercus.functions import bimap, names
from quercus.operators import graph, sequences
from quercus.plans.registry import query, table
from quercus.plans.staging import staged

WORD = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\x0b\f\rA-Za-z0-9_]"


PLAIN = r"[^ \t\n\x0b\f\r]+"  # words of any script, as white space parts them


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)).alias("words"))


# -- tokens, masks, lines ------------------------------------------------------------------


@query(
    "token_kinds",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS v FROM documents)
        SELECT kind, count(*) AS n, count(DISTINCT v) AS different FROM
        (SELECT v, CASE WHEN regexp_matches(v, '^[0-9]') THEN 'integer' WHEN regexp_matches(v, '^[A-Z_]') THEN 'variable'
                        WHEN regexp_matches(v, '^[a-z]') THEN 'atom' ELSE 'punctuation' END AS kind FROM t) GROUP BY kind""",
)
def token_kinds(spark, sf_dir):
    v = F.col("v")
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("v"))
    kind = F.when(v.rlike("^[0-9]"), "integer").when(v.rlike("^[A-Z_]"), "variable").when(v.rlike("^[a-z]"), "atom").otherwise("punctuation")
    counted = tokens.groupBy("v").agg(F.count("*").alias("n"))  # once per different token from here on
    return counted.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("different"))


@query(
    "token_abstraction",
    r"""SELECT md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z]+', 'a', 'g'), '[0-9]+', 'i', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS mask,
               count(*) AS freq, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
)
def token_abstraction(spark, sf_dir):
    """Documents that are equal once words and numbers are class letters."""
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[A-Za-z]+", "a"), "[0-9]+", "i"), r"[ \t\n\x0b\f\r]+", " ")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(mask).alias("mask"))
    return docs.groupBy("mask").agg(F.count("*").alias("freq"), F.min("doc_id").alias("first_doc")).where("freq >= 2")


@query(
    "identical_texts",
    """WITH d AS (SELECT doc_id, min(doc_id) OVER w AS first_doc, count(*) OVER w AS freq FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text))
       SELECT doc_id, first_doc, freq FROM d WHERE freq >= 2""",
)
def identical_texts(spark, sf_dir):
    """Exact clone classes: a row for each member with its class's first; only digests and ids are shuffled, and no class is gathered."""
    keyed = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("key"))
    several = keyed.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("freq")).where("freq >= 2")
    return keyed.join(several, "key").select("doc_id", "first_doc", "freq")


@query(
    "large_sources",
    """SELECT source, count(DISTINCT line) AS n_lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
       WHERE trim(line) <> '' GROUP BY source HAVING count(DISTINCT line) >= 100""",
)
def large_sources(spark, sf_dir):
    """At least N distinct non-blank lines (inclusive, unlike the strict test on single documents)."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    return lines.select("source", F.md5("line").alias("line")).distinct().groupBy("source").agg(F.count("*").alias("n_lines")).where("n_lines >= 100")


# -- repeated sequences --------------------------------------------------------------------

K, MIN_FREQ = 8, 3


@query(
    "repeated_sequences",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{PLAIN}') AS words FROM documents),
        g AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {K} + 2), lambda i: array_to_string(words[i:i + {K - 1}], ' '))) AS gram FROM w WHERE len(words) >= {K}),
        f AS (SELECT gram, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= {MIN_FREQ})
        SELECT freq, docs, count(*) AS sequences FROM f GROUP BY freq, docs""",
)
def repeated_sequences(spark, sf_dir):
    """How many K-word sequences recur how often in at least MIN_FREQ documents."""
    return sequences.recurring(table(spark, sf_dir, "documents"), PLAIN, K, MIN_FREQ)


@query(
    "maximal_repeats",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{PLAIN}') AS words FROM documents),
        g AS (SELECT doc_id, unnest(range(0, len(words) - {K} + 1)) AS i, unnest(list_transform(range(1, len(words) - {K} + 2), lambda i: array_to_string(words[i:i + {K - 1}], ' '))) AS gram FROM w WHERE len(words) >= {K}),
        f AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= {MIN_FREQ}),
        p AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g JOIN f USING (gram))
        SELECT doc_id, min(i) AS start_word, max(i) + {K} AS end_word, max(i) - min(i) + {K} AS len FROM p GROUP BY doc_id, island""",
)
def maximal_repeats(spark, sf_dir):
    """Adjacent repeated sequences joined into spans: gaps and islands over the places of each document."""
    spans = sequences.spans(table(spark, sf_dir, "documents"), PLAIN, K, MIN_FREQ)
    return spans.select("doc_id", F.col("a").alias("start_word"), (F.col("b") + K).alias("end_word"), (F.col("b") - F.col("a") + K).alias("len"))


# -- windows, intervals, order -------------------------------------------------------------


@query(
    "event_islands",
    """WITH e AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                         - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
       SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM e GROUP BY user_id, event_type, island HAVING count(*) >= 2""",
)
def event_islands(spark, sf_dir):
    order = [F.col("ts"), F.col("event_id")]
    e = table(spark, sf_dir, "events")
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    runs = e.select("user_id", "event_type", "event_id", island.alias("island")).groupBy("user_id", "event_type", "island")
    return runs.agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).where("n >= 2").drop("island")


@query(
    "sliding_triples",
    """WITH e AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT a || '>' || b || '>' || c AS triple, count(*) AS n FROM e WHERE c IS NOT NULL GROUP BY 1""",
)
def sliding_triples(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.currentRow, 2)
    seq = table(spark, sf_dir, "events").select(F.collect_list("event_type").over(w).alias("s")).where(F.size("s") == 3)
    return seq.groupBy(F.array_join("s", ">").alias("triple")).agg(F.count("*").alias("n"))


@query(
    "interval_containment",
    """SELECT p.event_id, count(*) AS inside, min(e.event_id) AS first_inside FROM events p JOIN events e
       ON e.user_id = p.user_id AND e.event_type = 'click' AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 6 HOUR
       WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
)
def interval_containment(spark, sf_dir):
    """Points inside intervals by an equi-join on time buckets: an interval meets the two buckets it touches."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    size = 6 * 3600 * 1_000_000
    own = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("s").alias("lo"), F.explode(F.array(F.floor(F.col("s") / size), F.floor(F.col("s") / size) + 1)).alias("bucket"))
    points = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("point"), "s", F.floor(F.col("s") / size).alias("bucket"))
    hit = own.join(points, ["user_id", "bucket"]).where((F.col("s") >= F.col("lo")) & (F.col("s") < F.col("lo") + size))
    return hit.groupBy("event_id").agg(F.count("*").alias("inside"), F.min("point").alias("first_inside"))


@query(
    "ordered_overlap_removal",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
       k AS (SELECT o_custkey, o_orderkey, r, o_orderdate AS last, true AS kept FROM o WHERE r = 1 UNION ALL
             SELECT o.o_custkey, o.o_orderkey, o.r, CASE WHEN o.o_orderdate >= k.last + INTERVAL 90 DAY THEN o.o_orderdate ELSE k.last END, o.o_orderdate >= k.last + INTERVAL 90 DAY
             FROM k JOIN o ON o.o_custkey = k.o_custkey AND o.r = k.r + 1)
       SELECT o_custkey, count(*) AS kept FROM k WHERE kept GROUP BY o_custkey""",
)
def ordered_overlap_removal(spark, sf_dir):
    """Ranges of 90 days from each order on; in order, a range stays if it does not overlap the last that stayed.

    Each range knows the first after it that it does not overlap (a window over starts and ends); from a customer's first
    the chain is followed by doubling the jumps, so a round joins what the one before left and no list is gathered.
    """
    days = 90 * 86_400_000_000
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    start = o.select("o_custkey", "t", F.lit(1).alias("kind"), "o_orderkey")
    end = o.select("o_custkey", (F.col("t") + days).alias("t"), F.lit(0).alias("kind"), "o_orderkey")
    later = Window.partitionBy("o_custkey").orderBy("t", "kind", "o_orderkey").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = end.union(start).withColumn("to", F.first(F.when(F.col("kind") == 1, F.col("o_orderkey")), True).over(later))
    jump = staged(both.where("kind = 0 and to is not null").select(F.col("o_orderkey").alias("at"), "to"), "jumps")
    kept = staged(o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("t", "o_orderkey")).alias("at")), "kept")
    while not jump.isEmpty():
        kept = staged(kept.union(kept.join(jump, "at").select("o_custkey", "to")).distinct(), "kept")
        jump = staged(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.at")).select("a.at", "b.to"), "jumps")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("kept"))


@query(
    "statement_numbering",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS idx,
              date_diff('day', min(l_shipdate) OVER (PARTITION BY l_orderkey), l_shipdate) AS relative_day FROM lineitem""",
)
def statement_numbering(spark, sf_dir):
    """Consecutive numbers, and places relative to the first of the group, as hashes that survive moves need them."""
    w = Window.partitionBy("l_orderkey")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.min(F.col("l_shipdate").cast("date")).over(w)).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w.orderBy("l_shipdate", "l_linenumber")).cast("long").alias("idx"), day.alias("relative_day"))


@query(
    "nesting_depth",
    """WITH t AS (SELECT page_id, regexp_extract_all(html, '</?(?:div|ul|li|p|body|html|table|tr|td)[ >]') AS tags FROM pages),
       u AS (SELECT page_id, unnest(range(0, len(tags))) AS i, unnest(tags) AS tag FROM t),
       d AS (SELECT page_id, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM u)
       SELECT page_id, max(depth)::BIGINT AS depth FROM d GROUP BY page_id HAVING max(depth) >= 3""",
)
def nesting_depth(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit("</?(?:div|ul|li|p|body|html|table|tr|td)[ >]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s, tag):
        now = s["now"] + F.when(tag.startswith("</"), -1).otherwise(1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    depth = F.aggregate(tags, start, step)["most"].cast("long")
    return table(spark, sf_dir, "pages").select("page_id", depth.alias("depth")).where("depth >= 3")


@query("top_ten", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_ten(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("arg_min", "SELECT p_brand, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS cheapest FROM part GROUP BY p_brand")
def arg_min(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))


# -- grouping, sets, three-valued logic ------------------------------------------------------


@query(
    "group_by_nth",
    "SELECT o_orderpriority AS k, list_sort(list(DISTINCT o_orderstatus)) AS members, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1",
)
def group_by_nth(spark, sf_dir):
    """Different rows first, then the group."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    return rows.groupBy(F.col("o_orderpriority").alias("k")).agg(F.array_sort(F.collect_list("o_orderstatus")).alias("members"), F.count("*").alias("n"))


@query(
    "bag_difference",
    """SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY nation""",
)
def bag_difference(spark, sf_dir):
    """``--``: each occurrence on the right takes away one on the left."""
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return left.exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey")).groupBy("nation").agg(F.count("*").alias("n"))


@query(
    "set_operations",
    """SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
       SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL
       SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""",
)
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("both", a.intersect(b)), ("left", a.subtract(b)), ("any", a.union(b).distinct())]
    kind = [df.select(F.lit(n).alias("kind"), "k") for n, df in parts]
    return kind[0].union(kind[1]).union(kind[2])


@query(
    "semi_and_anti",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS known FROM customer""",
)
def semi_and_anti(spark, sf_dir):
    """Internal (known) and external (unknown) references; duplicates on the left stay."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("known", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("known", F.lit(False)))


@query(
    "three_valued",
    """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN true WHEN bool_or(o_orderstatus = 'P') THEN NULL ELSE false END AS effect FROM orders GROUP BY o_custkey""",
)
def three_valued(spark, sf_dir):
    """Any true: true; else any unknown: unknown; else false."""
    v = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    effect = F.when(F.bool_or(v), True).when(F.count_if(v.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(False)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(effect.alias("effect"))


@query(
    "status_pivot",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""",
)
def status_pivot(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return found.select("o_orderpriority", *(F.coalesce(F.col(x), F.lit(0)).alias(x.lower()) for x in "FOP"))


@query(
    "small_cluster_grouping",
    """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), m AS (SELECT max(n) AS most FROM c)
       SELECT CASE WHEN 2 * n < most THEN 'small' ELSE p_type END AS cluster, sum(n)::BIGINT AS size, count(*) AS parts FROM c, m GROUP BY 1""",
)
def small_cluster_grouping(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    c = c.join(F.broadcast(c.agg(F.max("n").alias("most"))), F.lit(True))  # one row
    return c.groupBy(F.when(2 * F.col("n") < F.col("most"), "small").otherwise(F.col("p_type")).alias("cluster")).agg(F.sum("n").alias("size"), F.count("*").alias("parts"))


def _sets(spark, sf_dir):
    """``a, x``: the parts (by brand and a seventh of the keys) that the suppliers of each nation deliver."""
    li, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    keys = li.select("l_partkey", "l_suppkey").distinct()
    joined = keys.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return staged(joined.select(F.col("s_nationkey").alias("a"), F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 7).cast("string")).alias("x")).distinct())


_SETS_SQL = """s AS (SELECT DISTINCT s_nationkey AS a, p_brand || '/' || (p_partkey % 7)::VARCHAR AS x FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
       n AS (SELECT a, count(*) AS n FROM s GROUP BY a), i AS (SELECT l.a AS a, r.a AS b, count(*) AS common FROM s l JOIN s r ON l.x = r.x AND l.a < r.a GROUP BY 1, 2)"""


@query(
    "set_similarity",
    f"""WITH {_SETS_SQL} SELECT i.a, i.b, common, round(1 - common::DOUBLE / (na.n + nb.n - common), 9) AS jaccard_distance, round(2.0 * common / (na.n + nb.n), 9) AS dice
        FROM i JOIN n na ON na.a = i.a JOIN n nb ON nb.a = i.b""",
)
def set_similarity(spark, sf_dir):
    """Jaccard distance and Dice score of groups that share a member; pairs meet on shared members only."""
    s = _sets(spark, sf_dir)
    n = s.groupBy("a").agg(F.count("*").alias("n"))
    both = s.alias("l").join(s.alias("r"), (F.col("l.x") == F.col("r.x")) & (F.col("l.a") < F.col("r.a"))).groupBy(F.col("l.a").alias("a"), F.col("r.a").alias("b")).agg(F.count("*").alias("common"))
    both = both.join(n.withColumnRenamed("n", "na"), "a").join(n.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    k, total = F.col("common").cast("double"), F.col("na") + F.col("nb")
    return both.select("a", "b", "common", F.round(1 - k / (total - F.col("common")), 9).alias("jaccard_distance"), F.round(2 * k / total, 9).alias("dice"))


@query(
    "positional_zip",
    f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '{PLAIN}') AS ws FROM conversations),
       e AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM w)
       SELECT a.conv_id, a.turn, count(*) AS aligned, count(*) FILTER (a.w = b.w) AS same FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.i = b.i GROUP BY 1, 2""",
)
def positional_zip(spark, sf_dir):
    """Words of each turn and the next aligned by their place."""
    ws = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(PLAIN), F.lit(0)).alias("ws"))
    pair = ws.join(ws.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ws").alias("nxt")), ["conv_id", "turn"])
    n = F.least(F.size("ws"), F.size("nxt"))
    same = F.size(F.filter(F.arrays_zip(F.slice("ws", 1, n), F.slice("nxt", 1, n)), lambda z: z["0"] == z["1"]))
    return pair.where(n > 0).select("conv_id", "turn", n.cast("long").alias("aligned"), same.cast("long").alias("same"))


# -- revisions -------------------------------------------------------------------------------


@query(
    "revision_diff",
    """WITH r AS (SELECT lang, dense_rank() OVER (ORDER BY lang) AS rev FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
       f AS (SELECT rev, md5(unnest(string_split(text, chr(10)))) AS h FROM documents JOIN r USING (lang)),
       c AS (SELECT rev, h, count(*) AS n FROM f GROUP BY rev, h),
       d AS (SELECT coalesce(b.rev, a.rev + 1) AS rev, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'deleted' WHEN a.n = b.n THEN 'unchanged' WHEN a.n < b.n THEN 'changed+' ELSE 'changed-' END AS status
             FROM c a FULL OUTER JOIN c b ON a.rev + 1 = b.rev AND a.h = b.h)
       SELECT rev, status, count(*) AS n FROM d WHERE rev <= (SELECT max(rev) FROM r) GROUP BY rev, status""",
)
def revision_diff(spark, sf_dir):
    """Each language is a revision: status of each line against the revision before, by a full outer join."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    revs = docs.select("lang").distinct().withColumn("rev", F.dense_rank().over(Window.orderBy("lang")))
    lines = docs.join(F.broadcast(revs), "lang").select("rev", F.explode(F.split("text", "\n")).alias("line")).select("rev", F.md5("line").alias("h"))
    c = staged(lines.groupBy("rev", "h").agg(F.count("*").alias("n")), "revisions")
    a, b = c.select((F.col("rev") + 1).alias("rev"), "h", F.col("n").alias("a")), c.select("rev", "h", F.col("n").alias("b"))
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").when(F.col("a") < F.col("b"), "changed+").otherwise("changed-")
    found = a.join(b, ["rev", "h"], "full").groupBy(F.col("rev").cast("long").alias("rev"), status.alias("status")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(c.agg(F.max("rev").alias("last"))), F.col("rev") <= F.col("last"), "left_semi")


@query(
    "incremental_files",
    """SELECT source, count(*) AS files, count(*) FILTER (r > 1) AS reused FROM (SELECT source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) GROUP BY source""",
)
def incremental_files(spark, sf_dir):
    """Files whose checksum was seen before in their source need no new analysis."""
    docs = table(spark, sf_dir, "documents").where("text is not null").groupBy("source", F.md5("text").alias("k")).agg(F.count("*").alias("n"))
    return docs.groupBy("source").agg(F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("reused"))


# -- scalar functions ------------------------------------------------------------------------


@query(
    "identifier_functions",
    r"""SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, list_sort(list_distinct(regexp_split_to_array(lower(p_name), '[ _#]'))) AS parts,
              lower(regexp_replace(p_type || 'Of' || p_brand, '([a-z])([A-Z])', '\1_\2', 'g')) AS snake, levenshtein(p_brand, p_type)::INTEGER AS distance,
              md5(p_name) AS digest, array_to_string(list_transform(string_split(p_name, ' '), lambda x: '''' || x || ''''), ', ') AS quoted,
              greatest(p_size, 25) AS hi, least(p_size, 25) AS lo, string_split(p_name, ' ')[1] AS head, string_split(p_name, ' ')[-1] AS last FROM part""",
)
def identifier_functions(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.upper("p_name").alias("up"), names.words_of(F.col("p_name")).alias("parts"),
        names.snake_case(F.concat("p_type", F.lit("Of"), "p_brand")).alias("snake"), F.levenshtein("p_brand", "p_type").alias("distance"),
        F.md5("p_name").alias("digest"), names.quoted(F.col("p_name")).alias("quoted"),
        F.greatest("p_size", F.lit(25)).alias("hi"), F.least("p_size", F.lit(25)).alias("lo"), F.element_at(words, 1).alias("head"), F.element_at(words, -1).alias("last"),
    )


@query(
    "token_edit_distance",
    """WITH RECURSIVE p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type || ' ' || p_name, ' ') AS b FROM part),
       t AS (SELECT p_partkey, a, b, 0 AS i, range(0, len(b) + 1) AS row FROM p UNION ALL
             SELECT p_partkey, a, b, i + 1, list_reduce(list_prepend([i + 1], list_transform(range(1, len(b) + 1), lambda j: [row[j + 1] + 1, row[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END])),
                    lambda x, y: list_append(x, least(x[-1] + 1, y[1], y[2]))) FROM t WHERE i < len(a))
       SELECT p_partkey, row[-1]::INTEGER AS distance FROM t WHERE i = len(a)""",
)
def token_edit_distance(spark, sf_dir):
    """Edit distance of two lists of words, as two layouts are aligned."""
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", names.line_distance(a, b).alias("distance"))


@query(
    "two_way_map",
    """WITH p AS (SELECT DISTINCT c_mktsegment AS l, c_nationkey AS r FROM customer), n AS (SELECT 'left' AS side, l AS key, count(*) AS n FROM p GROUP BY l UNION ALL SELECT 'right', r::VARCHAR, count(*) FROM p GROUP BY r)
       SELECT * FROM n WHERE n > 1""",
)
def two_way_map(spark, sf_dir):
    """Where a table is no map that can be read both ways."""
    pairs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("left"), F.col("c_nationkey").cast("string").alias("right"))
    return bimap.conflicts(pairs)


# -- graphs ----------------------------------------------------------------------------------

_TRADE_SQL = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                      JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    m AS (SELECT src, max(n) AS most FROM t GROUP BY src), e AS (SELECT src, dst, n FROM t JOIN m USING (src) WHERE 5 * n > 3 * most),
    v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
_CLOSURE = "c AS (SELECT node AS a, node AS b FROM v UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src)"
_SCC = "s AS (SELECT x.a AS node, min(x.b) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


def trade_edges(spark, sf_dir):
    """Which nations' customers buy (nearly) most from which nations' suppliers: 25 nodes at most."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    t = t.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return staged(t.withColumn("most", F.max("n").over(Window.partitionBy("src"))).where(5 * F.col("n") > 3 * F.col("most")).select("src", "dst", "n"), "trade")


@query("graph_closure", f"WITH RECURSIVE {_TRADE_SQL}, {_CLOSURE} SELECT a AS src, b AS dst FROM c")
def graph_closure(spark, sf_dir):
    return graph.closure(trade_edges(spark, sf_dir)).select("src", "dst")


@query("graph_scc", f"WITH RECURSIVE {_TRADE_SQL}, {_CLOSURE}, {_SCC} SELECT node, scc FROM s")
def graph_scc(spark, sf_dir):
    return graph.scc(trade_edges(spark, sf_dir))


@query(
    "graph_components",
    f"""WITH RECURSIVE {_TRADE_SQL}, w AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), k AS (SELECT node AS a, node AS b FROM v UNION SELECT k.a, w.dst FROM k JOIN w ON k.b = w.src)
        SELECT a AS node, min(b) AS label FROM k GROUP BY a""",
)
def graph_components(spark, sf_dir):
    return graph.components(trade_edges(spark, sf_dir))


@query(
    "graph_levels",
    f"""WITH RECURSIVE {_TRADE_SQL}, {_CLOSURE}, {_SCC}, d AS (SELECT DISTINCT x.scc AS src, y.scc AS dst FROM e JOIN s x ON x.node = src JOIN s y ON y.node = dst WHERE x.scc <> y.scc),
        p AS (SELECT DISTINCT scc, 0 AS level FROM s UNION SELECT d.src, p.level + 1 FROM p JOIN d ON d.dst = p.scc)
        SELECT node, s.scc, max(level) AS level FROM s JOIN p ON s.scc = p.scc GROUP BY node, s.scc""",
)
def graph_levels(spark, sf_dir):
    return graph.callee_first(trade_edges(spark, sf_dir))


@query(
    "graph_reaching",
    f"""WITH RECURSIVE {_TRADE_SQL}, {_CLOSURE} SELECT b AS seed, count(*) AS n FROM c WHERE b IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY b""",
)
def graph_reaching(spark, sf_dir):
    """How many nodes reach each node of one region."""
    e = trade_edges(spark, sf_dir)
    seeds = graph.nodes(e).join(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node")), "node", "left_semi")
    return graph.reachable(e, seeds, reverse=True).groupBy("seed").agg(F.count("*").alias("n"))


@query(
    "graph_degrees",
    f"""WITH {_TRADE_SQL} SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS fan_in, (SELECT count(*) FROM e WHERE src = node) AS fan_out FROM v""",
)
def graph_degrees(spark, sf_dir):
    return graph.degrees(trade_edges(spark, sf_dir).select("src", "dst")).select("node", "fan_in", "fan_out")


@query(
    "link_fan_in",
    """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)
       SELECT dst, count(*) AS fan_in FROM l GROUP BY dst HAVING count(*) >= 2""",
)
def link_fan_in(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()
    return links.groupBy("dst").agg(F.count("*").alias("fan_in")).where("fan_in >= 2")


@query("fan_out", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def fan_out(spark, sf_dir):
    """More than N (strict), unlike fan-in, which takes N or more."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 10")


# -- graphs of many nodes --------------------------------------------------------------------

_CHAIN_SQL = "c AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS nxt, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def order_chains(spark, sf_dir):
    """Each order and the customer's next: as many nodes as orders."""
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return staged(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), nxt.alias("dst")).where("dst is not null"), "chains")


@query("graph_order_components", f"WITH {_CHAIN_SQL} SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS label FROM c WHERE n > 1")
def graph_order_components(spark, sf_dir):
    return graph.components(order_chains(spark, sf_dir))


@query("graph_order_levels", f"WITH {_CHAIN_SQL} SELECT o_orderkey AS node, (n - r)::INTEGER AS level FROM c WHERE n > 1")
def graph_order_levels(spark, sf_dir):
    """How many orders follow: the levels of a graph of long chains."""
    e = order_chains(spark, sf_dir)
    return graph.levels(e, graph.nodes(e))


@query("graph_order_reach", f"WITH {_CHAIN_SQL} SELECT o_orderkey AS seed, n AS reached FROM c WHERE r = 1 AND n > 1 AND o_custkey % 10 = 1")
def graph_order_reach(spark, sf_dir):
    """What the first orders of a tenth of the customers (the seeds) reach, over all orders."""
    e = order_chains(spark, sf_dir)
    o = table(spark, sf_dir, "orders").where("o_custkey % 10 = 1")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("node"), F.count("*").alias("n")).where("n > 1").select("node")
    return graph.reachable(e, first).groupBy("seed").agg(F.count("*").alias("reached"))


@query(
    "graph_shared_parts",
    """WITH e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) SELECT s AS node, 0::BIGINT AS fan_in, count(*) AS fan_out FROM e GROUP BY s
       UNION ALL SELECT -1 - p, count(*), 0 FROM e GROUP BY p""",
)
def graph_shared_parts(spark, sf_dir):
    """Degrees in the graph of suppliers and the parts (negative keys) that they deliver."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    return graph.degrees(e).select("node", "fan_in", "fan_out")
