"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its number of tokens and its first three tokens, tokens with
digits generalised. Within a leaf, a token stays part of the template where at
least half of the leaf's different lines have it at that place; if enough of
the line's tokens stay, the line belongs to the generalised template. The lines
that are left part once more, by their token at the place that has the fewest
different ones in the leaf, and each part is judged alike: so a leaf can hold
several templates. What is left then is a template of its own. Lines of few
tokens are compared by their own text, as little would remain of a template.
Templates that recur in ``min_docs`` documents are dropped but for their first
line. Built of DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import MAYBE, bitmap, disposable, join_skewed, may_hold, written

MIN_TOKENS, MIN_DOCS, DEPTH, STAY = 5, 3, 3, 0.6
ANY = "<*>"
WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
NO_DIGIT = r"(?<![^ ])[^ 0-9]++(?![^ ])"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, line, leaf, own`` of each line that is not blank; ``line`` is generalised, one space between tokens.

    A line of few tokens is its own leaf, and left exact where every token holds a digit, as nothing else would
    remain (numbers, URLs, text without spaces). The costly replacements run only on texts and lines that need them.
    """
    text = F.col(text_col)
    other = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    plain = F.when(other, F.translate(text, "\t\r\x0b\x0c", "    ")).otherwise(text)
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    general = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", WITH_DIGIT, F.lit(ANY))).otherwise(F.col("line"))
    general = F.when((size < MIN_TOKENS) & ~F.col("line").rlike(NO_DIGIT), F.col("line")).otherwise(general)
    lines = lines.select("id", "pos", general.alias("line"), size.alias("n"))
    leaf = F.when(F.col("n") < MIN_TOKENS, F.xxhash64("line", "n")).otherwise(F.xxhash64("n", F.substring_index("line", " ", DEPTH)))
    return lines.select("id", "pos", "line", leaf.alias("leaf"), F.xxhash64("line").alias("own"))


def _enough(common: Column, n: Column) -> Column:
    """Whether a template keeps enough places: of all, and of those after the leading ones, which any leaf shares."""
    return (common >= F.ceil(n * STAY)) & (2 * (common - DEPTH) >= n - DEPTH)


def _part(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of different lines (``leaf, own, rows, t``: token hashes) those of generalised templates, and the others parted again.

    Tokens are counted per place; a place keeps its most frequent token (two, where they share it equally)
    if half of the leaf's lines have it.
    """
    tokens = lines.select("leaf", F.posexplode("t").alias("i", "token"))
    count = tokens.groupBy("leaf", "i", "token").agg(F.count("*").alias("k"))
    place = count.groupBy("leaf", "i").agg(F.sum("k").alias("total"), F.count("*").alias("kinds"), F.max(F.struct("k", "token")).alias("hi"), F.min(F.struct(-F.col("k"), "token")).alias("lo"))
    half = 2 * F.col("hi.k") >= F.col("total")
    split = F.when((F.col("i") >= DEPTH) & (F.col("kinds") > 1), F.struct("kinds", "i"))
    place = place.select("leaf", "i", "total", split.alias("split"), F.when(half, F.col("hi.token")).alias("a"), F.when(half, F.col("lo.token")).alias("b"))
    places = F.array_sort(F.collect_list(F.struct("i", "a", "b")))
    whole = place.groupBy("leaf").agg(F.max("total").alias("total"), F.min("split").alias("split"), places.alias("places"))
    met = join_skewed(lines, whole.select("leaf", "total", F.col("split.i").alias("pivot"), "places"), "leaf", "total")
    kept = F.zip_with("t", "places", lambda x, p: F.when((x == p["a"]) | (x == p["b"]), x))
    met = met.select("leaf", "own", "rows", "t", "pivot", kept.alias("kept"))
    met = written(met.withColumn("ok", _enough(F.size(F.filter("kept", lambda x: x.isNotNull())), F.size("t"))), "line-parted")
    found = met.where("ok").select("own", "rows", F.xxhash64("leaf", F.transform("kept", lambda x: F.coalesce(x, F.lit(0)))).alias("tmpl"))
    rest = met.where("not ok").select(F.xxhash64("leaf", "pivot", F.get("t", F.col("pivot"))).alias("leaf"), "own", "rows", "t")
    return found, rest


def _several(lines: DataFrame) -> DataFrame:
    """Lines of the leaves with three or more: where there are two, each token is in half of them, and each is its own template."""
    return lines.join(lines.groupBy("leaf").agg(F.count("*").alias("q_n")).where("q_n > 2").select("leaf"), "leaf", "left_semi")


@disposable
def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, drop``: the places (from 0) of the lines to drop, for documents that have some.

    A template recurs only if its leaf is in ``min_docs`` documents.
    """
    rows = written(_lines(docs, id_col, text_col), "lines")
    pairs = rows.groupBy("leaf").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b or %d < 2" % min_docs)
    near = may_hold(rows, "leaf", written(bitmap(pairs, "leaf"), "line-pair-bits")).where(MAYBE).drop(MAYBE)
    leaf = near.groupBy("leaf").agg(F.countDistinct("id").alias("docs"), F.countDistinct("own").alias("lines")).where(F.col("docs") >= min_docs)
    leaf = written(leaf.select("leaf", (F.col("lines") > 2).alias("several")), "line-leaves")
    several = leaf.where("several").select("leaf")
    lines = may_hold(rows, "leaf", written(bitmap(several, "leaf"), "line-leaf-bits")).where(MAYBE)
    lines = lines.groupBy("leaf", "own").agg(F.min("line").alias("line"), F.count("*").alias("rows")).join(several, "leaf", "left_semi")
    lines = written(lines.select("leaf", "own", "rows", F.transform(F.split("line", " "), lambda x: F.xxhash64(x)).alias("t")), "line-different")
    first, rest = _part(lines)
    second, _ = _part(written(_several(rest), "line-second"))
    tmpl = first.union(second)
    rows = may_hold(rows, "leaf", written(bitmap(leaf, "leaf"), "line-bits")).where(MAYBE).select("id", "pos", "leaf", "own")
    rows = join_skewed(rows, tmpl, "own", "rows", left=True).select("id", "pos", F.coalesce("tmpl", F.xxhash64("leaf", "own")).alias("tmpl"))
    rows = written(rows, "line-rows")
    once = rows.groupBy("tmpl", "id").agg(F.min("pos").alias("pos"), F.count("*").alias("rows"))
    many = once.groupBy("tmpl").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.min(F.struct("id", "pos")).alias("first")).where(F.col("n") >= min_docs)
    drop = join_skewed(rows, many.select("tmpl", "rows", "first"), "tmpl", "rows").where((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")))
    return written(drop.groupBy("id").agg(F.collect_set("pos").alias("drop")), "line-drop")


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the lines of recurring templates, and ``n_lines, dropped_lines``
    (with ``_`` added where such columns are there already).

    Every row stays; a text may become empty. Rows with one id count as one document and lose the same places; rows
    with a null id are left alone. A null text stays null (null counts), an empty one has one line; blank lines stay.
    A very long text is read whole. The first line of a template is that of the smallest id, then of the smallest
    place; tokens that tie at a place both stay. An empty table gives no rows.
    """
    names = docs.columns
    drop = repeated_lines(docs, min_docs, id_col, text_col)
    new = []
    for n in ("n_lines", "dropped_lines", "line_id", "line_drop"):
        while n in names:
            n += "_"
        new.append(n)
    lines, dropped, key, where = new
    known = may_hold(docs, id_col, written(bitmap(drop, "id"), "line-doc-bits"))
    parts = F.split(text_col, "\n")
    # the lists grow with the input: a merge join at every size, never a broadcast that happens to fit
    hit = known.where(MAYBE).join(drop.withColumnsRenamed({"id": key, "drop": where}).hint("merge"), F.col(id_col) == F.col(key), "left")
    hit = hit.withColumn(lines, F.size(parts).cast("long")).withColumn(dropped, F.coalesce(F.size(where), F.lit(0)).cast("long"))
    left = F.array_join(F.filter(parts, lambda x, i: ~F.coalesce(F.array_contains(F.col(where), i), F.lit(False))), "\n")
    rest = known.where(~F.col(MAYBE)).withColumn(lines, F.size(parts).cast("long")).withColumn(dropped, F.lit(0).cast("long"))
    out = [*names, lines, dropped]
    null = F.col(text_col).isNull()
    done = hit.withColumn(text_col, F.when(F.col(dropped) > 0, left).otherwise(F.col(text_col))).select(out).unionAll(rest.select(out))
    return done.withColumns({lines: F.when(~null, F.col(lines)), dropped: F.when(~null, F.col(dropped))})


def _sql_round(k: int, lines: str) -> str:
    """Templates of the different lines in table ``lines`` (leaf, own, t), and the leaves of those that are left."""
    enough = f"count(*) >= ceil(n * {STAY}) AND 2 * (count(*) - {DEPTH}) >= n - {DEPTH}"
    return f"""n{k} AS (SELECT leaf, count(*) AS total FROM {lines} GROUP BY leaf),
    k{k} AS (SELECT leaf, own, len(t) AS n, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token FROM {lines}),
    f{k} AS (SELECT leaf, i, token, count(*) AS k FROM k{k} GROUP BY leaf, i, token),
    c{k} AS (SELECT leaf, i, token FROM f{k} JOIN n{k} USING (leaf) WHERE 2 * k >= total),
    g{k} AS (SELECT own, {k} || '/' || leaf || '/' || string_agg(i || '=' || token, ' ' ORDER BY i) AS tmpl
          FROM k{k} JOIN c{k} USING (leaf, i, token) GROUP BY leaf, own, n HAVING {enough}),
    p{k} AS (SELECT leaf, arg_min(i, struct_pack(kinds := kinds, i := i)) AS place FROM (SELECT leaf, i, count(*) AS kinds FROM f{k} WHERE i > {DEPTH} GROUP BY leaf, i HAVING count(*) > 1) GROUP BY leaf),
    r{k} AS (SELECT leaf || '/' || place || '/' || t[place] AS leaf, own, t FROM {lines} JOIN p{k} USING (leaf) WHERE own NOT IN (SELECT own FROM g{k})),"""


#: The same with text keys in place of hashes, for the given parameters.
SQL = rf"""WITH l AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
                      FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    t AS (SELECT doc_id, pos, string_split(trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')), ' ') AS w FROM l),
    t2 AS (SELECT doc_id, pos, CASE WHEN len(w) < {MIN_TOKENS} AND len(list_filter(w, lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]'))) = 0 THEN w
                 ELSE list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{ANY}' ELSE x END) END AS t FROM t WHERE len(w) > 1 OR w[1] <> ''),
    x AS (SELECT doc_id, pos, t, array_to_string(t, ' ') AS own,
                 CASE WHEN len(t) < {MIN_TOKENS} THEN 'own ' || array_to_string(t, ' ') ELSE len(t) || ' ' || array_to_string(t[1:{DEPTH}], ' ') END AS leaf FROM t2),
    s AS (SELECT leaf FROM x GROUP BY leaf HAVING min(doc_id) < max(doc_id) AND min(own) < max(own)),
    d AS (SELECT DISTINCT leaf, own, t FROM x JOIN s USING (leaf)),
    {_sql_round(1, "d")}
    {_sql_round(2, "r1")}
    g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2),
    r AS (SELECT doc_id, pos, coalesce(tmpl, 'own/' || x.own) AS tmpl FROM x LEFT JOIN g ON x.own = g.own),
    m AS (SELECT tmpl, count(DISTINCT doc_id) AS docs, arg_min(struct_pack(d := doc_id, p := pos), struct_pack(d := doc_id, p := pos)) AS first
          FROM (SELECT r.tmpl, doc_id, pos FROM r) GROUP BY tmpl),
    z AS (SELECT DISTINCT doc_id, pos FROM r JOIN m USING (tmpl) WHERE docs >= {MIN_DOCS} AND NOT (doc_id = first.d AND pos = first.p))
    SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE z.pos IS NULL), '') AS text,
           count(*) AS n_lines, count(z.pos) AS dropped_lines
    FROM l LEFT JOIN z ON l.doc_id = z.doc_id AND l.pos = z.pos GROUP BY l.doc_id"""
