"""What an editor asks of a code base, as tables: which edits apply where, lenses, highlights and semantic tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.operators import lookup
from quercus.sources.stages import Stages

KEY = ["file_id", "f", "a"]
REGION = ["start_line", "start_col", "end_line", "end_col"]
#: Kinds of semantic tokens, by their number.
KINDS = ("variable", "function", "macro", "record", "string", "number")


def _named(s: Stages, df: DataFrame) -> DataFrame:
    return df.join(s.files.select("file_id", "module"), "file_id").drop("file_id")


def actions(s: Stages) -> DataFrame:
    """``module, action``, the region it applies to, and what it is about (``subject``).

    Rename function and move function at definitions; rename variable at each place of one; inline variable at bindings
    ``V = E`` that are used and whose expression applies nothing; extract function at runs of two statements or more;
    new variable and new macro at expressions of several tokens that bind nothing; generalise at numbers and strings.
    """
    n, b = s.ast_nodes, s.bindings
    own = lambda df, action, subject: df.select("file_id", F.lit(action).alias("action"), *REGION, subject.alias("subject"))
    heads = n.where("ctx = 'function.0'")
    names = heads.select("file_id", *REGION, F.concat("f", F.lit("/"), F.col("a").cast("string")).alias("subject"))
    out = [names.select("file_id", F.lit(x).alias("action"), *REGION, "subject") for x in ("rename function", "move function")]
    variables = n.where("type = 'variable'")
    out.append(own(variables.where("f is not null"), "rename variable", F.col("value")))
    match = n.where("type = 'match_expr' and category = 'expression'").select("file_id", F.col("node_id").alias("m"), "pre", "post", *REGION)
    left = variables.where("group_idx = 0").select("file_id", F.col("parent_id").alias("m"), F.col("value").alias("subject"), F.col("start_line").alias("line"), F.col("start_col").alias("col"))
    used = b.where("role = 'use'").select("file_id", F.explode("defs").alias("d")).select("file_id", "d.line", "d.col").distinct()
    effect = n.where("type in ('application', 'receive_expr') or (type = 'infix_expr' and value = '!')").select("file_id", F.col("pre").alias("at"))
    can = match.join(left, ["file_id", "m"]).join(used, ["file_id", "line", "col"], "left_semi")
    busy = can.join(effect, "file_id").where("at > pre and at <= post").select("file_id", "m").distinct()
    out.append(own(can.join(busy, ["file_id", "m"], "left_anti"), "inline variable", F.col("subject")))
    seqs = s.expr_seqs.groupBy("file_id", "f", "a", "seq_id").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n")).where("n > 1")
    out.append(seqs.select("file_id", F.lit("extract function").alias("action"), "start_line", F.lit(1).alias("start_col"), "end_line", F.lit(0).alias("end_col"), F.concat(F.col("n").cast("string"), F.lit(" statements")).alias("subject")))
    binds = b.where("role = 'bind'").select("file_id", "node_id").distinct()
    holds = n.join(binds, ["file_id", "node_id"], "left_semi").select("file_id", F.col("pre").alias("at"))
    large = n.where(lookup.is_expr() & ~F.col("is_leaf") & F.col("type").isin("infix_expr", "tuple", "list", "application"))
    bound = large.join(holds, "file_id").where("at >= pre and at <= post").select("file_id", "node_id").distinct()
    free = large.join(bound, ["file_id", "node_id"], "left_anti")
    out += [own(free, x, F.col("text")) for x in ("new variable", "new macro")]
    out.append(own(n.where(lookup.is_expr() & F.col("type").isin("integer", "float", "string", "char") & F.col("f").isNotNull()), "generalise function", F.col("text")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return _named(s, found).select("module", "action", *REGION, "subject")


def lenses(s: Stages) -> DataFrame:
    """``module, line, title``: a lens above each specification and each function."""
    spec = s.ast_nodes.where("type = 'attribute' and value = 'spec'").select("file_id", F.col("start_line").alias("line"), F.lit("comment out specification").alias("title"))
    form = s.functions.select("file_id", F.col("start_line").alias("line"), F.concat(F.lit("refactor "), "f", F.lit("/"), F.col("a").cast("string")).alias("title"))
    return _named(s, spec.union(form)).select("module", "line", "title")


def highlights(s: Stages, points: DataFrame) -> DataFrame:
    """``module, at_line, at_col, line, col``: all places of the variable at each point (``file_id, line, col``)."""
    hit = lookup.instances(s.bindings, points)
    return _named(s, hit).select("module", "at_line", "at_col", "line", "col")


def semantic_tokens(s: Stages) -> DataFrame:
    """``module, seq, delta_line, delta_col, length, kind``: places relative to the token before, as editors take them.

    ``kind`` is the place in ``KINDS``; a column is relative only on the line of the token before.
    """
    kind = F.when(F.col("type") == "variable", 0).when(F.col("ctx").isin("function.0", "application.0", "module_qualifier.1"), 1).when(F.col("type") == "macro", 2)
    kind = kind.when(F.col("type").isin("record_expr", "record_access"), 3).when(F.col("type") == "string", 4).when(F.col("type").isin("integer", "float"), 5)
    length = F.when(F.col("type").isin("macro", "record_expr"), F.length("value") + 1).otherwise(F.length("text"))
    t = s.ast_nodes.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("is_leaf") | F.col("type").isin("macro", "record_expr"))).select("file_id", "start_line", "start_col", length.alias("length"), "kind").distinct()
    by = Window.partitionBy("file_id").orderBy("start_line", "start_col")
    line, col = F.lag("start_line").over(by), F.lag("start_col").over(by)
    same = F.col("start_line") == line
    out = t.select("file_id", F.row_number().over(by).alias("seq"), (F.col("start_line") - F.coalesce(line, F.lit(1))).alias("delta_line"), (F.col("start_col") - F.when(same, col).otherwise(1)).alias("delta_col"), "length", "kind")
    return _named(s, out).select("module", "seq", "delta_line", "delta_col", "length", "kind")
