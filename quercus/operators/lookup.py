"""Positions, intervals and traversals on the ``ast_nodes`` stage table.

Nodes carry pre/post numbers, so "below" is an interval test; all joins are equi-joins on the
file (and the function, where both sides have one) with the interval as the further condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _start() -> Column:
    return F.struct("start_line", "start_col")


def _end() -> Column:
    return F.struct("end_line", "end_col")


def is_expr() -> Column:
    return F.col("category").isin("expression", "guard_expression")


def is_pattern() -> Column:
    return F.col("category") == "pattern"


def is_guard() -> Column:
    return F.col("category") == "guard_expression"


def is_literal() -> Column:
    return F.col("type").isin("integer", "float", "char", "string", "atom", "nil")


def legal_variable(name: Column) -> Column:
    return name.rlike("^[A-Z_][A-Za-z0-9_@]*$")


def legal_function(name: Column) -> Column:
    return name.rlike("^[a-z][A-Za-z0-9_@]*$")


def contains(a: str, b: str) -> Column:
    """Range a encloses range b."""
    s = lambda x, k: F.struct(F.col(f"{x}.{k}_line"), F.col(f"{x}.{k}_col"))
    return (s(a, "start") <= s(b, "start")) & (s(b, "end") <= s(a, "end"))


def overlaps(a: str, b: str) -> Column:
    return contains(a, b) | contains(b, a)


def _file_points(nodes: DataFrame, points: DataFrame) -> DataFrame:
    at = F.struct("line", "col")
    return nodes.join(points, "file_id").where((_start() <= at) & (at <= _end()))


def at_position(nodes: DataFrame, points: DataFrame, pred: Column) -> DataFrame:
    """For each point (``file_id, line, col``) the outermost node around it that satisfies ``pred``."""
    hit = _file_points(nodes, points).where(pred)
    keep = [c for c in nodes.columns if c != "file_id"]
    best = hit.groupBy("file_id", "line", "col").agg(F.min_by(F.struct(*keep), F.struct("depth", "pre")).alias("n"))
    return best.select("file_id", "line", "col", "n.*")


def in_range(nodes: DataFrame, ranges: DataFrame, pred: Column) -> DataFrame:
    """For each range (``file_id, from_line, from_col, to_line, to_col``) the largest leftmost node inside it."""
    lo, hi = F.struct("from_line", "from_col"), F.struct("to_line", "to_col")
    hit = nodes.join(ranges, "file_id").where((lo <= _start()) & (_end() <= hi)).where(pred)
    keep = [c for c in nodes.columns if c != "file_id"]
    best = hit.groupBy(*ranges.columns).agg(F.min_by(F.struct(*keep), F.struct("depth", "pre")).alias("n"))
    return best.select(*ranges.columns, "n.*")


def expressions_in(nodes: DataFrame, ranges: DataFrame, patterns: bool = False) -> DataFrame:
    """The outermost expressions in each range that share a parent and a group, in order."""
    lo, hi = F.struct("from_line", "from_col"), F.struct("to_line", "to_col")
    pred = is_expr() | is_pattern() if patterns else is_expr()
    hit = nodes.join(ranges, "file_id").where((lo <= _start()) & (_end() <= hi)).where(pred)
    own = hit.groupBy(*ranges.columns, "parent_id", "group_idx").agg(F.min(F.struct("depth", "pre")).alias("d"), F.array_sort(F.collect_list(F.struct("child_idx", "text"))).alias("x"))
    best = own.groupBy(*ranges.columns).agg(F.min_by("x", "d").alias("x"))
    return best.select(*ranges.columns, F.col("x.text").alias("expressions"))


def function_at(functions: DataFrame, points: DataFrame) -> DataFrame:
    """``file_id, line, m, f, a`` of the function around each point."""
    return functions.join(points, "file_id").where("start_line <= line and line <= end_line").select("file_id", "line", "m", "f", "a")


def instances(bindings: DataFrame, points: DataFrame) -> DataFrame:
    """All places of the variable under each point: those that share a definition with it."""
    own = bindings.join(points, ["file_id", "line", "col"]).select("file_id", F.col("line").alias("at_line"), F.col("col").alias("at_col"), F.explode("defs").alias("d"))
    all_ = bindings.select("file_id", "var", "role", "line", "col", F.explode("defs").alias("d"))
    return own.join(all_, ["file_id", "d"]).select("file_id", "at_line", "at_col", "var", "role", "line", "col").distinct()


def below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes strictly below each of ``tops``: all columns of the node and ``top_id``."""
    t = tops.select("file_id", F.col("node_id").alias("top_id"), F.col("pre").alias("t_pre"), F.col("post").alias("t_post"))
    return nodes.join(t, "file_id").where("pre > t_pre and post <= t_post").drop("t_pre", "t_post")


def outermost(hits: DataFrame) -> DataFrame:
    """Stopping traversal: hits that are not below another hit."""
    o = hits.select("file_id", F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    inner = hits.join(o, "file_id").where("pre > o_pre and post <= o_post").select("file_id", "pre").distinct()
    return hits.join(inner, ["file_id", "pre"], "left_anti")


def first(hits: DataFrame) -> DataFrame:
    """Once: the first hit of each file in pre-order."""
    keep = [c for c in hits.columns if c != "file_id"]
    return hits.groupBy("file_id").agg(F.min_by(F.struct(*keep), "pre").alias("n")).select("file_id", "n.*")


def free_and_exported(nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """``file_id, node_id, free, bound, exported``: variables of each node (give a filtered ``nodes``)."""
    n = nodes.select("file_id", F.col("node_id").alias("id"), "pre", "post", "f", "a")
    b = bindings.select("file_id", F.col("node_id").alias("v"), "role", "var", "f", "a", F.explode_outer("defs").alias("d"))
    place = bindings.where("role = 'bind'").select("file_id", F.col("node_id").alias("def_id"), F.struct("line", "col").alias("d"))
    b = b.join(place, ["file_id", "d"], "left")
    inside, def_inside = F.col("v").between(F.col("pre"), F.col("post")), F.coalesce(F.col("def_id").between(F.col("pre"), F.col("post")), F.lit(False))
    j = n.join(b, ["file_id", "f", "a"])
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("var"))))
    return j.groupBy("file_id", F.col("id").alias("node_id")).agg(
        names(inside & (F.col("role") == "use") & ~def_inside).alias("free"), names(inside & (F.col("role") == "bind")).alias("bound"), names((F.col("v") > F.col("post")) & def_inside).alias("exported")
    )
