"""Comments and the forms they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.sources.stages import Stages
from quercus.sources.tokenizer import tokens


def attached_comments(s: Stages) -> DataFrame:
    """``module, line, value, place, type, node_line``: each comment with the nearest node.

    A comment behind code belongs to the largest node that ends before it on its line (``after``), one on lines of its
    own to the first node that begins below it (``before``), and one below all nodes to none (``end``).
    """
    own = tokens(s.files, layout=True).where("kind = 'comment'").select("file_id", "line", "col", "value")
    n = s.ast_nodes.select("file_id", "start_line", "start_col", "end_line", "end_col", "type", "depth", "pre")
    behind = own.join(n, "file_id").where("end_line = line and end_col < col").groupBy("file_id", "line", "col").agg(F.min_by(F.struct("type", F.col("start_line").alias("node_line")), F.struct(-F.col("end_col"), "depth", "pre")).alias("a"))
    first = n.groupBy("file_id", "start_line").agg(F.min_by(F.struct("type", F.col("start_line").alias("node_line")), F.struct("start_col", "depth")).alias("b"))
    below = own.join(first, "file_id").where("start_line > line").groupBy("file_id", "line", "col").agg(F.min_by("b", "start_line").alias("b"))
    both = own.join(behind, ["file_id", "line", "col"], "left").join(below, ["file_id", "line", "col"], "left").join(s.files.select("file_id", "module"), "file_id")
    place = F.when(F.col("a").isNotNull(), "after").when(F.col("b").isNotNull(), "before").otherwise("end")
    at = F.coalesce("a", "b")
    return both.select("module", "line", "value", place.alias("place"), at["type"].alias("type"), at["node_line"].alias("node_line"))
