"""Trees as tables and their clusters: what two trees share and what each has alone, and how that can be cut into functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.operators import graph
from quercus.plans.staging import staged
from quercus.sources.parser import Node
from quercus.trees.render import render


def breadth_first(nodes: DataFrame) -> DataFrame:
    """``ast_nodes`` with ``rank``: their order in their file, level by level."""
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy("depth", "pre")))


def indexed(nodes: DataFrame, property_: str) -> DataFrame:
    """``file_id``, the property's values, and how many nodes have each: an index of the trees."""
    return nodes.groupBy("file_id", F.col(property_).alias("key")).agg(F.count("*").alias("n"), F.min("pre").alias("first"))


def rebuilt(rows: list) -> Node:
    """A tree from the rows of its nodes (``ast_nodes`` columns): the way back from the table."""
    by = {r["node_id"]: Node(r["type"], r["value"], [], (r["start_line"], r["start_col"]), (r["end_line"], r["end_col"])) for r in rows}
    root = None
    for r in sorted(rows, key=lambda r: r["pre"]):
        if r["parent_id"] in by:
            groups = by[r["parent_id"]].groups
            while len(groups) <= r["group_idx"]:
                groups.append([])
            groups[r["group_idx"]].append(by[r["node_id"]])
        else:
            root = by[r["node_id"]]
    if root is None:
        raise ValueError("no root")
    return root


def rendered(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``file_id, node_id, code``: code made anew from the rows of each tree (``tops``: ``file_id, node_id, pre, post``)."""
    top = tops.select("file_id", F.col("node_id").alias("top"), F.col("pre").alias("lo"), F.col("post").alias("hi"))
    columns = ["node_id", "parent_id", "group_idx", "pre", "type", "value", "start_line", "start_col", "end_line", "end_col"]
    part = nodes.join(top, "file_id").where("pre >= lo and pre <= hi").select("file_id", "top", *columns)

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: (None if pd.isna(v) else int(v) if k in ("parent_id", "node_id", "group_idx", "pre") else v) for k, v in r.items()} for r in pdf.to_dict("records")]
        return pd.DataFrame([(*key, render(rebuilt(rows)))], columns=["file_id", "node_id", "code"])

    return part.groupBy("file_id", "top").applyInPandas(make, "file_id long, node_id int, code string")


def marked(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` (``ast_nodes``) with ``common``: whether the other table has a node of the same type and text."""
    own = right.select("type", "text").distinct().withColumn("common", F.lit(True))
    return left.join(own, ["type", "text"], "left").withColumn("common", F.coalesce("common", F.lit(False)))


def clusters(nodes: DataFrame) -> DataFrame:
    """``file_id, cluster, common, size, frontier``: connected parts of the trees that are common, and that are not.

    An edge of a tree holds two nodes together if both are common, or neither is. ``cluster`` is the part's first node,
    ``frontier`` how many of its edges lead to another part.
    """
    key = F.concat_ws(":", "file_id", "node_id")
    up = nodes.where("parent_id is not null").select(key.alias("dst"), F.concat_ws(":", "file_id", "parent_id").alias("src"), F.col("common").alias("c"))
    of = nodes.select(key.alias("src"), F.col("common").alias("p"))
    edges = staged(up.join(of, "src").select("src", "dst", (F.col("c") == F.col("p")).alias("inside")), "tree-edges")
    label = graph.components(edges.where("inside").select("src", "dst"))
    part = staged(nodes.select(key.alias("node"), "file_id", "node_id", "common").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "tree-parts")
    size = part.groupBy("label").agg(F.first("file_id").alias("file_id"), F.min("node_id").alias("cluster"), F.first("common").alias("common"), F.count("*").alias("size"))
    ends = edges.where("not inside").select(F.explode(F.array("src", "dst")).alias("node")).join(part.select("node", "label"), "node").groupBy("label").agg(F.count("*").alias("frontier"))
    return size.join(ends, "label", "left").select("file_id", "cluster", "common", "size", F.coalesce("frontier", F.lit(0)).cast("long").alias("frontier"))


def blocks(seqs: DataFrame, other: DataFrame) -> DataFrame:
    """``file_id, f, a, seq_id, start, n, common``: runs of statements that the other code has too, and runs that it has not.

    Statements are compared by their generalised text; runs are gaps and islands over their numbers.
    """
    own = other.select("hash").distinct().withColumn("common", F.lit(True))
    s = seqs.select("file_id", "f", "a", "seq_id", "idx", "hash").join(own, "hash", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    at = Window.partitionBy("file_id", "f", "a", "seq_id")
    island = F.row_number().over(at.orderBy("idx")) - F.row_number().over(Window.partitionBy("file_id", "f", "a", "seq_id", "common").orderBy("idx"))
    runs = s.withColumn("island", island).groupBy("file_id", "f", "a", "seq_id", "common", "island")
    return runs.agg(F.min("idx").alias("start"), F.count("*").alias("n")).select("file_id", "f", "a", "seq_id", "start", "n", "common")


def block_interfaces(runs: DataFrame, seqs: DataFrame, bindings: DataFrame) -> DataFrame:
    """``file_id, f, a, start, needs, gives``: variables that a run takes from before and that are used after it, by the lines of its statements."""
    where = seqs.select("file_id", "f", "a", "seq_id", "idx", "start_line", "end_line")
    r = runs.select("file_id", "f", "a", "seq_id", "start", "n").join(where, ["file_id", "f", "a", "seq_id"]).where("idx >= start and idx < start + n")
    r = staged(r.groupBy("file_id", "f", "a", "seq_id", "start").agg(F.min("start_line").alias("lo"), F.max("end_line").alias("hi")), "runs")
    use = bindings.where("role = 'use'").select("file_id", "f", "a", "var", "line", F.explode("defs").alias("d")).select("file_id", "f", "a", "var", "line", F.col("d.line").alias("def"))
    both = r.join(use, ["file_id", "f", "a"])
    needs = both.where("line between lo and hi and (def < lo or def > hi)").groupBy("file_id", "f", "a", "seq_id", "start").agg(F.array_sort(F.collect_set("var")).alias("needs"))
    gives = both.where("def between lo and hi and line > hi").groupBy("file_id", "f", "a", "seq_id", "start").agg(F.array_sort(F.collect_set("var")).alias("gives"))
    key = ["file_id", "f", "a", "seq_id", "start"]
    none = F.array().cast("array<string>")
    return r.join(needs, key, "left").join(gives, key, "left").select("file_id", "f", "a", "start", F.coalesce("needs", none).alias("needs"), F.coalesce("gives", none).alias("gives"))


def argument_names(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``m, f, a, at, name``: a name for each parameter: that of the first clause that has a variable there, else ``Arg`` and its place."""
    key = ["file_id", "f", "a"]
    clause = nodes.where("type = 'clause' and ctx = 'function.1'").select(*key, F.col("node_id").alias("c"))
    part = nodes.where("group_idx = 0").select("file_id", F.col("parent_id").alias("c"), F.col("child_idx").alias("at"), "type", "value", "pre")
    named = clause.join(part, ["file_id", "c"]).groupBy(*key, "at").agg(F.min_by(F.when(F.col("type") == "variable", F.ltrim(F.col("value"), F.lit("_"))), F.struct((F.col("type") != "variable"), "pre")).alias("name"))
    own = functions.where("a > 0").select(*key, "m", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("at"))
    return own.join(named, [*key, "at"], "left").select("m", "f", "a", F.col("at").cast("int").alias("at"), F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Arg"), (F.col("at") + 1).cast("string"))).alias("name"))


def local_calls_redirected(text: str, module: str, moved: set[tuple[str, int]]) -> str:
    """Local calls, implicit funs and ``?MODULE`` calls of functions that live in another module now go there."""
    from quercus.operators.edits import module_of
    from quercus.trees.annotate import name_of
    from quercus.trees.render import splice

    mod = module_of(text)
    edits = []
    for form in mod.forms:
        for n in form.walk() if form.type == "function" else ():
            if n.type == "application":
                op = n.groups[0][0]
                if op.type == "atom" and (op.value, len(n.groups[1])) in moved:
                    edits.append((op.lo, op.lo, f"{module}:"))
                elif op.type == "module_qualifier" and op.groups[0][0].type == "macro" and op.groups[0][0].value == "MODULE" and (name_of(op.groups[1][0]), len(n.groups[1])) in moved:
                    edits.append((op.groups[0][0].lo, op.groups[0][0].hi, module))
            elif n.type == "implicit_fun" and len(n.groups[0]) == 2 and (name_of(n.groups[0][0]), int(n.groups[0][1].value)) in moved:
                edits.append((n.groups[0][0].lo, n.groups[0][0].lo, f"{module}:"))
    return splice(text, edits)


def walk_fold(n: Node, step, state):
    """Folds over a tree with a state that goes from node to node, each before its children; the new tree and the last state."""
    new, state = step(n, state)
    groups = []
    for g in new.groups:
        out = []
        for c in g:
            c, state = walk_fold(c, step, state)
            out.append(c)
        groups.append(out)
    return Node(new.type, new.value, groups, new.start, new.end, new.lo, new.hi, dict(new.info)), state


def fold_groups(groups: list[list], step, state):
    """Folds over lists of lists in order."""
    for g in groups:
        for x in g:
            state = step(x, state)
    return state


def statements(n: Node) -> Iterator[list[Node]]:
    """All runs of neighbouring statements below a node, the longest first at each place: what extended traversals look at."""
    from quercus.trees.annotate import sequences

    for seq in sequences(n):
        for a in range(len(seq)):
            for b in range(len(seq), a, -1):
                yield seq[a:b]
