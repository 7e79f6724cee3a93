"""Operators on directed graphs given as edge tables ``src, dst``.

Loops are driver loops over written tables that end when nothing changes, never
after a fixed number of rounds. A round is a join and an aggregate, and no round
holds more rows than nodes or edges, except for ``reachable`` and ``closure``,
whose result is pairs by definition. Nothing but one row of counts comes to the
driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.plans.staging import discard, staged

TASK_ROWS = 1 << 20  # edges that one task holds at most, about: without it, the fewer partitions the more
COMPACT = 16  # tables that a growing union holds before they are written as one


class _Grown:
    """A union of written tables that grows by rounds without a plan that grows with them."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) == COMPACT:
            self.parts = [staged(self.frame(), "grown")]

    def frame(self) -> DataFrame:
        out = self.parts[0]
        for x in self.parts[1:]:
            out = out.unionByName(x)
        return out


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def without(edges: DataFrame, not_care: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes (column ``node``)."""
    gone = not_care.select("node").distinct()
    return edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")


def induced(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    keep = own.select("node").distinct()
    return edges.join(keep, F.col("src") == F.col("node"), "left_semi").join(keep, F.col("dst") == F.col("node"), "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out`` over different edges, dealt out by both ends first: as many tasks as the edges need."""
    e = edges.select("src", "dst")
    parts = e.count() // TASK_ROWS + 1
    e = (e.repartition(parts, "src", "dst") if parts > 1 else e).distinct()
    both = e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def reachable(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """``seed, node``: what each seed (column ``node``) reaches, itself included; only new pairs go on.

    Nodes with one way on are followed by doubled jumps, so a chain of n nodes takes log n rounds; at the others a round
    goes one edge on. Pairs that are known are never broadcast.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = staged(edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct(), "steps")
    ways = step.groupBy("at").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    jumps = [staged(ways.where("n = 1 and at <> to").select("at", "to"), "jumps")]
    forks = staged(step.join(ways.where("n > 1").select("at"), "at", "left_semi"), "forks")
    front = staged(seeds.select(F.col("node").alias("seed"), "node").distinct(), "front")
    seen = _Grown()

    def onward(front: DataFrame, by: DataFrame) -> DataFrame:
        new = front.join(by, F.col("node") == F.col("at")).select("seed", F.col("to").alias("node")).distinct()
        return staged(new.join(seen.frame().hint("merge"), ["seed", "node"], "left_anti"), "front")

    while not front.isEmpty():
        far, k = [front], 0
        seen.add(front)
        while True:  # far holds the ways of fewer than 2^k jumps; if as many more bring nothing, none do
            if k == len(jumps):
                was = jumps[-1]
                jumps.append(staged(was.alias("p").join(was.alias("q"), F.col("p.to") == F.col("q.at")).select("p.at", "q.to"), "jumps"))
            if jumps[k].isEmpty():
                break
            new = onward(reduce(DataFrame.union, far), jumps[k])
            if new.isEmpty():
                break
            far.append(new)
            seen.add(new)
            k += 1
        front = onward(reduce(DataFrame.union, far), forks)
    return seen.frame() if seen.parts else front


def closure(edges: DataFrame) -> DataFrame:
    """Reflexive and transitive closure, by doubling the path length each round."""
    own = nodes(edges)
    pairs, was = staged(edges.select("src", "dst").union(own.select("node", "node")).distinct(), "closure"), -1
    while (count := pairs.count()) != was:
        was = count
        nxt = pairs.alias("p").join(pairs.alias("q"), F.col("p.dst") == F.col("q.src")).select("p.src", "q.dst").distinct()
        before, pairs = pairs, staged(nxt, "closure")
        discard(before)
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: weakly connected components, by the smallest node.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by doubling, and goes on with
    the edges between different roots only. Two rounds at least halve the nodes that have edges, so all rounds together
    move a small multiple of the first; the labels are read back through the rounds.
    """
    apart = F.coalesce(F.col("src") != F.col("dst"), F.lit(False))
    pairs = staged(edges.where(apart).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
    alone = nodes(edges.where(~apart)).where("node is not null").select("node", F.col("node").alias("label"))
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.select("src", "dst").union(pairs.select("dst", "src"))
        up = staged(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("label"), F.lit(True).alias("moved")), "hooks")
        while not up.where("moved").isEmpty():
            on = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            nxt = staged(up.join(on, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "hooks")
            discard(up)
            up = nxt
        rounds.append(up.select("node", "label"))
        a, b = up.select(F.col("node").alias("src"), F.col("label").alias("a")), up.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        left = pairs.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        before, pairs = pairs, staged(left, "pairs")
        discard(before)
    if not rounds:
        return alone
    found = rounds.pop()
    while rounds:
        last = found.select(F.col("node").alias("label"), F.col("label").alias("root"))
        found = staged(rounds.pop().join(last, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    return found.union(alone.join(found, "node", "left_anti"))


def _least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the edges; only labels that fell go on."""
    labels = front = staged(labels, "labels")
    while True:
        sent = edges.join(front, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
        nxt = staged(labels.join(sent, "node", "left").select("node", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("fell")), "labels")
        labels, front = nxt.select("node", "label"), nxt.where("fell").select("node", "label")
        if front.isEmpty():
            return labels


def scc(edges: DataFrame) -> DataFrame:
    """``node, scc``: strongly connected components, named by their smallest node.

    Nodes without a way in or out among the rest are components of their own and go first. Then colouring: each
    node takes the smallest node that reaches it; what reaches that root within its colour is the root's component.
    Components found are set aside and the rest is coloured again.
    """
    left_edges = staged(edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    left = staged(nodes(edges), "scc-nodes")
    found = _Grown()
    while not left.isEmpty():
        inside = left.join(left_edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").join(left_edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
        inside = staged(inside, "scc-core")
        ends = staged(left.join(inside, "node", "left_anti").select("node", F.col("node").alias("scc")), "scc-ends")
        if not ends.isEmpty():
            found.add(ends)
            left, left_edges = inside, staged(induced(left_edges, inside), "scc-edges")
            continue
        colour = _least(left.select("node", F.col("node").alias("label")), left_edges)
        c1, c2 = colour.select(F.col("node").alias("src"), F.col("label").alias("c1")), colour.select(F.col("node").alias("dst"), F.col("label").alias("c2"))
        back = staged(left_edges.join(c1, "src").join(c2, "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        own = staged(_marked(colour.where("node = label"), back).select("node", F.col("label").alias("scc")), "scc")
        found.add(own)
        left = staged(left.join(own, "node", "left_anti"), "scc-nodes")
        left_edges = staged(induced(left_edges, left), "scc-edges")
    return found.frame() if found.parts else left.select("node", F.col("node").alias("scc"))


def _marked(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes reached from the seeds with the label they bring; each node is reached from one seed only."""
    front, seen = staged(seeds.select("node", "label"), "front"), _Grown()
    while not front.isEmpty():
        seen.add(front)
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label").distinct()
        front = staged(new.join(seen.frame(), "node", "left_anti"), "front")
    return seen.frame() if seen.parts else front


def condensation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components, without those inside one."""
    a, b = labels.select(F.col("node").alias("src"), F.col("scc").alias("a")), labels.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def cyclic(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``scc`` of components with a cycle: of several nodes, or of one that has an edge to itself."""
    several = labels.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    own = edges.where("src = dst").join(labels, F.col("src") == F.col("node")).select("scc")
    return several.union(own).distinct()


def levels(edges: DataFrame, own: DataFrame) -> DataFrame:
    """``node, level`` of an acyclic graph, callees first: 0 without callees, else one more than the highest callee."""
    left, left_edges = staged(own.select("node").distinct(), "level-nodes"), staged(edges.select("src", "dst").distinct(), "level-edges")
    out, level = _Grown(), 0
    while not left.isEmpty():
        ready = staged(left.join(left_edges, F.col("node") == F.col("src"), "left_anti").select("node", F.lit(level).alias("level")), "levels")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        out.add(ready)
        left = staged(left.join(ready, "node", "left_anti"), "level-nodes")
        left_edges = staged(left_edges.join(ready, F.col("dst") == F.col("node"), "left_anti"), "level-edges")
        level += 1
    return out.frame() if out.parts else left.select("node", F.lit(0).alias("level"))


def callee_first(edges: DataFrame) -> DataFrame:
    """``node, scc, level``: the order in which every function comes after what it calls."""
    labels = staged(scc(edges))
    order = levels(condensation(edges, labels), labels.select(F.col("scc").alias("node")))
    return labels.join(order.select(F.col("node").alias("scc"), "level"), "scc").select("node", "scc", "level")


def components_of(edges: DataFrame, labels: DataFrame, own: DataFrame) -> DataFrame:
    """``node, scc``: all members of the components (``labels`` as from :func:`scc`) that hold one of ``own`` (column ``node``)."""
    hit = labels.join(own.select("node").distinct(), "node", "left_semi").select("scc").distinct()
    return labels.join(hit, "scc", "left_semi").select("node", "scc")


def inside_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose two ends are in one component of several nodes."""
    a, b = labels.select(F.col("node").alias("src"), F.col("scc").alias("a")), labels.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a = b and src <> dst").drop("a", "b")


def into(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Edges that end in one of ``own`` (column ``node``)."""
    return edges.join(own.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(edges.columns)


def short_cycles(edges: DataFrame) -> DataFrame:
    """``cycle``: one shortest cycle through each node of a cyclic component, however long, equal sets once.

    Walks stay inside a component and begin at its nodes. A round goes on only to ends that no shorter walk of the
    same start has reached, by the smallest path, so each start and end has one row in all and the search ends.
    """
    labels = staged(scc(edges), "cycle-labels")
    a, b = labels.select(F.col("node").alias("src"), F.col("scc").alias("a")), labels.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    inside = staged(edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst").distinct(), "cycle-edges")
    front = staged(inside.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("path")), "walks")
    seen, done = _Grown(), _Grown()
    seen.add(front.select("start", "at"))
    done.add(staged(front.where("at = start").select("start", "path"), "cycles"))
    while not front.isEmpty():
        rest = front.join(done.frame(), "start", "left_anti")
        step = rest.join(inside, F.col("at") == F.col("src")).groupBy("start", F.col("dst").alias("at")).agg(F.min(F.array_append("path", F.col("src"))).alias("path"))
        front = staged(step.join(seen.frame(), ["start", "at"], "left_anti"), "walks")
        seen.add(front.select("start", "at"))
        done.add(staged(front.where("at = start").select("start", "path"), "cycles"))
    return done.frame().select(F.array_sort("path").alias("cycle")).distinct()


def weakest_links(weighted: DataFrame, cycles: DataFrame) -> DataFrame:
    """``cycle, src, dst, weight``: of the edges between nodes of each cycle the one with the least weight."""
    pairs = cycles.select("cycle", F.explode("cycle").alias("src")).join(weighted, "src").where(F.array_contains("cycle", F.col("dst")))
    best = pairs.groupBy("cycle").agg(F.min(F.struct("weight", "src", "dst")).alias("w"))
    return best.select("cycle", "w.src", "w.dst", "w.weight")


def dot(edges: DataFrame, label: str | None = None, mark: str | None = None) -> DataFrame:
    """``line``: the lines of a graph description, edges in any order between the first and last; edges with ``mark`` in red."""
    text = F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('"'))
    looks = [F.concat(F.lit('label="'), F.col(label).cast("string"), F.lit('"'))] if label else []
    looks += [F.when(F.col(mark), "color=red")] if mark else []
    inner = F.concat_ws(", ", *looks) if looks else F.lit("")
    text = F.concat(text, F.when(inner != "", F.concat(F.lit(" ["), inner, F.lit("]"))).otherwise(""), F.lit(";"))
    one = edges.sparkSession.range(1)
    lines = edges.select(F.lit(1).alias("k"), text.alias("line"))
    return one.select(F.lit(0).alias("k"), F.lit("digraph g {").alias("line")).union(lines).union(one.select(F.lit(2), F.lit("}")))


def label_size(label) -> tuple:
    """Columns: the width (longest line) and height (lines) of a label's box."""
    lines = F.split(label, "\n")
    return F.array_max(F.transform(lines, F.length)).alias("width"), F.size(lines).alias("height")
