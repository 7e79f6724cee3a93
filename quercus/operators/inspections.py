"""Read-only inspections of a code base, on its stage tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.operators import graph
from quercus.operators.pattern import Collector, Context, FunApply, collect
from quercus.plans.staging import staged
from quercus.sources.parser import Node
from quercus.sources.stages import Stages, mfa
from quercus.sources.tokenizer import tokens

KEY = ["file_id", "f", "a"]
CALLBACK = {"gen_server": "init/1 handle_call/3 handle_cast/2 handle_info/2 terminate/2 code_change/3", "gen_fsm": "init/1 handle_event/3 handle_sync_event/4 handle_info/3 terminate/3 code_change/4", "gen_event": "init/1 handle_event/2 handle_call/2 handle_info/2 terminate/2 code_change/3", "supervisor": "init/1", "application": "start/2 stop/1"}


def long_functions(s: Stages, lines: int) -> DataFrame:
    """More than ``lines`` lines that carry a token (strict)."""
    return s.functions.where(F.col("code_lines") > lines).select("m", "f", "a", "code_lines")


def large_modules(s: Stages, lines: int) -> DataFrame:
    """At least ``lines`` lines that carry a token (inclusive)."""
    per = tokens(s.files).groupBy("file_id").agg(F.countDistinct("line").alias("code_lines"))
    return per.where(F.col("code_lines") >= lines).join(s.files.select("file_id", "module"), "file_id").select("module", "code_lines")


def nested(s: Stages, kind: str, depth: int) -> DataFrame:
    """Functions with ``kind`` (case, if or receive) expressions nested ``depth`` or more deep.

    An expression opens at its first node and closes after its last; how many are open is a running sum.
    """
    n = s.ast_nodes.where(F.col("type") == f"{kind}_expr").select(*KEY, "pre", "post")
    events = n.select(*KEY, (2 * F.col("pre")).alias("at"), F.lit(1).alias("step")).union(n.select(*KEY, 2 * F.col("post") + 1, F.lit(-1)))
    level = F.sum("step").over(_by(*KEY).orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("level", level).groupBy(*KEY).agg(F.max("level").alias("level")).where(F.col("level") >= depth).join(s.files.select("file_id", "module"), "file_id").select("module", "f", "a", "level")


def callers(s: Stages, m: str, f: str, a: int) -> DataFrame:
    """Functions that surely refer to m:f/a, and those that may (a call whose module is not known)."""
    sure = (F.col("callee_m") == m) & F.col("sure")
    may = F.col("callee_m").isNull() & F.coalesce(F.col("callee_f") == f, F.lit(True))
    hit = s.calls.where((F.coalesce(F.col("callee_f") == f, F.lit(False)) & F.coalesce(F.col("callee_a") == a, F.lit(False)) & F.coalesce(sure, F.lit(False))) | (may & (F.col("shape") == "dynamic")))
    return hit.groupBy(mfa("m", "f", "a").alias("caller")).agg(F.max(F.coalesce(sure, F.lit(False))).alias("sure"))


def dependencies(s: Stages, module: str) -> DataFrame:
    """``kind, module``: clients and servers of a module."""
    e = s.module_edges
    return e.where(F.col("dst") == module).select(F.lit("client").alias("kind"), F.col("src").alias("module")).union(e.where(F.col("src") == module).select(F.lit("server"), "dst")).distinct()


def fan_in(s: Stages, least: int) -> DataFrame:
    e = s.module_edges.select("src", "dst").distinct()
    return e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fan_out(s: Stages, more: int) -> DataFrame:
    e = s.module_edges.select("src", "dst").distinct()
    return e.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("n")).where(F.col("n") > more)


def module_graph(s: Stages) -> DataFrame:
    """``src, dst, label``: with the called functions."""
    call = F.concat("f", F.lit("/"), F.col("a").cast("string"))
    return s.module_edges.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set(call)), ", ").alias("label"))


def cyclic_modules(s: Stages) -> DataFrame:
    """``cycle, src, dst, weight``: short cycles of modules, each with the link of the fewest called functions."""
    w = staged(s.module_edges.groupBy("src", "dst").agg(F.count("*").alias("weight")))
    return graph.weakest_links(w, graph.short_cycles(w.select("src", "dst")))


def servers(s: Stages) -> DataFrame:
    """``mfa, scc, file_id, f, a``: functions in a cycle of calls, with a receive in the cycle."""
    edges = staged(s.call_edges)
    labels = staged(graph.scc(edges))
    labels = labels.join(graph.cyclic(edges, labels), "scc", "left_semi")
    own = s.functions.select("file_id", "f", "a", mfa("m", "f", "a").alias("mfa"))
    member = labels.withColumnRenamed("node", "mfa").join(own, "mfa")
    receive = s.ast_nodes.where("type = 'receive_expr'").select(*KEY).distinct()
    with_receive = member.join(receive, KEY, "left_semi").select("scc").distinct()
    return staged(member.join(with_receive, "scc", "left_semi"))


def not_flushing(s: Stages) -> DataFrame:
    """Servers without any receive clause that takes every message."""
    n = s.ast_nodes
    recv = n.where("type = 'receive_expr'").select("file_id", F.col("node_id").alias("r"), "f", "a")
    clause = n.where("type = 'clause'").select("file_id", F.col("node_id").alias("c"), F.col("parent_id").alias("r"))
    part = n.select("file_id", F.col("parent_id").alias("c"), "group_idx", "type")
    all_ = recv.join(clause, ["file_id", "r"]).join(part, ["file_id", "c"]).groupBy(*KEY, "c").agg(
        F.max((F.col("group_idx") == 0) & F.col("type").isin("variable", "underscore")).alias("any"), F.max(F.col("group_idx") == 1).alias("guarded")
    )
    own = servers(s)
    flush = own.join(all_.where("any and not guarded").select(*KEY).distinct(), KEY, "left_semi").select("scc").distinct()
    return own.join(flush, "scc", "left_anti").select("mfa")


def _tails(n: Node) -> list[Node]:
    """Expressions of which the value is the value of ``n``."""
    if n.type in ("clause", "block_expr"):
        body = n.groups[2] if n.type == "clause" else n.groups[0]
        return _tails(body[-1]) if body else []
    if n.type in ("case_expr", "if_expr", "receive_expr", "function"):
        out = [t for g in n.groups for c in g if c.type == "clause" for t in _tails(c)]
        return out + (_tails(n.groups[2][-1]) if n.type == "receive_expr" and n.groups[2] else [])
    return _tails(n.groups[0][0]) if n.type == "parentheses" else [n]


def _self_call(b, ctx: Context) -> bool:
    n, form = ctx.node, ctx.form
    return form.type == "function" and n.type == "application" and n.groups[0][0].type == "atom" and n.groups[0][0].value == form.value and len(n.groups[1]) == form.info["arity"]


def _non_tail(b, ctx: Context) -> bool:
    return _self_call(b, ctx) and not any(t is ctx.node for t in _tails(ctx.form))


def non_tail_recursive(s: Stages) -> DataFrame:
    """Functions with a call to themselves that is not their value."""
    return collect(s.files, [Collector("F@(As@@)", cond=_non_tail)]).select("path", "f", "a").distinct()


def non_tail_recursive_servers(s: Stages) -> DataFrame:
    bad = non_tail_recursive(s).join(s.files.select("path", "file_id"), "path")
    return servers(s).join(bad, KEY, "left_semi").select("mfa")


def has_receive(s: Stages) -> DataFrame:
    return s.ast_nodes.where("type = 'receive_expr'").groupBy(*KEY).agg(F.min("start_line").alias("line")).join(s.files.select("file_id", "module"), "file_id").select("module", "f", "a", "line")


def calls_to(s: Stages, wanted: list[tuple[str, str, int]]) -> DataFrame:
    """Places of all call shapes of the given functions."""
    return collect(s.files, [FunApply(m, f, a, f"{m}:{f}/{a}") for m, f, a in wanted])


def top_level_if(s: Stages) -> DataFrame:
    c = Collector("E@", cond=lambda b, ctx: ctx.node.type == "clause" and ctx.node.info.get("ctx") == "function.1" and len(ctx.node.groups[2]) == 1 and ctx.node.groups[2][0].type == "if_expr")
    return collect(s.files, [c]).select("path", "f", "a", "start_line")


def append_lists(s: Stages) -> DataFrame:
    return collect(s.files, [FunApply("lists", "append", 2)], stop=True)


def unnecessary_match(s: Stages) -> DataFrame:
    """``V = E, V`` as the last two statements of a clause."""

    def last(b, ctx: Context) -> bool:
        v, w = b["V@"], b["W@"]
        return ctx.node.type == "clause" and ctx.node.groups[2][-1] is w and v.type == w.type == "variable" and v.value == w.value

    return collect(s.files, [Collector("V@ = E@, W@", cond=last)]).select("path", "f", "a", "start_line", "value")


def operators(s: Stages, ops: list[str]) -> DataFrame:
    return s.ast_nodes.where(F.col("type").isin("infix_expr", "prefix_expr") & F.col("value").isin(ops)).join(s.files.select("file_id", "module"), "file_id").select("module", "f", "a", "value", "start_line", "start_col")


def dict_uses(s: Stages, mapped: bool = True) -> DataFrame:
    """Calls of dict functions that do (or do not) have a counterpart for maps."""
    has = F.col("callee_f").isin("new", "store", "fetch", "find", "is_key", "erase", "from_list", "to_list", "size", "fold", "map", "filter", "fetch_keys", "merge", "update", "is_empty")
    return s.calls.where("callee_m = 'dict'").where(has if mapped else ~has).select("m", "f", "a", "callee_f", "callee_a", "line")


def export_all(s: Stages) -> DataFrame:
    return s.attributes.where(F.col("name") == "compile").join(s.files.select("file_id", "module", "content"), "file_id").where(F.col("content").contains("export_all")).select("module")


def behaviours(s: Stages) -> DataFrame:
    return s.attributes.where(F.col("name").isin("behaviour", "behavior")).join(s.files.select("file_id", "module"), "file_id").select("module", F.col("value").alias("behaviour"))


def in_scope(s: Stages) -> DataFrame:
    """``file_id, origin, f, a``: functions defined or imported in each file."""
    return s.functions.select("file_id", F.col("m").alias("origin"), "f", "a").union(s.imports.select("file_id", F.col("m").alias("origin"), "f", "a")).distinct()


def api_classes(s: Stages, score: float = 0.8) -> DataFrame:
    """``mfa, score, class``: exported functions as api, semi-api or non-api, by the calls inside their module.

    Api: reached by nothing but itself, or exactly by its cycle. Otherwise the score is the best Dice overlap
    of what it reaches with what an api that reaches it does; semi-apis have at least ``score``.
    """
    own = s.functions.where("exported").select(mfa("m", "f", "a").alias("node"))
    edges = staged(s.calls.where("sure").select(mfa("m", "f", "a").alias("src"), mfa("callee_m", "callee_f", "callee_a").alias("dst")).where(F.substring_index("src", ":", 1) == F.substring_index("dst", ":", 1)).distinct())
    out = staged(edges.select("src", "dst"))
    seeds = staged(graph.nodes(out).union(own).distinct())
    reach = staged(graph.reachable(out, seeds))
    labels = graph.scc(out)
    size = labels.withColumn("n", F.count("*").over(_by("scc"))).select("node", "scc", "n")
    back = reach.select(F.col("node").alias("x"), F.col("seed").alias("r"))
    stat = own.join(back, F.col("node") == F.col("x"), "left").groupBy("node").agg(F.count("r").alias("reaching")).join(size, "node", "left")
    api = staged(stat.select("node", ((F.col("reaching") <= 1) | ((F.col("reaching") == F.col("n")) & (F.col("n") > 1))).alias("api")))
    total = reach.groupBy("seed").agg(F.count("*").alias("n"))
    pairs = api.where("not api").select("node").join(back, F.col("node") == F.col("x")).select("node", F.col("r").alias("by")).join(api.where("api").select(F.col("node").alias("by")), "by")
    common = pairs.join(reach.select(F.col("seed").alias("node"), F.col("node").alias("z")), "node").join(reach.select(F.col("seed").alias("by"), F.col("node").alias("z")), ["by", "z"]).groupBy("node", "by").agg(F.count("*").alias("k"))
    dice = common.join(total.select(F.col("seed").alias("node"), F.col("n").alias("p")), "node").join(total.select(F.col("seed").alias("by"), F.col("n").alias("q")), "by")
    best = dice.groupBy("node").agg(F.max(2 * F.col("k") / (F.col("p") + F.col("q"))).alias("score"))
    found = api.join(best, "node", "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    return found.select(F.col("node").alias("mfa"), "score", F.when(F.col("api"), "api").when(F.col("score") >= score, "semi-api").otherwise("non-api").alias("class"))


def _by(*cols):
    return Window.partitionBy(*cols)


def improper_calls(s: Stages) -> DataFrame:
    """Edges between modules on which only non-api functions are called."""
    bad = api_classes(s).where("class = 'non-api'").select("mfa", F.lit(True).alias("bad"))
    e = s.module_edges.withColumn("mfa", mfa("dst", "f", "a")).join(bad, "mfa", "left")
    return e.groupBy("src", "dst").agg(F.bool_and(F.coalesce("bad", F.lit(False))).alias("all_bad"), F.array_sort(F.collect_set("mfa")).alias("functions")).where("all_bad").select("src", "dst", "functions")


def component_candidates(s: Stages, n: int = 10) -> DataFrame:
    """The functions that are not exported and reach most code of their module while calling the fewest other modules."""
    edges = staged(s.call_edges)
    own = s.functions.select(mfa("m", "f", "a").alias("node"), "m", "exported", "code_lines")
    reach = staged(graph.reachable(edges, own.where("not exported").select("node")))
    part = reach.join(own.select("node", "m", "code_lines"), "node").withColumn("home", F.substring_index("seed", ":", 1))
    score = part.groupBy("seed").agg(F.sum("code_lines").alias("lines"), F.countDistinct(F.when(F.col("m") != F.col("home"), F.col("m"))).alias("others"))
    return score.orderBy(F.desc(F.col("lines") / (1 + F.col("others"))), "seed").limit(n)


def distances(s: Stages) -> DataFrame:
    """``m, x, y, distance``: Jaccard distance of the functions that pairs of exported functions of a module reach.

    Pairs meet on a shared callee; those that share nothing are at distance 1 and have no row.
    """
    own = s.functions.where("exported").select("m", mfa("m", "f", "a").alias("node"))
    reach = graph.reachable(staged(s.call_edges), own.select("node")).join(own.withColumnRenamed("node", "seed"), "seed")
    r = staged(reach.select("m", "seed", "node"))
    n = r.groupBy("seed").agg(F.count("*").alias("n"))
    k = r.alias("l").join(r.alias("r"), (F.col("l.m") == F.col("r.m")) & (F.col("l.node") == F.col("r.node")) & (F.col("l.seed") < F.col("r.seed")))
    k = k.groupBy(F.col("l.m").alias("m"), F.col("l.seed").alias("x"), F.col("r.seed").alias("y")).agg(F.count("*").alias("k"))
    k = k.join(n.select(F.col("seed").alias("x"), F.col("n").alias("p")), "x").join(n.select(F.col("seed").alias("y"), F.col("n").alias("q")), "y")
    return k.select("m", "x", "y", F.round(1 - F.col("k") / (F.col("p") + F.col("q") - F.col("k")), 6).alias("distance"))


def partition_exports(s: Stages, most: float = 0.8) -> DataFrame:
    """``m, cluster, members``: exported functions linked by distances of at most ``most``."""
    d = staged(distances(s).where(F.col("distance") <= most).select(F.col("x").alias("src"), F.col("y").alias("dst")))
    own = s.functions.where("exported").select("m", mfa("m", "f", "a").alias("node"))
    label = own.join(graph.components(d), "node", "left").withColumn("cluster", F.coalesce("label", "node"))
    return label.groupBy("m", "cluster").agg(F.array_sort(F.collect_list("node")).alias("members"))


def atom_types(s: Stages) -> DataFrame:
    """``module, value, role, n``: atoms as module, function or registered name where a known call tells, else unknown."""
    known = F.when(F.col("ctx").isin("module_qualifier.0"), "module").when(F.col("ctx").isin("module_qualifier.1", "application.0", "implicit_fun.0", "function.0"), "function").otherwise("unknown")
    atoms = s.ast_nodes.where("type = 'atom'").groupBy("file_id", "value", known.alias("role")).agg(F.count("*").alias("n"))
    return atoms.join(s.files.select("file_id", "module"), "file_id").select("module", "value", "role", "n")


def callback_functions(s: Stages) -> DataFrame:
    """``module, f, a, behaviour``: functions that a declared behaviour asks for, one of the library's or of the code base."""
    own = behaviours(s)
    rows = [(b, *x.split("/")) for b, names in CALLBACK.items() for x in names.split()]
    known = s.files.sparkSession.createDataFrame([(b, f, int(a)) for b, f, a in rows], "behaviour string, f string, a int")
    toks = F.regexp_extract("value", r"^\s*'?([A-Za-z_]\w*)", 1)
    declared = s.attributes.where("name = 'callback'").join(s.files.select("file_id", F.col("module").alias("behaviour")), "file_id")
    inner = F.regexp_extract("value", r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*->", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"\([^()]*\)", ""), r"[{\[][^{}\[\]]*[}\]]", "")
    arity = F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(flat, ",")))
    known = known.unionByName(declared.select("behaviour", toks.alias("f"), arity.cast("int").alias("a")))
    fun = s.functions.select("file_id", "f", "a").join(s.files.select("file_id", "module"), "file_id").drop("file_id")
    return own.join(known, "behaviour").join(fun, ["module", "f", "a"]).select("module", "f", "a", "behaviour").distinct()


def applications_within(s: Stages, m: str, f: str, a: int) -> DataFrame:
    """``callee, line, shape``: what one function applies, in the order of its lines."""
    name = F.concat(F.coalesce("callee_m", F.lit("?")), F.lit(":"), F.coalesce("callee_f", F.lit("?")), F.lit("/"), F.coalesce(F.col("callee_a").cast("string"), F.lit("?")))
    return s.calls.where((F.col("m") == m) & (F.col("f") == f) & (F.col("a") == a)).select(name.alias("callee"), "line", "shape")


def pattern_kinds(s: Stages) -> DataFrame:
    """``module, f, a, kind``: what the parameters of a function's clauses are: variable, literal, mixed, or none without parameters."""
    n = s.ast_nodes
    clause = n.where("type = 'clause' and ctx = 'function.1'").select("file_id", F.col("node_id").alias("c"), "f", "a")
    part = n.where("group_idx = 0").select("file_id", F.col("parent_id").alias("c"), "type")
    kind = F.when(F.col("type").isin("variable", "underscore"), "variable").when(F.col("type").isin("atom", "integer", "float", "string", "char", "nil"), "literal").otherwise("mixed")
    per = clause.join(part, ["file_id", "c"], "left").withColumn("kind", F.when(F.col("type").isNotNull(), kind))
    found = per.groupBy(*KEY).agg(F.countDistinct("kind").alias("n"), F.min("kind").alias("one"))
    found = found.withColumn("kind", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, F.col("one")).otherwise("mixed"))
    return found.join(s.files.select("file_id", "module"), "file_id").select("module", "f", "a", "kind")


def common_callees(s: Stages, modules: list[str]) -> DataFrame:
    """``module``: what every one of the given modules calls."""
    want = len(set(modules))
    e = s.module_edges.select("src", "dst").distinct().where(F.col("src").isin(*set(modules)))
    return e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("n")).where(F.col("n") == want).select("module")


def unmoveable(s: Stages) -> DataFrame:
    """``mfa, why``: functions that cannot leave their module alone: they reach a server library, or what they reach is called from outside of it."""
    edges = staged(s.call_edges)
    own = s.functions.select(mfa("m", "f", "a").alias("node"))
    reach = staged(graph.reachable(edges, own).select(F.col("seed").alias("mfa"), "node"))
    library = s.external_calls.where(F.col("dst").startswith("gen_server:")).select(F.col("src").alias("node")).distinct()
    to_library = reach.join(library, "node", "left_semi").select("mfa").distinct()
    # closed: every caller of what the function reaches, but itself, is reached by it too
    back = reach.where("node <> mfa").join(edges.select(F.col("dst").alias("node"), F.col("src").alias("caller")), "node")
    inside = reach.select("mfa", F.col("node").alias("caller"))
    open_ = back.join(inside, ["mfa", "caller"], "left_anti").select("mfa").distinct()
    return to_library.withColumn("why", F.lit("server")).union(open_.join(to_library, "mfa", "left_anti").withColumn("why", F.lit("shared")))


def macro_uses(s: Stages) -> DataFrame:
    """``module, f, a, macro, n``: how often each function uses each macro."""
    return s.ast_nodes.where("type = 'macro'").groupBy("file_id", "f", "a", F.col("value").alias("macro")).agg(F.count("*").alias("n")).join(s.files.select("file_id", "module"), "file_id").select("module", "f", "a", "macro", "n")


def run_all(s: Stages, inspectors: list[tuple[str, Callable[[Stages], DataFrame]]]) -> DataFrame:
    """``inspector, message``: each row of each inspection as one message."""
    parts = [f(s).select(F.lit(name).alias("inspector"), F.to_json(F.struct("*")).alias("message")) for name, f in inspectors]
    return reduce(DataFrame.unionByName, parts)

