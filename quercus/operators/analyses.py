"""Program analyses: side effects, slices and dependences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.operators import graph
from quercus.plans.staging import staged
from quercus.sources.stages import Stages, mfa

#: Built-in and library functions without an effect, and those with one; anything else is unknown.
PURE = """abs/1 atom_to_list/1 binary_to_list/1 element/2 float/1 hd/1 integer_to_list/1 is_atom/1 is_binary/1 is_boolean/1 is_float/1 is_function/1
 is_integer/1 is_list/1 is_map/1 is_number/1 is_pid/1 is_tuple/1 length/1 list_to_atom/1 list_to_binary/1 list_to_integer/1 list_to_tuple/1 map_size/1
 max/2 min/2 round/1 self/0 setelement/3 size/1 tl/1 trunc/1 tuple_size/1 tuple_to_list/1"""
EFFECT = "send/2 put/2 exit/1 exit/2 error/1 throw/1 register/2 unregister/1 link/1 unlink/1 monitor/2 spawn/1 spawn/2 spawn/3 spawn/4 spawn_link/1 spawn_link/3 spawn_monitor/3 spawn_opt/4"
EFFECT_MODULES = ("io", "file", "ets", "dets", "gen_server", "error_logger", "timer")
PURE_MODULES = ("lists", "dict", "sets", "ordsets", "orddict", "string", "maps", "math", "proplists", "gb_trees")


def side_effects(s: Stages) -> DataFrame:
    """``mfa, effect``: true, false or null (unknown) for each function.

    An effect of its own (a send or receive, or a callee known to have one) makes a function true; else an
    unknown callee makes it null; values pass up the calls until nothing changes.
    """
    key = ["file_id", "f", "a"]
    own = s.functions.select("file_id", "f", "a", mfa("m", "f", "a").alias("mfa"))
    direct = s.ast_nodes.where("(type = 'infix_expr' and value = '!') or type = 'receive_expr'").select(*key).distinct().withColumn("own", F.lit(2))
    fa = F.concat("callee_f", F.lit("/"), F.col("callee_a").cast("string"))
    in_erlang = F.col("callee_m") == "erlang"
    level = F.when(in_erlang & fa.isin(PURE.split()), 0).when(in_erlang & fa.isin(EFFECT.split()), 2).when(F.col("callee_m").isin(*PURE_MODULES), 0).when(F.col("callee_m").isin(*EFFECT_MODULES), 2).otherwise(1)
    calls = staged(s.calls.select(mfa("m", "f", "a").alias("src"), mfa("callee_m", "callee_f", "callee_a").alias("dst"), level.alias("level")), "effect-calls")
    inside = staged(calls.join(own.select(F.col("mfa").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct())
    outside = calls.join(own.select(F.col("mfa").alias("dst")).distinct(), "dst", "left_anti").groupBy("src").agg(F.max("level").alias("out"))
    state = own.join(direct, key, "left").join(outside, F.col("mfa") == F.col("src"), "left").select("mfa", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("out", F.lit(0))).alias("v"))
    state = staged(state, "effects")
    while True:
        up = inside.join(state, F.col("dst") == F.col("mfa")).select(F.col("src").alias("mfa"), "v")
        nxt = staged(state.union(up).groupBy("mfa").agg(F.max("v").alias("v")).join(own.select("mfa"), "mfa", "left_semi"), "effects")
        same = nxt.join(state.withColumnRenamed("v", "was"), "mfa").where("v <> was").isEmpty()
        state = nxt
        if same:
            break
    return state.select("mfa", F.when(F.col("v") == 2, True).when(F.col("v") == 0, False).alias("effect"))


def statement_edges(s: Stages) -> DataFrame:
    """``file_id, f, a, src, dst, var``: the statement at line ``src`` binds a variable that line ``dst`` uses."""
    uses = s.bindings.where("role = 'use'").select("file_id", "f", "a", "var", F.col("line").alias("dst"), F.explode("defs").alias("d"))
    return uses.select("file_id", "f", "a", F.col("d.line").alias("src"), "dst", "var").where("src <> dst").distinct()


def slice_from(s: Stages, points: DataFrame, backward: bool = False) -> DataFrame:
    """``module, at, line``: lines that each point (``module, line``) affects, or (backward) that affect it, inside its function."""
    files = s.files.select("file_id", "module")
    e = staged(statement_edges(s).join(files, "file_id").select(F.concat_ws(":", "module", "src").alias("src"), F.concat_ws(":", "module", "dst").alias("dst")), "slice-edges")
    seeds = points.select(F.concat_ws(":", "module", "line").alias("node"))
    found = graph.reachable(e, seeds, reverse=backward)
    at = lambda c: F.substring_index(c, ":", -1).cast("int")
    return found.select(F.substring_index("seed", ":", 1).alias("module"), at("seed").alias("at"), at("node").alias("line"))


def slice_between(s: Stages, points: DataFrame, backward: bool = False) -> DataFrame:
    """As :func:`slice_from`, over calls too: ``module, at, to_module, line``.

    A call passes its line on to the head of the function that it calls, and the lines of that function's last
    statements pass on to the call. Calls are not told apart, so what one of them passes on comes back to all.
    """
    files = s.files.select("file_id", "module")
    inner = statement_edges(s).join(files, "file_id").select(F.concat_ws(":", "module", "src").alias("src"), F.concat_ws(":", "module", "dst").alias("dst"))
    calls = s.calls.where("sure").select("m", "line", F.col("callee_m").alias("cm"), F.col("callee_f").alias("cf"), F.col("callee_a").alias("ca"))
    head = s.functions.select(F.col("m").alias("cm"), F.col("f").alias("cf"), F.col("a").alias("ca"), F.col("start_line").alias("head"))
    into = calls.join(head, ["cm", "cf", "ca"]).select(F.concat_ws(":", "m", "line").alias("src"), F.concat_ws(":", "cm", "head").alias("dst"))
    last = s.expr_seqs.groupBy(F.col("m").alias("cm"), F.col("f").alias("cf"), F.col("a").alias("ca"), "seq_id").agg(F.max_by("start_line", "idx").alias("tail"))
    back = calls.join(last, ["cm", "cf", "ca"]).select(F.concat_ws(":", "cm", "tail").alias("src"), F.concat_ws(":", "m", "line").alias("dst"))
    e = staged(inner.union(into).union(back).where("src <> dst").distinct(), "slice-edges")
    found = graph.reachable(e, points.select(F.concat_ws(":", "module", "line").alias("node")), reverse=backward)
    at = lambda c: F.substring_index(c, ":", -1).cast("int")
    return found.select(F.substring_index("seed", ":", 1).alias("module"), at("seed").alias("at"), F.substring_index("node", ":", 1).alias("to_module"), at("node").alias("line"))


def process_order(s: Stages) -> DataFrame:
    """``mfa, level``: functions from which a process is spawned or which one runs, callees first; the others are left out."""
    edges = staged(s.call_edges, "calls")
    e = s.calls.where("shape = 'spawn' and sure").select(F.explode(F.array(mfa("m", "f", "a"), mfa("callee_m", "callee_f", "callee_a"))).alias("node")).distinct()
    near = graph.reachable(edges, e, reverse=True).select("node").distinct()
    order = graph.callee_first(edges)
    return order.join(near, "node", "left_semi").select(F.col("node").alias("mfa"), "level")


def module_graph_updated(old: DataFrame, s: Stages, status: DataFrame) -> DataFrame:
    """``src, dst``: the module graph after a change. Edges of modules whose files are unchanged (``path, status``) are taken over; only the others are read."""
    same = s.files.join(status.where("status = 'unchanged'").select("path"), "path", "left_semi").select(F.col("module").alias("src"))
    kept = old.select("src", "dst").join(same, "src", "left_semi").join(s.files.select(F.col("module").alias("dst")), "dst", "left_semi").select("src", "dst")
    new = s.module_edges.select("src", "dst").distinct().join(same, "src", "left_anti")
    return kept.union(new).distinct()


def affected_functions(s: Stages, seeds: DataFrame) -> DataFrame:
    """Functions that the given ones (column ``node``) may influence: those that call them, however far."""
    return graph.reachable(staged(s.call_edges), seeds, reverse=True)


def processes(s: Stages) -> DataFrame:
    """``spawner, entry``: who spawns what; and (fixpoint) everything the entry may run."""
    e = s.calls.where("shape = 'spawn' and sure").select(mfa("m", "f", "a").alias("spawner"), mfa("callee_m", "callee_f", "callee_a").alias("entry")).distinct()
    e = staged(e, "spawned")
    run = graph.reachable(staged(s.call_edges), e.select(F.col("entry").alias("node")))
    return e.join(run.select(F.col("seed").alias("entry"), F.col("node").alias("runs")), "entry").groupBy("spawner", "entry").agg(F.array_sort(F.collect_set("runs")).alias("runs"))


def dead_assignments(s: Stages) -> DataFrame:
    """``module, f, a, var, line``: variables bound in a body and never used."""
    b = s.bindings
    used = b.where("role = 'use'").select("file_id", F.explode("defs").alias("d"))
    used = used.select("file_id", F.col("d.line").alias("line"), F.col("d.col").alias("col")).distinct()
    bound = b.where("role = 'bind' and not startswith(var, '_')").select("file_id", "f", "a", "var", "line", "col")
    return bound.join(used, ["file_id", "line", "col"], "left_anti").join(s.files.select("file_id", "module"), "file_id").select("module", "f", "a", "var", "line")
