"""Queries over the embedded code base; SQL cannot read source text, so they have no oracle and are held by tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.operators import analyses, clones, editor, graph, inspections, layout, lookup, pattern, refactor, symbolic
from quercus.plans import corpus
from quercus.plans.registry import query
from quercus.plans.staging import staged
from quercus.sources import preprocess
from quercus.sources.files import changed, from_strings, test_framework
from quercus.sources.stages import Stages
from quercus.sources.tokenizer import tokens
from quercus.trees import clusters, diff

_PARSED: dict[tuple[str, bool], Stages] = {}
SMALL_CLONES = clones.CloneParams(min_len=3, min_toks=15)


def stages(spark: SparkSession, later: bool = False) -> Stages:
    """The stage tables, parsed once a session and written, so that each query reads only the columns it needs."""
    key = (spark.sparkContext.applicationId, later)
    if key not in _PARSED:
        s = corpus.stages(spark, later)
        s.parsed = staged(s.parsed, "parsed")
        _PARSED[key] = s
    return _PARSED[key]


def code_query(name):
    """Registers a function of the stage tables."""

    def add(f):
        query(name)(lambda spark, sf_dir: f(stages(spark)))
        return f

    return add


def _rows(s: Stages, rows: list[tuple], schema: str) -> DataFrame:
    return s.files.sparkSession.createDataFrame(rows, schema)


def _point(s: Stages, module: str, line: int, col: int) -> DataFrame:
    return s.files.where(F.col("module") == module).select("file_id", F.lit(line).alias("line"), F.lit(col).alias("col"))


def _named(s: Stages, df: DataFrame) -> DataFrame:
    """With the module in place of the file's id."""
    return df.join(s.files.select("file_id", "module"), "file_id").select("module", *(c for c in df.columns if c != "file_id"))


def _places(classes: DataFrame) -> DataFrame:
    """Members as ``m:f/a start-end``."""
    at = lambda x: F.concat(x["m"], F.lit(":"), x["f"], F.lit("/"), x["a"].cast("string"), F.lit(" "), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"))
    return classes.withColumn("members", F.array_sort(F.transform("members", at)))


def _per_file(s: Stages, module: str, edit) -> DataFrame:
    return pattern.changed_lines(pattern.rewrite_files(s.files.where(F.col("module") == module), edit))


def _pair(s: Stages) -> DataFrame:
    """One row: the texts of two modules."""
    one = lambda m, n: s.files.where(F.col("module") == m).select(F.col("content").alias(n))
    return one("ledger", "a").join(one("shapes", "b"), F.lit(True))


def _mapped(frames):
    for pdf in frames:
        yield pd.DataFrame([r for a, b in zip(pdf.a, pdf.b, strict=True) for r in diff.mapping(a, b)], columns=["type", "left_line", "right_line", "size"])


def _texts(s: Stages, make, roles) -> DataFrame:
    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(r, k, line) for a, b in zip(pdf.a, pdf.b, strict=True) for r, t in zip(roles, make(a, b), strict=True) for k, line in enumerate(t.split("\n")) if line], columns=["role", "line", "text"])

    return _pair(s).mapInPandas(run, "role string, line int, text string")


def _duplicates(s: Stages) -> DataFrame:
    t = staged(tokens(s.files), "tokens")
    return clones.trimmed_clones(clones.duplicated_code(t, 30), t, s.ast_nodes)


def _duplicated_parts(s: Stages) -> DataFrame:
    return _named(s, _duplicates(s).select("file_id", "part", "start_line", "text"))


def _component(s: Stages) -> DataFrame:
    e = staged(s.call_edges)
    return graph.components_of(e, staged(graph.scc(e)), _rows(s, [("table:lookup/1",)], "node string"))


def _cyclic_dot(s: Stages) -> DataFrame:
    g = staged(inspections.module_graph(s))
    return graph.dot(graph.inside_components(g, graph.scc(g.select("src", "dst"))), "label").where("k = 1").select("line")


def _cycles_dot(s: Stages) -> DataFrame:
    """Each link of each cycle, the weakest in red."""
    weak = staged(inspections.cyclic_modules(s), "weak-links")
    pairs = weak.select("cycle", F.col("src").alias("w1"), F.col("dst").alias("w2"), F.explode("cycle").alias("src")).join(inspections.module_graph(s), "src").where(F.array_contains("cycle", F.col("dst")))
    return graph.dot(pairs.select("src", "dst", "label", ((F.col("src") == F.col("w1")) & (F.col("dst") == F.col("w2"))).alias("weak")).distinct(), "label", "weak").where("k = 1").select("line")


# sources and stage tables
code_query("code_files")(lambda s: s.files.select("path", "module", "dir", F.md5("content").alias("digest"), "fmt"))
code_query("code_tokens")(lambda s: tokens(s.files).groupBy("kind").agg(F.count("*").alias("n")))
code_query("code_layout_tokens")(lambda s: tokens(s.files, layout=True).groupBy("kind").agg(F.count("*").alias("n")))
code_query("code_comments")(lambda s: tokens(s.files, layout=True).where("kind = 'comment'").join(s.files.select("file_id", "module"), "file_id").select("module", "line", "col", "value"))
code_query("code_nodes")(lambda s: s.ast_nodes.groupBy("type", "category").agg(F.count("*").alias("n")))
code_query("code_functions")(lambda s: s.functions.select("m", "f", "a", "exported", "start_line", "end_line", "code_lines", "clauses"))
code_query("code_module_info")(lambda s: _named(s, s.exports.select("file_id", F.lit("export").alias("kind"), F.concat("f", F.lit("/"), F.col("a").cast("string")).alias("value")).union(s.records.select("file_id", F.lit("record"), "name")).union(s.attributes.select("file_id", "name", "value")).union(s.includes.select("file_id", F.lit("include"), "include"))))
code_query("code_calls")(lambda s: s.calls.drop("file_id", "node_id"))
code_query("code_errors")(lambda s: _named(s, s.errors))
code_query("code_bindings")(lambda s: s.bindings.select("f", "a", "role", "var", "line", "col", "defs"))
code_query("code_test_frameworks")(lambda s: test_framework(s.files, s.includes))
code_query("code_in_scope")(lambda s: _named(s, inspections.in_scope(s)))
code_query("code_atom_types")(inspections.atom_types)
code_query("code_statement_hashes")(lambda s: s.expr_seqs.select("m", "f", "a", "seq_id", "idx", "hash", "ntoks", "gen_text", "binding"))

# positions and traversals
code_query("position_node")(lambda s: lookup.at_position(s.ast_nodes, _point(s, "ledger", 7, 22), lookup.is_expr()).select("line", "col", "type", "text"))
code_query("position_function")(lambda s: lookup.function_at(s.functions, _point(s, "router", 11, 5)).drop("file_id"))
code_query("position_instances")(lambda s: lookup.instances(s.bindings, _point(s, "ledger", 7, 5)).drop("file_id"))
code_query("range_expressions")(lambda s: lookup.expressions_in(s.ast_nodes, s.files.where("module = 'ledger'").selectExpr("file_id", "7 from_line", "1 from_col", "9 to_line", "40 to_col")).drop("file_id"))
code_query("outermost_cases")(lambda s: lookup.outermost(s.ast_nodes.where("type = 'case_expr'")).select("f", "a", "start_line"))
code_query("first_calls")(lambda s: lookup.first(s.ast_nodes.where("type = 'application'")).select("f", "a", "text"))
code_query("free_variables")(lambda s: lookup.free_and_exported(s.ast_nodes.where("type = 'match_expr'"), s.bindings).select("free", "bound", "exported"))

# pattern queries and rewrites
code_query("collect_calls")(lambda s: pattern.collect(s.files, [pattern.Collector("io:format(F@, As@)", name="format", emit=lambda b, c: c.source(b["F@"]))]))
code_query("collect_locations")(lambda s: pattern.collect_loc(s.files, [pattern.Collector("X@ = lists:sum(Y@)")]))
code_query("collect_sequences")(lambda s: pattern.collect(s.files, [pattern.Collector("S@ = lists:sum(L@), N@ = length(L@)")]))
code_query("apply_shapes")(lambda s: inspections.calls_to(s, [("counter", "add", 2), ("table", "lookup", 1)]))
code_query("rewrite_rules")(lambda s: pattern.transform(s.files, [pattern.Rule("length(L@) ", "erlang:length(L@)", lambda b, c: c.node.groups[0][0].type == "atom")], "stop_td").transform(pattern.changed_lines))
code_query("symbolic_folding")(lambda s: pattern.changed_lines(symbolic.fold(s.files, "arithmetics")))

# inspections
code_query("long_functions")(lambda s: inspections.long_functions(s, 10))
code_query("large_modules")(lambda s: inspections.large_modules(s, 30))
code_query("nested_cases")(lambda s: inspections.nested(s, "case", 3))
code_query("function_callers")(lambda s: inspections.callers(s, "counter", "add", 2))
code_query("module_dependencies")(lambda s: inspections.dependencies(s, "table"))
code_query("module_fan_in")(lambda s: inspections.fan_in(s, 2))
code_query("module_fan_out")(lambda s: inspections.fan_out(s, 1))
code_query("module_graph")(inspections.module_graph)
code_query("module_graph_dot")(lambda s: graph.dot(inspections.module_graph(s), "label"))
code_query("cyclic_modules")(inspections.cyclic_modules)
code_query("server_functions")(lambda s: inspections.servers(s).select("mfa", "scc"))
code_query("servers_not_flushing")(inspections.not_flushing)
code_query("non_tail_recursive")(inspections.non_tail_recursive)
code_query("non_tail_recursive_servers")(inspections.non_tail_recursive_servers)
code_query("has_receive")(inspections.has_receive)
code_query("top_level_if")(inspections.top_level_if)
code_query("append_lists")(inspections.append_lists)
code_query("unnecessary_match")(inspections.unnecessary_match)
code_query("operator_uses")(lambda s: inspections.operators(s, ["!", "++"]))
code_query("dict_uses")(inspections.dict_uses)
code_query("export_all")(inspections.export_all)
code_query("behaviours")(inspections.behaviours)
code_query("api_classes")(inspections.api_classes)
code_query("improper_calls")(inspections.improper_calls)
code_query("component_candidates")(inspections.component_candidates)
code_query("partition_exports")(inspections.partition_exports)
code_query("batch_inspection")(lambda s: inspections.run_all(s, [("long", lambda x: inspections.long_functions(x, 10)), ("export_all", inspections.export_all), ("receive", inspections.has_receive)]))
code_query("callgraph_order")(lambda s: graph.callee_first(staged(s.call_edges)))
code_query("external_calls")(lambda s: s.external_calls)

# clones
code_query("similar_code")(lambda s: _places(clones.similar_code(s, SMALL_CLONES)))
code_query("clone_report")(lambda s: clones.report(clones.similar_code(s, SMALL_CLONES)))
code_query("duplicated_code")(lambda s: _named(s, clones.duplicated_code(tokens(s.files), 30).select("file_id", "len", "line")))
code_query("duplicated_parts")(lambda s: _duplicated_parts(s))
code_query("duplicated_parameters")(lambda s: _named(s, clones.generalised_parts(_duplicates(s)).select("file_id", "part", "start_line", "n_pars")))
code_query("identical_expressions")(lambda s: clones.identical_expressions(s).select("freq", "example"))
code_query("similar_expressions")(lambda s: clones.similar_expressions(s, "Total = lists:sum(Xs)"))
code_query("clone_evolution")(lambda s: clones.evolution(clones.similar_code(s, SMALL_CLONES), clones.similar_code(stages(s.files.sparkSession, True), SMALL_CLONES)))
code_query("changed_files")(lambda s: changed(s.files, stages(s.files.sparkSession, True).files))

# analyses
code_query("side_effects")(analyses.side_effects)
code_query("forward_slice")(lambda s: analyses.slice_from(s, _rows(s, [("ledger", 7)], "module string, line int")))
code_query("backward_slice")(lambda s: analyses.slice_from(s, _rows(s, [("ledger", 11)], "module string, line int"), True))
code_query("affected_functions")(lambda s: analyses.affected_functions(s, _rows(s, [("counter:add/2",)], "node string")))
code_query("spawned_processes")(analyses.processes)
code_query("dead_assignments")(analyses.dead_assignments)
code_query("evaluation_steps")(lambda s: _rows(s, [(i, x) for i, x in enumerate(symbolic.steps("f(2) + 1", context="f(X) -> X * 3."))], "step int, expr string"))

# refactorings: the files that change, with their new text
_EDITS = {
    "rename_function": (lambda t: refactor.rename_function(t, "counter", "add", 2, "plus"), "add"),
    "rename_module": (lambda t: refactor.rename_module(t, "table", "registry"), "table"),
    "swap_arguments": (lambda t: refactor.swap_arguments(t, "counter", "add", 2, 1, 2), "add"),
    "add_argument": (lambda t: refactor.add_argument(t, "counter", "add", 2, 3, "Extra"), "add"),
    "tuple_arguments": (lambda t: refactor.tuple_arguments(t, "counter", "add", 2, 1, 2), "add"),
    "apply_to_remote": (refactor.apply_to_remote, "apply"),
    "comment_out_specs": (refactor.comment_out_specs, "-spec"),
    "migrate_dict": (lambda t: refactor.migrate(t, "dict to maps"), "dict:"),
    "remove_import": (lambda t: refactor.remove_import(t, "lists"), "-import"),
}
for _name, (_edit, _word) in _EDITS.items():
    code_query(f"refactor_{_name}")(lambda s, e=_edit, w=_word: pattern.changed_lines(refactor.everywhere(s.files, e, w)))
code_query("refactor_move_function")(lambda s: _per_file(s, "counter", lambda t: refactor.move_function(t, corpus.TABLE, "kind", 1)[0]))
code_query("refactor_move_function_target")(lambda s: _per_file(s, "table", lambda t: refactor.move_function(corpus.COUNTER, t, "kind", 1)[1]))
code_query("copy_module")(lambda s: refactor.copy_module(s.files, "table", "table2").select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).where("line < 3"))
code_query("refactor_rename_clash")(lambda s: refactor.rename_everywhere(s, "table", "log", 2, "insert").select("path", "new_content", "error"))
code_query("refactor_rename_checked")(lambda s: pattern.changed_lines(refactor.rename_everywhere(s, "counter", "add", 2, "plus")))
code_query("rename_clashes")(lambda s: refactor.clashes(s, _rows(s, [("counter", "total", 1, "kind"), ("table", "log", 2, "insert"), ("ledger", "same", 1, "reverse"), ("router", "old", 1, "fresh")], "m string, f string, a int, new string")))
code_query("rename_to_camel_case")(lambda s: refactor.rename_all(s, refactor.camel_case))
code_query("behaviour_extraction")(lambda s: _texts(s, lambda a, b: diff.infer_behaviour(a, b, "shared"), ("behaviour", "first", "second")))
code_query("tree_mapping")(lambda s: _pair(s).mapInPandas(_mapped, "type string, left_line int, right_line int, size int"))
code_query("change_candidates")(lambda s: pattern.candidates(refactor.everywhere(s.files, lambda t: refactor.migrate(t, "dict to maps"), "dict:")).select("path", F.length("key").alias("key_length")))

# more sources and graphs
code_query("attached_comments")(layout.attached_comments)
code_query("macro_uses")(inspections.macro_uses)
query("callback_functions")(lambda spark, sf_dir: inspections.callback_functions(Stages(from_strings(spark, corpus.WITH_CALLBACKS), persist=False)))
code_query("applications_within")(lambda s: inspections.applications_within(s, "router", "dispatch", 3))
code_query("pattern_kinds")(inspections.pattern_kinds)
code_query("common_callees")(lambda s: inspections.common_callees(s, ["ledger", "router"]))
code_query("unmoveable_functions")(inspections.unmoveable)
code_query("component_of_function")(lambda s: _component(s))
code_query("callers_dot")(lambda s: graph.dot(graph.into(inspections.module_graph(s), _rows(s, [("counter",)], "node string")), "label").where("k = 1").select("line"))
code_query("cyclic_dot")(lambda s: _cyclic_dot(s))
code_query("callgraph_dot")(lambda s: graph.dot(s.call_edges.where("startswith(src, 'table:')")).where("k = 1").select("line"))
code_query("cycles_dot")(lambda s: _cycles_dot(s))
code_query("label_sizes")(lambda s: inspections.module_graph(s).select("src", "dst", *graph.label_size(F.concat_ws("\n", "src", "label"))))
code_query("clone_evolution_csv")(lambda s: clones.evolution(clones.similar_code(s, SMALL_CLONES), clones.similar_code(stages(s.files.sparkSession, True), SMALL_CLONES)).groupBy("status").agg(F.count("*").alias("n")).select(F.concat_ws(",", "status", F.col("n").cast("string")).alias("line")))


@query("expanded_macros")
def expanded_macros(spark, sf_dir):
    """Files with their macros expanded; headers come by the includes that reach them."""
    found = preprocess.expanded(from_strings(spark, corpus.WITH_MACROS), from_strings(spark, corpus.HEADERS))
    return found.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).where("text <> ''")


@query("macro_definitions")
def macro_definitions(spark, sf_dir):
    found = preprocess.expanded(from_strings(spark, corpus.WITH_MACROS), from_strings(spark, corpus.HEADERS))
    return found.select("path", F.explode("defined").alias("d")).select("path", "d.name", "d.arity", "d.body")


@query("macro_errors")
def macro_errors(spark, sf_dir):
    found = preprocess.expanded(from_strings(spark, corpus.WITH_MACROS), from_strings(spark, corpus.HEADERS))
    return found.select("path", F.explode(F.concat("errors", F.transform("missing", lambda x: F.concat(F.lit("missing "), x)))).alias("error"))


# what an editor asks
code_query("editor_actions")(lambda s: editor.actions(s).where("module = 'ledger' and action not in ('rename variable', 'new macro')"))
code_query("editor_action_counts")(lambda s: editor.actions(s).groupBy("module", "action").agg(F.count("*").alias("n")).where("action in ('rename function', 'inline variable', 'extract function')"))
code_query("editor_lenses")(editor.lenses)
code_query("editor_highlights")(lambda s: editor.highlights(s, _point(s, "ledger", 9, 15)))
code_query("semantic_tokens")(lambda s: editor.semantic_tokens(s).where("module = 'router' and seq <= 12"))

# trees as tables
code_query("tree_index")(lambda s: _named(s, clusters.indexed(s.ast_nodes.where("type like '%_expr'"), "type").select("file_id", "key", "n")))
code_query("tree_rebuilt")(lambda s: _named(s, clusters.rendered(s.ast_nodes, s.ast_nodes.where("type = 'match_expr'")).select("file_id", "code")))
code_query("tree_breadth_first")(lambda s: _named(s, clusters.breadth_first(s.ast_nodes.where("f = 'same'")).select("file_id", "rank", "type")))
code_query("tree_clusters")(lambda s: _named(s, clusters.clusters(clusters.marked(_functions(s, "scale"), _functions(s, "balance"))).select("file_id", "common", "size", "frontier")))
code_query("function_blocks")(lambda s: _named(s, _blocks(s)))
code_query("block_interfaces")(lambda s: _named(s, clusters.block_interfaces(_blocks(s), s.expr_seqs, s.bindings)))
code_query("argument_names")(lambda s: clusters.argument_names(s.functions, s.ast_nodes).where("m in ('ledger', 'shapes')"))
code_query("redirected_calls")(lambda s: _per_file(s, "table", lambda t: clusters.local_calls_redirected(t, "store", {("lookup", 1), ("log", 2)})))


def _functions(s: Stages, name: str) -> DataFrame:
    return s.ast_nodes.where(F.col("f") == name)


def _blocks(s: Stages) -> DataFrame:
    return clusters.blocks(s.expr_seqs.where("m = 'shapes'"), s.expr_seqs.where("m = 'ledger'"))

code_query("forward_slice_calls")(lambda s: analyses.slice_between(s, _rows(s, [("ledger", 24)], "module string, line int")))
code_query("backward_slice_calls")(lambda s: analyses.slice_between(s, _rows(s, [("table", 16)], "module string, line int"), True))
code_query("process_order")(analyses.process_order)
code_query("function_text")(lambda s: s.functions.where("m = 'ledger' and f = 'same' and a = 1").select("m", "f", "a", "text"))
code_query("module_graph_updated")(lambda s: _updated(s))


def _updated(s: Stages) -> DataFrame:
    later = stages(s.files.sparkSession, True)
    return analyses.module_graph_updated(s.module_edges, later, changed(s.files, later.files))


# parts of the stage tables that are small enough to be held row by row
code_query("bindings_of_functions")(lambda s: s.bindings.where("f in ('report', 'same', 'fold')").select("f", "a", "role", "var", "line", "col"))
code_query("nodes_of_function")(lambda s: s.ast_nodes.where("f = 'same'").select("depth", "type", "value", "category", "ctx", "start_line", "start_col", "end_line", "end_col"))
code_query("statements_of_function")(lambda s: s.expr_seqs.where("f = 'balance'").select("seq_id", "idx", "hash", "ntoks", "gen_text", "start_line", "end_line"))
code_query("atoms_of_module")(lambda s: inspections.atom_types(s).where("module = 'router'"))
