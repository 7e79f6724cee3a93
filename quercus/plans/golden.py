"""Rows that the queries over the embedded modules (``corpus``, ``samples``) have to give, as SQL.

The modules are fixed, so the rows are too. They were written down from results and then read against the modules:
most row by row, positions in the longest lists by sample. Tokens and files are counted by SQL from the text.
"""

from __future__ import annotations

from quercus.plans import corpus
from quercus.plans.registry import ORACLES
from quercus.sources.tokenizer import KEYWORDS

TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(_value, v)) + "]" if isinstance(v, list) else repr(v)


def _sql(columns: str, rows: list[tuple]) -> str:
    own = [c.split(" ") for c in columns.split(", ")]
    cast = ", ".join(f'CAST("{n}" AS {TYPES[t]}) AS "{n}"' for n, t in own)
    names = ", ".join(f'"{n}"' for n, _ in own)
    values = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) if rows else "(" + ", ".join("NULL" for _ in own) + ")"
    return f"SELECT {cast} FROM (VALUES {values}) AS t({names})" + ("" if rows else " WHERE false")


#: Query: its columns with their types, and its rows.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "code_comments": (
        "module string, line int, col int, value string",
        [
            ("counter", 10, 1, "%% a server that keeps messages it does not know"),
        ],
    ),
    "code_functions": (
        "m string, f string, a int, exported boolean, start_line int, end_line int, code_lines int, clauses int",
        [
            ("counter", "add", 2, True, 32, 32, 1, 1),
            ("counter", "drain", 1, True, 22, 30, 9, 1),
            ("counter", "kind", 1, True, 41, 46, 6, 1),
            ("counter", "loop", 1, True, 11, 20, 10, 1),
            ("counter", "start", 0, True, 8, 8, 1, 1),
            ("counter", "total", 1, True, 34, 39, 6, 1),
            ("ledger", "balance", 1, True, 6, 11, 6, 1),
            ("ledger", "deep", 3, True, 27, 39, 13, 1),
            ("ledger", "fold", 3, True, 20, 21, 2, 2),
            ("ledger", "format", 2, False, 18, 18, 1, 1),
            ("ledger", "report", 2, True, 13, 16, 4, 1),
            ("ledger", "same", 1, True, 23, 25, 3, 1),
            ("router", "broadcast", 2, True, 15, 16, 2, 1),
            ("router", "dispatch", 3, True, 9, 13, 5, 1),
            ("router", "old", 1, True, 21, 23, 3, 1),
            ("router", "route", 2, True, 4, 7, 4, 1),
            ("router", "sum_to", 1, True, 18, 19, 2, 2),
            ("shapes", "area", 1, True, 4, 5, 2, 2),
            ("shapes", "both", 1, True, 24, 24, 1, 1),
            ("shapes", "perimeter", 1, True, 7, 8, 2, 2),
            ("shapes", "scale", 2, True, 10, 15, 6, 1),
            ("shapes", "simple", 1, True, 17, 22, 6, 1),
            ("table", "all", 0, True, 16, 16, 1, 1),
            ("table", "fallback", 1, True, 10, 10, 1, 1),
            ("table", "insert", 2, True, 12, 14, 3, 1),
            ("table", "log", 2, False, 18, 19, 2, 1),
            ("table", "lookup", 1, True, 4, 8, 5, 1),
            ("table", "pure", 1, False, 21, 21, 1, 1),
        ],
    ),
    "code_module_info": (
        "module string, kind string, value string",
        [
            ("counter", "behaviour", "worker"),
            ("counter", "export", "add/2"),
            ("counter", "export", "drain/1"),
            ("counter", "export", "kind/1"),
            ("counter", "export", "loop/1"),
            ("counter", "export", "start/0"),
            ("counter", "export", "total/1"),
            ("counter", "include", "eunit/include/eunit.hrl"),
            ("counter", "spec", "add ( integer ( ) , integer ( ) ) -> integer ( )"),
            ("ledger", "export", "balance/1"),
            ("ledger", "export", "deep/3"),
            ("ledger", "export", "fold/3"),
            ("ledger", "export", "report/2"),
            ("ledger", "export", "same/1"),
            ("ledger", "record", "entry"),
            ("router", "export", "broadcast/2"),
            ("router", "export", "dispatch/3"),
            ("router", "export", "old/1"),
            ("router", "export", "route/2"),
            ("router", "export", "sum_to/1"),
            ("shapes", "compile", "export_all"),
            ("table", "export", "all/0"),
            ("table", "export", "fallback/1"),
            ("table", "export", "insert/2"),
            ("table", "export", "lookup/1"),
        ],
    ),
    "code_calls": (
        "m string, f string, a int, callee_m string, callee_f string, callee_a int, shape string, sure boolean, line int, col int",
        [
            ("counter", "drain", 1, "counter", "drain", 1, "direct", True, 25, 17),
            ("counter", "drain", 1, "io", "format", 2, "qualified", True, 26, 13),
            ("counter", "loop", 1, "counter", "loop", 1, "direct", True, 14, 13),
            ("counter", "loop", 1, "counter", "loop", 1, "direct", True, 17, 13),
            ("counter", "start", 0, "counter", "loop", 1, "spawn", True, 8, 12),
            ("counter", "start", 0, "erlang", "spawn", 3, "direct", True, 8, 12),
            ("counter", "total", 1, "erlang", "length", 1, "direct", True, 36, 11),
            ("counter", "total", 1, "io", "format", 2, "qualified", True, 38, 5),
            ("counter", "total", 1, "lists", "sum", 1, "qualified", True, 35, 11),
            ("ledger", "balance", 1, "erlang", "length", 1, "direct", True, 8, 13),
            ("ledger", "balance", 1, "io", "format", 2, "qualified", True, 10, 5),
            ("ledger", "balance", 1, "lists", "sum", 1, "qualified", True, 7, 13),
            ("ledger", "fold", 3, "ledger", "fold", 3, "direct", True, 21, 26),
            ("ledger", "fold", 3, None, None, 2, "dynamic", False, 21, 34),
            ("ledger", "report", 2, "ledger", "format", 2, "direct", True, 15, 14),
            ("ledger", "report", 2, "lists", "append", 2, "qualified", True, 16, 5),
            ("ledger", "report", 2, "lists", "reverse", 1, "direct", True, 15, 35),
            ("ledger", "same", 1, "counter", "add", 2, "qualified", True, 24, 9),
            ("router", "broadcast", 2, "lists", "foreach", 2, "qualified", True, 16, 5),
            ("router", "broadcast", 2, "router", "route", 2, "direct", True, 16, 29),
            ("router", "dispatch", 3, "counter", "add", 2, "apply3", True, 11, 5),
            ("router", "dispatch", 3, "counter", "add", 2, "qualified", True, 13, 5),
            ("router", "dispatch", 3, "erlang", "apply", 3, "direct", True, 10, 5),
            ("router", "dispatch", 3, "erlang", "apply", 3, "direct", True, 11, 5),
            ("router", "dispatch", 3, "erlang", "spawn", 3, "direct", True, 12, 5),
            ("router", "dispatch", 3, "table", "lookup", 1, "spawn", True, 12, 5),
            ("router", "dispatch", 3, None, None, None, "apply3", False, 10, 5),
            ("router", "old", 1, "dict", "fetch", 2, "qualified", True, 23, 5),
            ("router", "old", 1, "dict", "store", 3, "qualified", True, 22, 10),
            ("router", "route", 2, "table", "lookup", 1, "qualified", True, 5, 14),
            ("router", "sum_to", 1, "router", "sum_to", 1, "direct", True, 19, 18),
            ("shapes", "scale", 2, "erlang", "length", 1, "direct", True, 12, 14),
            ("shapes", "scale", 2, "io", "format", 2, "qualified", True, 14, 5),
            ("shapes", "scale", 2, "lists", "sum", 1, "qualified", True, 11, 14),
            ("table", "all", 0, "table", "lookup", 1, "direct", True, 16, 11),
            ("table", "fallback", 1, "router", "route", 2, "qualified", True, 10, 18),
            ("table", "insert", 2, "erlang", "put", 2, "direct", True, 13, 5),
            ("table", "insert", 2, "table", "log", 2, "direct", True, 14, 5),
            ("table", "log", 2, "io", "format", 2, "qualified", True, 19, 5),
            ("table", "lookup", 1, "erlang", "get", 1, "direct", True, 5, 10),
            ("table", "lookup", 1, "table", "fallback", 1, "direct", True, 6, 22),
            ("table", "pure", 1, "erlang", "length", 1, "direct", True, 21, 16),
        ],
    ),
    "code_errors": (
        "module string, message string",
        [
        ],
    ),
    "code_test_frameworks": (
        "path string, framework string",
        [
            ("src/counter.erl", "eunit"),
        ],
    ),
    "code_in_scope": (
        "module string, origin string, f string, a int",
        [
            ("counter", "counter", "add", 2),
            ("counter", "counter", "drain", 1),
            ("counter", "counter", "kind", 1),
            ("counter", "counter", "loop", 1),
            ("counter", "counter", "start", 0),
            ("counter", "counter", "total", 1),
            ("ledger", "ledger", "balance", 1),
            ("ledger", "ledger", "deep", 3),
            ("ledger", "ledger", "fold", 3),
            ("ledger", "ledger", "format", 2),
            ("ledger", "ledger", "report", 2),
            ("ledger", "ledger", "same", 1),
            ("ledger", "lists", "reverse", 1),
            ("router", "router", "broadcast", 2),
            ("router", "router", "dispatch", 3),
            ("router", "router", "old", 1),
            ("router", "router", "route", 2),
            ("router", "router", "sum_to", 1),
            ("shapes", "shapes", "area", 1),
            ("shapes", "shapes", "both", 1),
            ("shapes", "shapes", "perimeter", 1),
            ("shapes", "shapes", "scale", 2),
            ("shapes", "shapes", "simple", 1),
            ("table", "table", "all", 0),
            ("table", "table", "fallback", 1),
            ("table", "table", "insert", 2),
            ("table", "table", "log", 2),
            ("table", "table", "lookup", 1),
            ("table", "table", "pure", 1),
        ],
    ),
    "position_node": (
        "line int, col int, type string, text string",
        [
            (7, 22, "match_expr", "Total = lists:sum(Entries)"),
        ],
    ),
    "position_function": (
        "line int, m string, f string, a int",
        [
            (11, "router", "dispatch", 3),
        ],
    ),
    "position_instances": (
        "at_line int, at_col int, var string, role string, line int, col int",
        [
            (7, 5, "Total", "bind", 7, 5),
            (7, 5, "Total", "use", 9, 15),
            (7, 5, "Total", "use", 11, 6),
        ],
    ),
    "range_expressions": (
        "from_line int, from_col int, to_line int, to_col int, expressions array<string>",
        [
            (7, 1, 9, 40, ["Total = lists:sum(Entries)", "Count = length(Entries)", "Average = Total / Count"]),
        ],
    ),
    "outermost_cases": (
        "f string, a int, start_line int",
        [
            ("deep", 3, 28),
            ("lookup", 1, 5),
            ("simple", 1, 19),
        ],
    ),
    "first_calls": (
        "f string, a int, text string",
        [
            ("balance", 1, "lists:sum(Entries)"),
            ("lookup", 1, "get(Key)"),
            ("route", 2, "table:lookup(Node)"),
            ("scale", 2, "lists:sum(Shapes)"),
            ("start", 0, "spawn(counter, loop, [0])"),
        ],
    ),
    "free_variables": (
        "free array<string>, bound array<string>, exported array<string>",
        [
            ([], ["Unused"], []),
            (["Count", "Total"], ["Average"], ["Average"]),
            (["D"], ["D1"], ["D1"]),
            (["E", "Entries"], ["Lines", "X"], ["Lines"]),
            (["Entries"], ["Count"], ["Count"]),
            (["Entries"], ["Total"], ["Total"]),
            (["Id"], ["E"], ["E"]),
            (["K", "N"], ["R"], ["R"]),
            (["Len", "Sum"], ["Mean"], ["Mean"]),
            (["Node"], ["Target"], ["Target"]),
            (["Number", "Totals"], ["Ratio"], ["Ratio"]),
            (["Shapes"], ["Number"], ["Number"]),
            (["Shapes"], ["Totals"], ["Totals"]),
            (["X"], ["Y"], ["Y"]),
            (["Xs"], ["Len"], ["Len"]),
            (["Xs"], ["Sum"], ["Sum"]),
        ],
    ),
    "collect_calls": (
        "path string, rule string, f string, a int, start_line int, start_col int, end_line int, end_col int, value string",
        [
            ("src/counter.erl", "format", "drain", 1, 26, 13, 26, 39, "\"done ~p~n\""),
            ("src/counter.erl", "format", "total", 1, 38, 5, 38, 34, "\"mean ~p~n\""),
            ("src/ledger.erl", "format", "balance", 1, 10, 5, 10, 40, "\"average ~p~n\""),
            ("src/shapes.erl", "format", "scale", 2, 14, 5, 14, 36, "\"ratio ~p~n\""),
            ("src/table.erl", "format", "log", 2, 19, 5, 19, 37, "\"~s ~p~n\""),
        ],
    ),
    "collect_locations": (
        "path string, start_line int, start_col int, end_line int, end_col int",
        [
            ("src/counter.erl", 35, 5, 35, 23),
            ("src/ledger.erl", 7, 5, 7, 30),
            ("src/shapes.erl", 11, 5, 11, 30),
        ],
    ),
    "collect_sequences": (
        "path string, rule string, f string, a int, start_line int, start_col int, end_line int, end_col int, value string",
        [
            ("src/counter.erl", "0", "total", 1, 35, 5, 36, 20, "Sum = lists:sum(Xs),\n    Len = length(Xs)"),
            ("src/ledger.erl", "0", "balance", 1, 7, 5, 8, 27, "Total = lists:sum(Entries),\n    Count = length(Entries)"),
            ("src/shapes.erl", "0", "scale", 2, 11, 5, 12, 27, "Totals = lists:sum(Shapes),\n    Number = length(Shapes)"),
        ],
    ),
    "apply_shapes": (
        "path string, rule string, f string, a int, start_line int, start_col int, end_line int, end_col int, value string",
        [
            ("src/ledger.erl", "counter:add/2", "same", 1, 24, 9, 24, 25, "counter:add(X, 1)"),
            ("src/router.erl", "counter:add/2", "dispatch", 3, 11, 5, 11, 31, "apply(counter, add, [1, 2])"),
            ("src/router.erl", "counter:add/2", "dispatch", 3, 13, 5, 13, 21, "counter:add(3, 4)"),
            ("src/router.erl", "table:lookup/1", "dispatch", 3, 12, 5, 12, 32, "spawn(table, lookup, [Args])"),
            ("src/router.erl", "table:lookup/1", "route", 2, 5, 14, 5, 31, "table:lookup(Node)"),
            ("src/table.erl", "table:lookup/1", "all", 0, 16, 11, 16, 19, "lookup(K)"),
        ],
    ),
    "rewrite_rules": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 36, "    Len = erlang:length(Xs),"),
            ("src/counter.erl", "-", 36, "    Len = length(Xs),"),
            ("src/ledger.erl", "+", 8, "    Count = erlang:length(Entries),"),
            ("src/ledger.erl", "-", 8, "    Count = length(Entries),"),
            ("src/shapes.erl", "+", 12, "    Number = erlang:length(Shapes),"),
            ("src/shapes.erl", "-", 12, "    Number = length(Shapes),"),
            ("src/table.erl", "+", 21, "pure(X) -> {X, erlang:length([1, 2, 3]), 2 + 3}."),
            ("src/table.erl", "-", 21, "pure(X) -> {X, length([1, 2, 3]), 2 + 3}."),
        ],
    ),
    "symbolic_folding": (
        "path string, kind string, line int, text string",
        [
            ("src/shapes.erl", "+", 5, "area({circle, R}) -> 3 * R * R."),
            ("src/shapes.erl", "+", 8, "perimeter({circle, R}) -> 6 * R."),
            ("src/shapes.erl", "+", 18, "    Unused = 3,"),
            ("src/shapes.erl", "+", 20, "        {ok, Y} -> Y;"),
            ("src/shapes.erl", "-", 5, "area({circle, R}) -> 3 * R * R + 0."),
            ("src/shapes.erl", "-", 8, "perimeter({circle, R}) -> 2 * 3 * R."),
            ("src/shapes.erl", "-", 18, "    Unused = 1 + 2,"),
            ("src/shapes.erl", "-", 20, "        {ok, Y} -> Y + 0;"),
            ("src/table.erl", "+", 21, "pure(X) -> {X, length([1, 2, 3]), 5}."),
            ("src/table.erl", "-", 21, "pure(X) -> {X, length([1, 2, 3]), 2 + 3}."),
        ],
    ),
    "long_functions": (
        "m string, f string, a int, code_lines int",
        [
            ("ledger", "deep", 3, 13),
        ],
    ),
    "large_modules": (
        "module string, code_lines bigint",
        [
            ("counter", 39),
            ("ledger", 33),
        ],
    ),
    "nested_cases": (
        "module string, f string, a int, level bigint",
        [
            ("ledger", "deep", 3, 3),
        ],
    ),
    "function_callers": (
        "caller string, sure boolean",
        [
            ("ledger:fold/3", False),
            ("ledger:same/1", True),
            ("router:dispatch/3", True),
        ],
    ),
    "module_dependencies": (
        "kind string, module string",
        [
            ("client", "router"),
            ("server", "router"),
        ],
    ),
    "module_fan_in": (
        "module string, n bigint",
        [
            ("counter", 2),
        ],
    ),
    "module_fan_out": (
        "module string, n bigint",
        [
            ("router", 2),
        ],
    ),
    "module_graph": (
        "src string, dst string, label string",
        [
            ("ledger", "counter", "add/2"),
            ("router", "counter", "add/2"),
            ("router", "table", "lookup/1"),
            ("table", "router", "route/2"),
        ],
    ),
    "module_graph_dot": (
        "k int, line string",
        [
            (0, "digraph g {"),
            (1, "  \"ledger\" -> \"counter\" [label=\"add/2\"];"),
            (1, "  \"router\" -> \"counter\" [label=\"add/2\"];"),
            (1, "  \"router\" -> \"table\" [label=\"lookup/1\"];"),
            (1, "  \"table\" -> \"router\" [label=\"route/2\"];"),
            (2, "}"),
        ],
    ),
    "cyclic_modules": (
        "cycle array<string>, src string, dst string, weight bigint",
        [
            (["router", "table"], "router", "table", 1),
        ],
    ),
    "server_functions": (
        "mfa string, scc string",
        [
            ("counter:drain/1", "counter:drain/1"),
            ("counter:loop/1", "counter:loop/1"),
        ],
    ),
    "servers_not_flushing": (
        "mfa string",
        [
            ("counter:loop/1",),
        ],
    ),
    "non_tail_recursive": (
        "path string, f string, a int",
        [
            ("src/counter.erl", "drain", 1),
            ("src/router.erl", "sum_to", 1),
        ],
    ),
    "non_tail_recursive_servers": (
        "mfa string",
        [
            ("counter:drain/1",),
        ],
    ),
    "has_receive": (
        "module string, f string, a int, line int",
        [
            ("counter", "drain", 1, 23),
            ("counter", "loop", 1, 12),
        ],
    ),
    "top_level_if": (
        "path string, f string, a int, start_line int",
        [
            ("src/counter.erl", "kind", 1, 41),
        ],
    ),
    "append_lists": (
        "path string, rule string, f string, a int, start_line int, start_col int, end_line int, end_col int, value string",
        [
            ("src/ledger.erl", "0", "report", 2, 16, 5, 16, 28, "lists:append(Lines, [E])"),
        ],
    ),
    "unnecessary_match": (
        "path string, f string, a int, start_line int, value string",
        [
            ("src/ledger.erl", "same", 1, 24, "Y = counter:add(X, 1),\n    Y"),
        ],
    ),
    "operator_uses": (
        "module string, f string, a int, value string, start_line int, start_col int",
        [
            ("counter", "loop", 1, "!", 16, 13),
            ("router", "route", 2, "!", 6, 5),
            ("shapes", "both", 1, "++", 24, 13),
            ("shapes", "both", 1, "++", 24, 23),
        ],
    ),
    "dict_uses": (
        "m string, f string, a int, callee_f string, callee_a int, line int",
        [
            ("router", "old", 1, "fetch", 2, 23),
            ("router", "old", 1, "store", 3, 22),
        ],
    ),
    "export_all": (
        "module string",
        [
            ("shapes",),
        ],
    ),
    "behaviours": (
        "module string, behaviour string",
        [
            ("counter", "worker"),
        ],
    ),
    "api_classes": (
        "mfa string, score double, class string",
        [
            ("counter:add/2", 1.0, "api"),
            ("counter:drain/1", 1.0, "api"),
            ("counter:kind/1", 1.0, "api"),
            ("counter:loop/1", 0.6666666666666666, "non-api"),
            ("counter:start/0", 1.0, "api"),
            ("counter:total/1", 1.0, "api"),
            ("ledger:balance/1", 1.0, "api"),
            ("ledger:deep/3", 1.0, "api"),
            ("ledger:fold/3", 1.0, "api"),
            ("ledger:report/2", 1.0, "api"),
            ("ledger:same/1", 1.0, "api"),
            ("router:broadcast/2", 1.0, "api"),
            ("router:dispatch/3", 1.0, "api"),
            ("router:old/1", 1.0, "api"),
            ("router:route/2", 0.6666666666666666, "non-api"),
            ("router:sum_to/1", 1.0, "api"),
            ("shapes:area/1", 1.0, "api"),
            ("shapes:both/1", 1.0, "api"),
            ("shapes:perimeter/1", 1.0, "api"),
            ("shapes:scale/2", 1.0, "api"),
            ("shapes:simple/1", 1.0, "api"),
            ("table:all/0", 1.0, "api"),
            ("table:fallback/1", 0.5, "non-api"),
            ("table:insert/2", 1.0, "api"),
            ("table:lookup/1", 0.8, "semi-api"),
        ],
    ),
    "improper_calls": (
        "src string, dst string, functions array<string>",
        [
            ("table", "router", ["router:route/2"]),
        ],
    ),
    "component_candidates": (
        "seed string, lines bigint, others bigint",
        [
            ("ledger:format/2", 1, 0),
            ("table:log/2", 2, 0),
            ("table:pure/1", 1, 0),
        ],
    ),
    "partition_exports": (
        "m string, cluster string, members array<string>",
        [
            ("counter", "counter:add/2", ["counter:add/2"]),
            ("counter", "counter:drain/1", ["counter:drain/1"]),
            ("counter", "counter:kind/1", ["counter:kind/1"]),
            ("counter", "counter:loop/1", ["counter:loop/1", "counter:start/0"]),
            ("counter", "counter:total/1", ["counter:total/1"]),
            ("ledger", "ledger:balance/1", ["ledger:balance/1"]),
            ("ledger", "ledger:deep/3", ["ledger:deep/3"]),
            ("ledger", "ledger:fold/3", ["ledger:fold/3"]),
            ("ledger", "ledger:report/2", ["ledger:report/2"]),
            ("ledger", "ledger:same/1", ["ledger:same/1"]),
            ("router", "router:broadcast/2", ["router:broadcast/2", "router:dispatch/3", "router:route/2"]),
            ("router", "router:old/1", ["router:old/1"]),
            ("router", "router:sum_to/1", ["router:sum_to/1"]),
            ("shapes", "shapes:area/1", ["shapes:area/1"]),
            ("shapes", "shapes:both/1", ["shapes:both/1"]),
            ("shapes", "shapes:perimeter/1", ["shapes:perimeter/1"]),
            ("shapes", "shapes:scale/2", ["shapes:scale/2"]),
            ("shapes", "shapes:simple/1", ["shapes:simple/1"]),
            ("table", "table:all/0", ["table:all/0", "table:fallback/1", "table:lookup/1"]),
            ("table", "table:insert/2", ["table:insert/2"]),
        ],
    ),
    "batch_inspection": (
        "inspector string, message string",
        [
            ("export_all", "{\"module\":\"shapes\"}"),
            ("long", "{\"m\":\"ledger\",\"f\":\"deep\",\"a\":3,\"code_lines\":13}"),
            ("receive", "{\"module\":\"counter\",\"f\":\"drain\",\"a\":1,\"line\":23}"),
            ("receive", "{\"module\":\"counter\",\"f\":\"loop\",\"a\":1,\"line\":12}"),
        ],
    ),
    "callgraph_order": (
        "node string, scc string, level int",
        [
            ("counter:add/2", "counter:add/2", 0),
            ("counter:drain/1", "counter:drain/1", 0),
            ("counter:loop/1", "counter:loop/1", 0),
            ("counter:start/0", "counter:start/0", 1),
            ("ledger:fold/3", "ledger:fold/3", 0),
            ("ledger:format/2", "ledger:format/2", 0),
            ("ledger:report/2", "ledger:report/2", 1),
            ("ledger:same/1", "ledger:same/1", 1),
            ("router:broadcast/2", "router:broadcast/2", 1),
            ("router:dispatch/3", "router:dispatch/3", 1),
            ("router:route/2", "router:route/2", 0),
            ("router:sum_to/1", "router:sum_to/1", 0),
            ("table:all/0", "table:all/0", 1),
            ("table:fallback/1", "router:route/2", 0),
            ("table:insert/2", "table:insert/2", 1),
            ("table:log/2", "table:log/2", 0),
            ("table:lookup/1", "router:route/2", 0),
        ],
    ),
    "external_calls": (
        "src string, dst string",
        [
            ("counter:drain/1", "io:format/2"),
            ("counter:start/0", "erlang:spawn/3"),
            ("counter:total/1", "erlang:length/1"),
            ("counter:total/1", "io:format/2"),
            ("counter:total/1", "lists:sum/1"),
            ("ledger:balance/1", "erlang:length/1"),
            ("ledger:balance/1", "io:format/2"),
            ("ledger:balance/1", "lists:sum/1"),
            ("ledger:report/2", "lists:append/2"),
            ("ledger:report/2", "lists:reverse/1"),
            ("router:broadcast/2", "lists:foreach/2"),
            ("router:dispatch/3", "erlang:apply/3"),
            ("router:dispatch/3", "erlang:spawn/3"),
            ("router:old/1", "dict:fetch/2"),
            ("router:old/1", "dict:store/3"),
            ("shapes:scale/2", "erlang:length/1"),
            ("shapes:scale/2", "io:format/2"),
            ("shapes:scale/2", "lists:sum/1"),
            ("table:insert/2", "erlang:put/2"),
            ("table:log/2", "io:format/2"),
            ("table:lookup/1", "erlang:get/1"),
            ("table:pure/1", "erlang:length/1"),
        ],
    ),
    "similar_code": (
        "len int, freq int, au string, n_pars int, n_new_vars int, members array<string>",
        [
            (4, 3, "new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean]).", 2, 1, ["counter:total/1 35-38", "ledger:balance/1 7-10", "shapes:scale/2 11-14"]),
            (5, 2, "new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean]),\n    {Sum, Len, Mean}.", 2, 1, ["counter:total/1 35-39", "ledger:balance/1 7-11"]),
        ],
    ),
    "clone_report": (
        "freq int, len int, line string",
        [
            (2, 5, "2 times: 5 statements, 2 parameters, 1 new: new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean]),\n    {Sum, Len, Mean}."),
            (3, 4, "3 times: 4 statements, 2 parameters, 1 new: new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean])."),
        ],
    ),
    "duplicated_code": (
        "module string, len int, line int",
        [
            ("counter", 38, 34),
            ("counter", 50, 32),
            ("ledger", 32, 1),
            ("ledger", 38, 6),
            ("ledger", 50, 4),
            ("router", 32, 1),
            ("shapes", 38, 10),
        ],
    ),
    "duplicated_parts": (
        "module string, part int, start_line int, text string",
        [
            ("counter", 1, 34, "total(Xs) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(\"mean ~p~n\", [Mean]),\n    {Sum, Len, Mean}."),
            ("counter", 1, 35, "Sum = lists:sum(Xs)"),
            ("counter", 2, 36, "Len = length(Xs)"),
            ("counter", 3, 37, "Mean = Sum / Len"),
            ("counter", 4, 38, "io:format(\"mean ~p~n\", [Mean])"),
            ("counter", 5, 39, "Sum"),
            ("ledger", 1, 6, "balance(Entries) ->\n    Total = lists:sum(Entries),\n    Count = length(Entries),\n    Average = Total / Count,\n    io:format(\"average ~p~n\", [Average]),\n    {Total, Count, Average}."),
            ("ledger", 1, 7, "Total = lists:sum(Entries)"),
            ("ledger", 2, 8, "Count = length(Entries)"),
            ("ledger", 3, 9, "Average = Total / Count"),
            ("ledger", 4, 10, "io:format(\"average ~p~n\", [Average])"),
            ("ledger", 5, 11, "Total"),
            ("shapes", 1, 11, "Totals = lists:sum(Shapes)"),
            ("shapes", 2, 12, "Number = length(Shapes)"),
            ("shapes", 3, 13, "Ratio = Totals / Number"),
            ("shapes", 4, 14, "io:format(\"ratio ~p~n\", [Ratio])"),
            ("shapes", 5, 15, "Totals"),
        ],
    ),
    "duplicated_parameters": (
        "module string, part int, start_line int, n_pars int",
        [
            ("counter", 1, 35, 0),
            ("counter", 2, 36, 0),
            ("counter", 3, 37, 0),
            ("counter", 4, 38, 0),
            ("counter", 5, 39, 0),
            ("ledger", 1, 7, 0),
            ("ledger", 2, 8, 0),
            ("ledger", 3, 9, 0),
            ("ledger", 4, 10, 1),
            ("ledger", 5, 11, 0),
            ("shapes", 1, 11, 0),
            ("shapes", 2, 12, 0),
            ("shapes", 3, 13, 0),
            ("shapes", 4, 14, 1),
            ("shapes", 5, 15, 0),
        ],
    ),
    "identical_expressions": (
        "freq bigint, example string",
        [
            (2, "{Sum, Len, Mean}"),
            (3, "Average = Total / Count"),
            (3, "Count = length(Entries)"),
            (3, "Sum = lists:sum(Xs)"),
            (4, "io:format(\"average ~p~n\", [Average])"),
        ],
    ),
    "similar_expressions": (
        "m string, f string, a int, line int, text string, score double",
        [
            ("counter", "total", 1, 35, "Sum = lists:sum(Xs)", 1.0),
            ("ledger", "balance", 1, 7, "Total = lists:sum(Entries)", 1.0),
            ("shapes", "scale", 2, 11, "Totals = lists:sum(Shapes)", 1.0),
        ],
    ),
    "clone_evolution": (
        "au string, status string",
        [
            ("new_fun(Entries) ->\n    Total = lists:sum(Entries),\n    Count = length(Entries),\n    Average = Total / Count,\n    io:format(\"average ~p~n\", [Average]),\n    {Total, Count, Average}.", "new"),
            ("new_fun(Entries, NewVar_1) ->\n    Total = lists:sum(Entries),\n    Count = length(Entries),\n    Average = Total / Count,\n    io:format(NewVar_1, [Average]).", "new"),
            ("new_fun(Id, Entries) ->\n    E = #entry{id = Id, amount = 1},\n    Lines = [format(X, E) || X <- reverse(Entries)],\n    lists:append(Lines, [E]).", "new"),
            ("new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean]),\n    {Sum, Len, Mean}.", "vanished"),
            ("new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean]).", "vanished"),
        ],
    ),
    "changed_files": (
        "path string, status string",
        [
            ("src/counter.erl", "changed"),
            ("src/extra.erl", "new"),
            ("src/ledger.erl", "unchanged"),
            ("src/router.erl", "changed"),
            ("src/shapes.erl", "unchanged"),
            ("src/table.erl", "deleted"),
        ],
    ),
    "side_effects": (
        "mfa string, effect boolean",
        [
            ("counter:add/2", False),
            ("counter:drain/1", True),
            ("counter:kind/1", False),
            ("counter:loop/1", True),
            ("counter:start/0", True),
            ("counter:total/1", True),
            ("ledger:balance/1", True),
            ("ledger:deep/3", False),
            ("ledger:fold/3", None),
            ("ledger:format/2", False),
            ("ledger:report/2", False),
            ("ledger:same/1", False),
            ("router:broadcast/2", True),
            ("router:dispatch/3", True),
            ("router:old/1", False),
            ("router:route/2", True),
            ("router:sum_to/1", False),
            ("shapes:area/1", False),
            ("shapes:both/1", False),
            ("shapes:perimeter/1", False),
            ("shapes:scale/2", True),
            ("shapes:simple/1", False),
            ("table:all/0", True),
            ("table:fallback/1", True),
            ("table:insert/2", True),
            ("table:log/2", True),
            ("table:lookup/1", True),
            ("table:pure/1", False),
        ],
    ),
    "forward_slice": (
        "module string, at int, line int",
        [
            ("ledger", 7, 7),
            ("ledger", 7, 9),
            ("ledger", 7, 10),
            ("ledger", 7, 11),
        ],
    ),
    "backward_slice": (
        "module string, at int, line int",
        [
            ("ledger", 11, 6),
            ("ledger", 11, 7),
            ("ledger", 11, 8),
            ("ledger", 11, 9),
            ("ledger", 11, 11),
        ],
    ),
    "affected_functions": (
        "seed string, node string",
        [
            ("counter:add/2", "counter:add/2"),
            ("counter:add/2", "ledger:same/1"),
            ("counter:add/2", "router:dispatch/3"),
        ],
    ),
    "spawned_processes": (
        "spawner string, entry string, runs array<string>",
        [
            ("counter:start/0", "counter:loop/1", ["counter:loop/1"]),
            ("router:dispatch/3", "table:lookup/1", ["router:route/2", "table:fallback/1", "table:lookup/1"]),
        ],
    ),
    "dead_assignments": (
        "module string, f string, a int, var string, line int",
        [
            ("shapes", "simple", 1, "Unused", 18),
        ],
    ),
    "evaluation_steps": (
        "step int, expr string",
        [
            (0, "f(2) + 1"),
            (1, "2 * 3 + 1"),
            (2, "6 + 1"),
            (3, "7"),
        ],
    ),
    "refactor_rename_function": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 3, "-export([start/0, loop/1, plus/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "+", 6, "-spec plus(integer(), integer()) -> integer()."),
            ("src/counter.erl", "+", 32, "plus(A, B) -> A + B * ?STEP."),
            ("src/counter.erl", "-", 3, "-export([start/0, loop/1, add/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "-", 6, "-spec add(integer(), integer()) -> integer()."),
            ("src/counter.erl", "-", 32, "add(A, B) -> A + B * ?STEP."),
            ("src/ledger.erl", "+", 24, "    Y = counter:plus(X, 1),"),
            ("src/ledger.erl", "-", 24, "    Y = counter:add(X, 1),"),
            ("src/router.erl", "+", 11, "    apply(counter, plus, [1, 2]),"),
            ("src/router.erl", "+", 13, "    counter:plus(3, 4)."),
            ("src/router.erl", "-", 11, "    apply(counter, add, [1, 2]),"),
            ("src/router.erl", "-", 13, "    counter:add(3, 4)."),
        ],
    ),
    "refactor_rename_module": (
        "path string, kind string, line int, text string",
        [
            ("src/router.erl", "+", 5, "    Target = registry:lookup(Node),"),
            ("src/router.erl", "+", 12, "    spawn(registry, lookup, [Args]),"),
            ("src/router.erl", "-", 5, "    Target = table:lookup(Node),"),
            ("src/router.erl", "-", 12, "    spawn(table, lookup, [Args]),"),
            ("src/table.erl", "+", 1, "-module(registry)."),
            ("src/table.erl", "-", 1, "-module(table)."),
        ],
    ),
    "refactor_swap_arguments": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 32, "add(B, A) -> A + B * ?STEP."),
            ("src/counter.erl", "-", 32, "add(A, B) -> A + B * ?STEP."),
            ("src/ledger.erl", "+", 24, "    Y = counter:add(1, X),"),
            ("src/ledger.erl", "-", 24, "    Y = counter:add(X, 1),"),
            ("src/router.erl", "+", 11, "    apply(counter, add, [2, 1]),"),
            ("src/router.erl", "+", 13, "    counter:add(4, 3)."),
            ("src/router.erl", "-", 11, "    apply(counter, add, [1, 2]),"),
            ("src/router.erl", "-", 13, "    counter:add(3, 4)."),
        ],
    ),
    "refactor_add_argument": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 3, "-export([start/0, loop/1, add/3, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "+", 6, "-spec add(integer(), integer(), any()) -> integer()."),
            ("src/counter.erl", "+", 32, "add(A, B, Extra) -> A + B * ?STEP."),
            ("src/counter.erl", "-", 3, "-export([start/0, loop/1, add/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "-", 6, "-spec add(integer(), integer()) -> integer()."),
            ("src/counter.erl", "-", 32, "add(A, B) -> A + B * ?STEP."),
            ("src/ledger.erl", "+", 24, "    Y = counter:add(X, 1, undefined),"),
            ("src/ledger.erl", "-", 24, "    Y = counter:add(X, 1),"),
            ("src/router.erl", "+", 11, "    apply(counter, add, [1, 2, undefined]),"),
            ("src/router.erl", "+", 13, "    counter:add(3, 4, undefined)."),
            ("src/router.erl", "-", 11, "    apply(counter, add, [1, 2]),"),
            ("src/router.erl", "-", 13, "    counter:add(3, 4)."),
        ],
    ),
    "refactor_tuple_arguments": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 3, "-export([start/0, loop/1, add/1, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "+", 6, "-spec add({integer(), integer()}) -> integer()."),
            ("src/counter.erl", "+", 32, "add({A, B}) -> A + B * ?STEP."),
            ("src/counter.erl", "-", 3, "-export([start/0, loop/1, add/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "-", 6, "-spec add(integer(), integer()) -> integer()."),
            ("src/counter.erl", "-", 32, "add(A, B) -> A + B * ?STEP."),
            ("src/ledger.erl", "+", 24, "    Y = counter:add({X, 1}),"),
            ("src/ledger.erl", "-", 24, "    Y = counter:add(X, 1),"),
            ("src/router.erl", "+", 11, "    apply(counter, add, [{1, 2}]),"),
            ("src/router.erl", "+", 13, "    counter:add({3, 4})."),
            ("src/router.erl", "-", 11, "    apply(counter, add, [1, 2]),"),
            ("src/router.erl", "-", 13, "    counter:add(3, 4)."),
        ],
    ),
    "refactor_apply_to_remote": (
        "path string, kind string, line int, text string",
        [
            ("src/router.erl", "+", 11, "    counter:add(1, 2),"),
            ("src/router.erl", "-", 11, "    apply(counter, add, [1, 2]),"),
        ],
    ),
    "refactor_comment_out_specs": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 6, "%% -spec add(integer(), integer()) -> integer()."),
            ("src/counter.erl", "-", 6, "-spec add(integer(), integer()) -> integer()."),
        ],
    ),
    "refactor_migrate_dict": (
        "path string, kind string, line int, text string",
        [
            ("src/router.erl", "+", 22, "    D1 = maps:put(key, 1, D),"),
            ("src/router.erl", "+", 23, "    maps:get(key, D1)."),
            ("src/router.erl", "-", 22, "    D1 = dict:store(key, 1, D),"),
            ("src/router.erl", "-", 23, "    dict:fetch(key, D1)."),
        ],
    ),
    "refactor_remove_import": (
        "path string, kind string, line int, text string",
        [
            ("src/ledger.erl", "+", 14, "    Lines = [format(X, E) || X <- lists:reverse(Entries)],"),
            ("src/ledger.erl", "-", 3, "-import(lists, [reverse/1])."),
            ("src/ledger.erl", "-", 15, "    Lines = [format(X, E) || X <- reverse(Entries)],"),
        ],
    ),
    "refactor_move_function": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 3, "-export([start/0, loop/1, add/2, total/1, drain/1])."),
            ("src/counter.erl", "-", 3, "-export([start/0, loop/1, add/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "-", 41, "kind(X) ->"),
            ("src/counter.erl", "-", 42, "    if"),
            ("src/counter.erl", "-", 43, "        X > 0 -> positive;"),
            ("src/counter.erl", "-", 44, "        X < 0 -> negative;"),
            ("src/counter.erl", "-", 45, "        true -> zero"),
        ],
    ),
    "refactor_move_function_target": (
        "path string, kind string, line int, text string",
        [
            ("src/table.erl", "+", 2, "-export([lookup/1, insert/2, all/0, fallback/1, kind/1])."),
            ("src/table.erl", "+", 23, "kind(X) ->"),
            ("src/table.erl", "+", 24, "    if"),
            ("src/table.erl", "+", 25, "        X > 0 -> positive;"),
            ("src/table.erl", "+", 26, "        X < 0 -> negative;"),
            ("src/table.erl", "+", 27, "        true -> zero"),
            ("src/table.erl", "-", 2, "-export([lookup/1, insert/2, all/0, fallback/1])."),
        ],
    ),
    "copy_module": (
        "path string, line int, text string",
        [
            ("src/table2.erl", 0, "-module(table2)."),
            ("src/table2.erl", 1, "-export([lookup/1, insert/2, all/0, fallback/1])."),
            ("src/table2.erl", 2, ""),
        ],
    ),
    "refactor_rename_clash": (
        "path string, new_content string, error string",
        [
            ("table", None, "the name is in scope"),
        ],
    ),
    "refactor_rename_checked": (
        "path string, kind string, line int, text string",
        [
            ("src/counter.erl", "+", 3, "-export([start/0, loop/1, plus/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "+", 6, "-spec plus(integer(), integer()) -> integer()."),
            ("src/counter.erl", "+", 32, "plus(A, B) -> A + B * ?STEP."),
            ("src/counter.erl", "-", 3, "-export([start/0, loop/1, add/2, total/1, kind/1, drain/1])."),
            ("src/counter.erl", "-", 6, "-spec add(integer(), integer()) -> integer()."),
            ("src/counter.erl", "-", 32, "add(A, B) -> A + B * ?STEP."),
            ("src/ledger.erl", "+", 24, "    Y = counter:plus(X, 1),"),
            ("src/ledger.erl", "-", 24, "    Y = counter:add(X, 1),"),
            ("src/router.erl", "+", 11, "    apply(counter, plus, [1, 2]),"),
            ("src/router.erl", "+", 13, "    counter:plus(3, 4)."),
            ("src/router.erl", "-", 11, "    apply(counter, add, [1, 2]),"),
            ("src/router.erl", "-", 13, "    counter:add(3, 4)."),
        ],
    ),
    "rename_clashes": (
        "m string, f string, a int, new string, module string, why string",
        [
            ("counter", "total", 1, "kind", "counter", "the name is in scope"),
            ("ledger", "same", 1, "reverse", "ledger", "the name is in scope"),
            ("table", "log", 2, "insert", "table", "the name is in scope"),
        ],
    ),
    "rename_to_camel_case": (
        "m string, f string, a int, new string",
        [
            ("router", "sum_to", 1, "sumTo"),
        ],
    ),
    "behaviour_extraction": (
        "role string, line int, text string",
        [
            ("behaviour", 0, "-module(shared)."),
            ("behaviour", 1, "-export([])."),
            ("first", 0, "-module(ledger)."),
            ("first", 1, "-behaviour(shared)."),
            ("first", 2, "-export([balance/1, report/2, fold/3, same/1, deep/3])."),
            ("first", 3, "-import(lists, [reverse/1])."),
            ("first", 4, "-record(entry, {id, amount = 0, note})."),
            ("first", 6, "balance(Entries) ->"),
            ("first", 7, "    Total = lists:sum(Entries),"),
            ("first", 8, "    Count = length(Entries),"),
            ("first", 9, "    Average = Total / Count,"),
            ("first", 10, "    io:format(\"average ~p~n\", [Average]),"),
            ("first", 11, "    {Total, Count, Average}."),
            ("first", 13, "report(Id, Entries) ->"),
            ("first", 14, "    E = #entry{id = Id, amount = 1},"),
            ("first", 15, "    Lines = [format(X, E) || X <- reverse(Entries)],"),
            ("first", 16, "    lists:append(Lines, [E])."),
            ("first", 18, "format(X, #entry{amount = A}) -> {X, A}."),
            ("first", 20, "fold(_, Acc, []) -> Acc;"),
            ("first", 21, "fold(F, Acc, [H | T]) -> fold(F, F(H, Acc), T)."),
            ("first", 23, "same(X) ->"),
            ("first", 24, "    Y = counter:add(X, 1),"),
            ("first", 25, "    Y."),
            ("first", 27, "deep(A, B, C) ->"),
            ("first", 28, "    case A of"),
            ("first", 29, "        {ok, V} ->"),
            ("first", 30, "            case B of"),
            ("first", 31, "                {ok, W} ->"),
            ("first", 32, "                    case C of"),
            ("first", 33, "                        {ok, U} -> V + W + U;"),
            ("first", 34, "                        _ -> V + W"),
            ("first", 35, "                    end;"),
            ("first", 36, "                _ -> V"),
            ("first", 37, "            end;"),
            ("first", 38, "        _ -> none"),
            ("first", 39, "    end."),
            ("second", 0, "-module(shapes)."),
            ("second", 1, "-behaviour(shared)."),
            ("second", 2, "-compile(export_all)."),
            ("second", 4, "area({square, S}) -> S * S;"),
            ("second", 5, "area({circle, R}) -> 3 * R * R + 0."),
            ("second", 7, "perimeter({square, S}) -> 4 * S;"),
            ("second", 8, "perimeter({circle, R}) -> 2 * 3 * R."),
            ("second", 10, "scale(Factor, Shapes) ->"),
            ("second", 11, "    Totals = lists:sum(Shapes),"),
            ("second", 12, "    Number = length(Shapes),"),
            ("second", 13, "    Ratio = Totals / Number,"),
            ("second", 14, "    io:format(\"ratio ~p~n\", [Ratio]),"),
            ("second", 15, "    {Totals * Factor, Number, Ratio}."),
            ("second", 17, "simple(X) ->"),
            ("second", 18, "    Unused = 1 + 2,"),
            ("second", 19, "    case {ok, X} of"),
            ("second", 20, "        {ok, Y} -> Y + 0;"),
            ("second", 21, "        error -> 0"),
            ("second", 22, "    end."),
            ("second", 24, "both(Xs) -> [1, 2] ++ [3] ++ Xs."),
        ],
    ),
    "tree_mapping": (
        "type string, left_line int, right_line int, size int",
        [
            ("module_qualifier", 7, 11, 3),
            ("module_qualifier", 10, 14, 3),
        ],
    ),
    "change_candidates": (
        "path string, key_length int",
        [
            ("src/router.erl", 32),
        ],
    ),
    "attached_comments": (
        "module string, line int, value string, place string, type string, node_line int",
        [
            ("counter", 10, "%% a server that keeps messages it does not know", "before", "function", 11),
        ],
    ),
    "macro_uses": (
        "module string, f string, a int, macro string, n bigint",
        [
            ("counter", "add", 2, "STEP", 1),
        ],
    ),
    "callback_functions": (
        "module string, f string, a int, behaviour string",
        [
            ("adder", "add", 2, "worker"),
            ("adder", "start", 0, "worker"),
            ("keeper", "handle_call", 3, "gen_server"),
            ("keeper", "init", 1, "gen_server"),
        ],
    ),
    "applications_within": (
        "callee string, line int, shape string",
        [
            ("?:?/?", 10, "apply3"),
            ("counter:add/2", 11, "apply3"),
            ("counter:add/2", 13, "qualified"),
            ("erlang:apply/3", 10, "direct"),
            ("erlang:apply/3", 11, "direct"),
            ("erlang:spawn/3", 12, "direct"),
            ("table:lookup/1", 12, "spawn"),
        ],
    ),
    "pattern_kinds": (
        "module string, f string, a int, kind string",
        [
            ("counter", "add", 2, "variable"),
            ("counter", "drain", 1, "variable"),
            ("counter", "kind", 1, "variable"),
            ("counter", "loop", 1, "variable"),
            ("counter", "start", 0, "none"),
            ("counter", "total", 1, "variable"),
            ("ledger", "balance", 1, "variable"),
            ("ledger", "deep", 3, "variable"),
            ("ledger", "fold", 3, "mixed"),
            ("ledger", "format", 2, "mixed"),
            ("ledger", "report", 2, "variable"),
            ("ledger", "same", 1, "variable"),
            ("router", "broadcast", 2, "variable"),
            ("router", "dispatch", 3, "variable"),
            ("router", "old", 1, "variable"),
            ("router", "route", 2, "variable"),
            ("router", "sum_to", 1, "mixed"),
            ("shapes", "area", 1, "mixed"),
            ("shapes", "both", 1, "variable"),
            ("shapes", "perimeter", 1, "mixed"),
            ("shapes", "scale", 2, "variable"),
            ("shapes", "simple", 1, "variable"),
            ("table", "all", 0, "none"),
            ("table", "fallback", 1, "variable"),
            ("table", "insert", 2, "variable"),
            ("table", "log", 2, "variable"),
            ("table", "lookup", 1, "variable"),
            ("table", "pure", 1, "variable"),
        ],
    ),
    "common_callees": (
        "module string",
        [
            ("counter",),
        ],
    ),
    "unmoveable_functions": (
        "mfa string, why string",
        [
            ("ledger:same/1", "shared"),
            ("router:broadcast/2", "shared"),
            ("router:dispatch/3", "shared"),
            ("router:route/2", "shared"),
            ("table:all/0", "shared"),
            ("table:fallback/1", "shared"),
            ("table:lookup/1", "shared"),
        ],
    ),
    "component_of_function": (
        "node string, scc string",
        [
            ("router:route/2", "router:route/2"),
            ("table:fallback/1", "router:route/2"),
            ("table:lookup/1", "router:route/2"),
        ],
    ),
    "callers_dot": (
        "line string",
        [
            ("  \"ledger\" -> \"counter\" [label=\"add/2\"];",),
            ("  \"router\" -> \"counter\" [label=\"add/2\"];",),
        ],
    ),
    "cyclic_dot": (
        "line string",
        [
            ("  \"router\" -> \"table\" [label=\"lookup/1\"];",),
            ("  \"table\" -> \"router\" [label=\"route/2\"];",),
        ],
    ),
    "callgraph_dot": (
        "line string",
        [
            ("  \"table:all/0\" -> \"table:lookup/1\";",),
            ("  \"table:fallback/1\" -> \"router:route/2\";",),
            ("  \"table:insert/2\" -> \"table:log/2\";",),
            ("  \"table:lookup/1\" -> \"table:fallback/1\";",),
        ],
    ),
    "cycles_dot": (
        "line string",
        [
            ("  \"router\" -> \"table\" [label=\"lookup/1\", color=red];",),
            ("  \"table\" -> \"router\" [label=\"route/2\"];",),
        ],
    ),
    "label_sizes": (
        "src string, dst string, width int, height int",
        [
            ("ledger", "counter", 6, 2),
            ("router", "counter", 6, 2),
            ("router", "table", 8, 2),
            ("table", "router", 7, 2),
        ],
    ),
    "clone_evolution_csv": (
        "line string",
        [
            ("new,3",),
            ("vanished,2",),
        ],
    ),
    "expanded_macros": (
        "path string, line int, text string",
        [
            ("src/mac.erl", 0, "-module(mac)."),
            ("src/mac.erl", 1, "-record(unit,{name})."),
            ("src/mac.erl", 2, "sum(Z)->Z+length([1,2])*60."),
            ("src/mac.erl", 3, "show(Z)->ok,{\"Z+1\",Z+1}."),
            ("src/mac.erl", 4, "who()->{mac,12,base}."),
            ("src/plain.erl", 0, "-module(plain)."),
            ("src/plain.erl", 1, "f()->1."),
        ],
    ),
    "macro_definitions": (
        "path string, name string, arity int, body string",
        [
            ("src/mac.erl", "ADD", 2, "X+Y*?SCALE"),
            ("src/mac.erl", "BASE", None, "base"),
            ("src/mac.erl", "LOG", 1, "ok"),
            ("src/mac.erl", "SCALE", None, "60"),
            ("src/mac.erl", "SHOW", 1, "{??X,X}"),
        ],
    ),
    "macro_errors": (
        "path string, error string",
        [
            ("src/mac.erl", "13: no macro NONE"),
            ("src/plain.erl", "missing gone.hrl"),
        ],
    ),
    "edit_rename_variable": (
        "kind string, line int, text string",
        [
            ("+", 8, "    Surface = W * H,"),
            ("+", 9, "    Twice = Surface * 2,"),
            ("-", 8, "    Size = W * H,"),
        ],
    ),
    "edit_extract_function": (
        "kind string, line int, text string",
        [
            ("+", 8, "    Twice = double_size(W, H),"),
            ("+", 12, "double_size(W, H) ->"),
        ],
    ),
    "edit_introduce_variable": (
        "kind string, line int, text string",
        [
            ("+", 17, "    Both = S * 2,"),
            ("+", 18, "    T = Both,"),
            ("-", 17, "    T = S * 2,"),
        ],
    ),
    "edit_inline_variable": (
        "kind string, line int, text string",
        [
            ("+", 17, "    print((S * 2)),"),
            ("+", 18, "    lists:max([S, (S * 2)]),"),
            ("+", 20, "    {P, sum(A, 1), sum((S * 2), 1)}."),
            ("-", 17, "    T = S * 2,"),
            ("-", 18, "    print(T),"),
            ("-", 19, "    lists:max([S, T]),"),
            ("-", 21, "    {P, sum(A, 1), sum(T, 1)}."),
        ],
    ),
    "edit_generalise_function": (
        "kind string, line int, text string",
        [
            ("+", 10, "    print(Twice, \"~p~n\"),"),
            ("+", 13, "print(X, Format) -> io:format(Format, [X])."),
            ("+", 18, "    print(T, \"~p~n\"),"),
            ("+", 28, "    print(Twice, \"~p~n\"),"),
            ("-", 10, "    print(Twice),"),
            ("-", 13, "print(X) -> io:format(\"~p~n\", [X])."),
            ("-", 18, "    print(T),"),
            ("-", 28, "    print(Twice),"),
        ],
    ),
    "edit_fold_expression": (
        "kind string, line int, text string",
        [
            ("+", 26, "    area(Q, Q)."),
            ("-", 26, "    Size = Q * Q,"),
        ],
    ),
    "edit_fold_against_macro": (
        "kind string, line int, text string",
        [
            ("+", 9, "    Twice = ?DOUBLE(Size),"),
            ("+", 17, "    T = ?DOUBLE(S),"),
            ("+", 27, "    Twice = ?DOUBLE(Size),"),
            ("-", 9, "    Twice = Size * 2,"),
            ("-", 17, "    T = S * 2,"),
            ("-", 27, "    Twice = Size * 2,"),
        ],
    ),
    "edit_new_macro": (
        "kind string, line int, text string",
        [
            ("+", 7, "-define(TENFOLD(A), A * 10)."),
            ("+", 18, "    S = ?TENFOLD(A),"),
            ("-", 16, "    S = A * 10,"),
        ],
    ),
    "edit_specialise_function": (
        "kind string, line int, text string",
        [
            ("+", 21, "    {P, next(A), next(T)}."),
            ("+", 25, "next(A) -> A + 1."),
            ("-", 21, "    {P, sum(A, 1), sum(T, 1)}."),
        ],
    ),
    "edit_unfold_application": (
        "kind string, line int, text string",
        [
            ("+", 21, "    {P, (A + 1), (T + 1)}."),
            ("-", 21, "    {P, sum(A, 1), sum(T, 1)}."),
        ],
    ),
    "edit_add_to_export": (
        "kind string, line int, text string",
        [
            ("+", 2, "-export([area/2, main/1, sum/2, twin/1])."),
            ("-", 2, "-export([area/2, main/1, sum/2])."),
        ],
    ),
    "edit_add_import": (
        "kind string, line int, text string",
        [
            ("+", 6, "-import(io, [format/2])."),
            ("+", 14, "print(X) -> format(\"~p~n\", [X])."),
            ("-", 13, "print(X) -> io:format(\"~p~n\", [X])."),
        ],
    ),
    "edit_normalise_record": (
        "kind string, line int, text string",
        [
            ("+", 20, "    P = #point{x = S, z = 3},"),
            ("-", 20, "    P = #point{z = 3, x = S},"),
        ],
    ),
    "edit_remove_argument": (
        "kind string, line int, text string",
        [
            ("+", 2, "-export([area/2, main/1, sum/1])."),
            ("+", 21, "    {P, sum(1), sum(1)}."),
            ("+", 23, "sum(B) -> A + B."),
            ("-", 2, "-export([area/2, main/1, sum/2])."),
            ("-", 21, "    {P, sum(A, 1), sum(T, 1)}."),
            ("-", 23, "sum(A, B) -> A + B."),
        ],
    ),
    "edit_inline_all_variables": (
        "kind string, line int, text string",
        [
            ("+", 8, "    print(((W * H) * 2)),"),
            ("+", 9, "    ((W * H) * 2)."),
            ("+", 24, "    print(((Q * Q) * 2)),"),
            ("+", 25, "    ((Q * Q) * 2)."),
            ("-", 8, "    Size = W * H,"),
            ("-", 9, "    Twice = Size * 2,"),
            ("-", 10, "    print(Twice),"),
            ("-", 11, "    Twice."),
            ("-", 26, "    Size = Q * Q,"),
            ("-", 27, "    Twice = Size * 2,"),
            ("-", 28, "    print(Twice),"),
            ("-", 29, "    Twice."),
        ],
    ),
    "edit_add_callback": (
        "kind string, line int, text string",
        [
            ("+", 10, "    [{stop, 0}, {init, 1}, {step, 2}];"),
            ("-", 10, "    [{init, 1}, {step, 2}];"),
        ],
    ),
    "edit_add_callbacks": (
        "kind string, line int, text string",
        [
            ("+", 10, "    [{init, 2}, {init, 1}, {step, 2}];"),
            ("-", 10, "    [{init, 1}, {step, 2}];"),
        ],
    ),
    "edit_remove_behaviour": (
        "kind string, line int, text string",
        [
            ("-", 9, "behaviour_info(callbacks) ->"),
            ("-", 10, "    [{init, 1}, {step, 2}];"),
            ("-", 11, "behaviour_info(_) ->"),
            ("-", 12, "    undefined."),
        ],
    ),
    "edit_instantiate_calls": (
        "kind string, line int, text string",
        [
            ("+", 4, "run(Mod, X) -> inst:init(X), inst:step(X, 1), other:init(X)."),
            ("-", 4, "run(Mod, X) -> Mod:init(X), Mod:step(X, 1), other:init(X)."),
        ],
    ),
    "edit_function_to_instance": (
        "kind string, line int, text string",
        [
            ("+", 8, "    [{init, 2}, {init, 1}, {step, 2}];"),
            ("-", 7, "init(X, Y) -> {X, Y}."),
            ("-", 10, "    [{init, 1}, {step, 2}];"),
        ],
    ),
    "edit_expression_to_instance": (
        "kind string, line int, text string",
        [
            ("+", 4, "run(Mod, X) -> inst:begin_with(Mod, X), Mod:step(X, 1), other:init(X)."),
            ("+", 10, "    [{begin_with, 2}, {init, 1}, {step, 2}];"),
            ("-", 4, "run(Mod, X) -> Mod:init(X), Mod:step(X, 1), other:init(X)."),
            ("-", 10, "    [{init, 1}, {step, 2}];"),
        ],
    ),
    "edit_unfold_instance": (
        "kind string, line int, text string",
        [
            ("+", 4, "run(Mod, X) -> Mod:init(X), Mod:step(X, 1), init(X)."),
            ("+", 14, "init(A, B, C) -> {A, B, C}."),
            ("-", 4, "run(Mod, X) -> Mod:init(X), Mod:step(X, 1), other:init(X)."),
        ],
    ),
    "edit_add_operation": (
        "kind string, line int, text string",
        [
            ("+", 2, "-export([put/2, get/1, delete/1])."),
            ("+", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key()]}}, {call, ?MODULE, delete, [key()]}])."),
            ("+", 8, "precondition(_S, {call, _, delete, [_Arg1]}) ->"),
            ("+", 9, "    true;"),
            ("+", 15, "next_state(S, _V, {call, _, delete, [_Arg1]}) ->"),
            ("+", 16, "    S;"),
            ("+", 30, "delete(Arg1) ->"),
            ("+", 31, "    ?SUT:delete(Arg1)."),
            ("-", 2, "-export([put/2, get/1])."),
            ("-", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key()]}}])."),
        ],
    ),
    "edit_add_operation_argument": (
        "kind string, line int, text string",
        [
            ("+", 2, "-export([put/2, get/2])."),
            ("+", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key(), int()]}}])."),
            ("+", 10, "precondition({L, _}, {call, _, get, [K, _Default]}) ->"),
            ("+", 15, "next_state(S, _R, {call, _, get, [_K, _Default]}) ->"),
            ("+", 23, "get(K, Default) ->"),
            ("+", 24, "    ?SUT:get(K, Default)."),
            ("-", 2, "-export([put/2, get/1])."),
            ("-", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key()]}}])."),
            ("-", 10, "precondition({L, _}, {call, _, get, [K]}) ->"),
            ("-", 15, "next_state(S, _R, {call, _, get, [_K]}) ->"),
            ("-", 23, "get(K) ->"),
            ("-", 24, "    ?SUT:get(K)."),
        ],
    ),
    "edit_remove_operation": (
        "kind string, line int, text string",
        [
            ("+", 2, "-export([put/2])."),
            ("+", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}])."),
            ("+", 9, "    N < 10."),
            ("+", 12, "    {[{K, V} | L], N + 1}."),
            ("-", 2, "-export([put/2, get/1])."),
            ("-", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key()]}}])."),
            ("-", 9, "    N < 10;"),
            ("-", 10, "precondition({L, _}, {call, _, get, [K]}) ->"),
            ("-", 11, "    lists:keymember(K, 1, L)."),
            ("-", 14, "    {[{K, V} | L], N + 1};"),
            ("-", 15, "next_state(S, _R, {call, _, get, [_K]}) ->"),
            ("-", 16, "    S."),
            ("-", 23, "get(K) ->"),
            ("-", 24, "    ?SUT:get(K)."),
        ],
    ),
    "edit_swap_operation_arguments": (
        "kind string, line int, text string",
        [
            ("+", 6, "    oneof([{call, ?MODULE, put, [int(), key()]}, {2, {call, ?MODULE, get, [key()]}}])."),
            ("+", 8, "precondition({_, N}, {call, _, put, [_V, _K]}) ->"),
            ("+", 13, "next_state({L, N}, _R, {call, _, put, [V, K]}) ->"),
            ("+", 20, "put(V, K) ->"),
            ("+", 21, "    ?SUT:put(V, K)."),
            ("-", 6, "    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key()]}}])."),
            ("-", 8, "precondition({_, N}, {call, _, put, [_K, _V]}) ->"),
            ("-", 13, "next_state({L, N}, _R, {call, _, put, [K, V]}) ->"),
            ("-", 20, "put(K, V) ->"),
            ("-", 21, "    ?SUT:put(K, V)."),
        ],
    ),
    "edit_rename_operation_argument": (
        "kind string, line int, text string",
        [
            ("+", 10, "precondition({L, _}, {call, _, get, [Key]}) ->"),
            ("+", 11, "    lists:keymember(Key, 1, L)."),
            ("+", 15, "next_state(S, _R, {call, _, get, [Key]}) ->"),
            ("+", 23, "get(Key) ->"),
            ("+", 24, "    ?SUT:get(Key)."),
            ("-", 10, "precondition({L, _}, {call, _, get, [K]}) ->"),
            ("-", 11, "    lists:keymember(K, 1, L)."),
            ("-", 15, "next_state(S, _R, {call, _, get, [_K]}) ->"),
            ("-", 23, "get(K) ->"),
            ("-", 24, "    ?SUT:get(K)."),
        ],
    ),
    "edit_state_to_record": (
        "kind string, line int, text string",
        [
            ("+", 5, "-record(state, {items, size})."),
            ("+", 10, "precondition(#state{size = N}, {call, _, put, [_K, _V]}) ->"),
            ("+", 12, "precondition(#state{items = L}, {call, _, get, [K]}) ->"),
            ("+", 15, "next_state(#state{items = L, size = N}, _R, {call, _, put, [K, V]}) ->"),
            ("+", 16, "    #state{items = [{K, V} | L], size = N + 1};"),
            ("+", 20, "initial_state() -> #state{items = [], size = 0}."),
            ("-", 8, "precondition({_, N}, {call, _, put, [_K, _V]}) ->"),
            ("-", 10, "precondition({L, _}, {call, _, get, [K]}) ->"),
            ("-", 13, "next_state({L, N}, _R, {call, _, put, [K, V]}) ->"),
            ("-", 14, "    {[{K, V} | L], N + 1};"),
            ("-", 18, "initial_state() -> {[], 0}."),
        ],
    ),
    "edit_bug_conditions": (
        "kind string, line int, text string",
        [
            ("+", 2, "first(X) -> X."),
            ("+", 3, "guarded(X) when X > 1 -> 1;"),
            ("+", 5, "chosen(X) -> X."),
            ("+", 6, "listed(Xs) -> [X || X <- Xs]."),
            ("-", 2, "first(X) -> ?a_bug_1 orelse X."),
            ("-", 3, "guarded(X) when not ?a_bug_2, X > 1 -> 1;"),
            ("-", 4, "guarded(X) when ?a_bug_2 -> 2;"),
            ("-", 6, "chosen(X) -> if ?a_bug_3 -> 1; true -> X end."),
            ("-", 7, "listed(Xs) -> [X || X <- Xs, not ?b_bug_1] ++ [Y || Y <- Xs, ?b_bug_1]."),
        ],
    ),
    "edit_farm": (
        "kind string, line int, text string",
        [
            ("+", 2, "each(Xs) -> skel:run([{farm, [{seq, fun ?MODULE:f/1}], 4}], Xs)."),
            ("+", 3, "mapped(Xs) -> skel:run([{farm, [{seq, fun ?MODULE:f/1}], 4}], Xs)."),
            ("+", 5, "worker() -> {farm, [{seq, fun ?MODULE:f/1}], 4}."),
            ("-", 2, "each(Xs) -> [f(X) || X <- Xs]."),
            ("-", 3, "mapped(Xs) -> lists:map(fun ?MODULE:f/1, Xs)."),
            ("-", 5, "worker() -> {seq, fun ?MODULE:f/1}."),
        ],
    ),
    "edit_chunks": (
        "kind string, line int, text string",
        [
            ("+", 2, "each(Xs) -> skel:run([{map, [{seq, fun ?MODULE:f/1}], fun skel:partition/1, fun skel:combine/1}], skel:chunk(Xs, 10))."),
            ("+", 3, "mapped(Xs) -> skel:run([{map, [{seq, fun ?MODULE:f/1}], fun skel:partition/1, fun skel:combine/1}], skel:chunk(Xs, 10))."),
            ("-", 2, "each(Xs) -> [f(X) || X <- Xs]."),
            ("-", 3, "mapped(Xs) -> lists:map(fun ?MODULE:f/1, Xs)."),
        ],
    ),
    "edit_parallel_map": (
        "kind string, line int, text string",
        [
            ("+", 2, "each(Xs) -> skel:run([{map, [{seq, fun ?MODULE:f/1}], fun ?MODULE:split/1, fun ?MODULE:join/1}], Xs)."),
            ("+", 5, "worker() -> {map, [{seq, fun ?MODULE:f/1}], fun ?MODULE:split/1, fun ?MODULE:join/1}."),
            ("-", 2, "each(Xs) -> [f(X) || X <- Xs]."),
            ("-", 5, "worker() -> {seq, fun ?MODULE:f/1}."),
        ],
    ),
    "edit_pipe": (
        "kind string, line int, text string",
        [
            ("+", 4, "chained(Xs) -> skel:run([{pipe, [{seq, fun other:h/1}, {seq, fun ?MODULE:g/1}, {seq, fun ?MODULE:f/1}]}], Xs)."),
            ("-", 4, "chained(Xs) -> [f(g(other:h(X))) || X <- Xs]."),
        ],
    ),
    "edit_function_to_process": (
        "kind string, line int, text string",
        [
            ("+", 2, "-export([power/0, boss/0])."),
            ("+", 4, "power() ->"),
            ("+", 6, "        {From, {0, _}} ->"),
            ("+", 7, "            From ! {power_server, 1},"),
            ("+", 8, "            power();"),
            ("+", 9, "        {From, {N, M}} when N > 1 ->"),
            ("+", 10, "            From ! {power_server, N * M},"),
            ("+", 11, "            power()"),
            ("+", 15, "    Pid = spawn(server, loop, [power_rpc(power_server, {2, 3})]),"),
            ("+", 29, "power_rpc(Name, Request) ->"),
            ("+", 30, "    case whereis(Name) of"),
            ("+", 31, "        undefined ->"),
            ("+", 32, "            register(Name, spawn(fun power/0));"),
            ("+", 33, "        _ ->"),
            ("+", 34, "            ok"),
            ("+", 35, "    end,"),
            ("+", 36, "    Name ! {self(), Request},"),
            ("+", 38, "        {Name, Result} ->"),
            ("+", 39, "            Result"),
            ("-", 2, "-export([power/2, boss/0])."),
            ("-", 4, "power(0, _) -> 1;"),
            ("-", 5, "power(N, M) when N > 1 -> N * M."),
            ("-", 8, "    Pid = spawn(server, loop, [power(2, 3)]),"),
        ],
    ),
    "edit_register_process": (
        "kind string, line int, text string",
        [
            ("+", 9, "    register(counter, Pid),"),
            ("+", 10, "    counter ! {add, 2},"),
            ("-", 9, "    Pid ! {add, 2},"),
        ],
    ),
    "edit_add_tag": (
        "kind string, line int, text string",
        [
            ("+", 9, "    Pid ! {ctl, {add, 2}},"),
            ("+", 14, "        {ctl, {add, K}} -> loop(N + K);"),
            ("+", 15, "        {ctl, stop} -> ok"),
            ("-", 9, "    Pid ! {add, 2},"),
            ("-", 14, "        {add, K} -> loop(N + K);"),
            ("-", 15, "        stop -> ok"),
        ],
    ),
    "edit_rename_process": (
        "kind string, line int, text string",
        [
            ("+", 19, "    register(writer, spawn(fun() -> ok end)),"),
            ("+", 20, "    writer ! hello."),
            ("-", 19, "    register(printer, spawn(fun() -> ok end)),"),
            ("-", 20, "    printer ! hello."),
        ],
    ),
    "edit_new_let": (
        "kind string, line int, text string",
        [
            ("+", 2, "gen() -> ?LET(N, nat(), wrap(N))."),
            ("-", 2, "gen() -> wrap(nat())."),
        ],
    ),
    "edit_merge_let": (
        "kind string, line int, text string",
        [
            ("+", 4, "pair() -> ?LET({X, Y}, {nat(), int()}, ?LET(Z, vec(X), {X, Y, Z}))."),
            ("-", 4, "pair() -> ?LET(X, nat(), ?LET(Y, int(), ?LET(Z, vec(X), {X, Y, Z})))."),
        ],
    ),
    "edit_merge_forall": (
        "kind string, line int, text string",
        [
            ("+", 3, "prop() -> ?FORALL({X, Y}, {nat(), int()}, X + Y >= 0)."),
            ("-", 3, "prop() -> ?FORALL(X, nat(), ?FORALL(Y, int(), X + Y >= 0))."),
        ],
    ),
    "edit_tests_to_property": (
        "kind string, line int, text string",
        [
            ("+", 8, "prop_add() ->"),
            ("+", 9, "    ?FORALL({Arg1, Arg2}, {oneof([1, 2]), oneof([2, [3, a]])}, begin add(Arg1, Arg2), true end)."),
        ],
    ),
    "edit_migrate_regexp": (
        "kind string, line int, text string",
        [
            ("+", 3, "    case re:run(S, \"x\", [{capture, first}]) of"),
            ("+", 4, "        {match, [{From, L}]} -> A = From + 1, {A, L};"),
            ("+", 8, "    case re:run(S, \"y\", [{capture, first}]) of"),
            ("+", 10, "        {match, [{_, Len}]} -> Len"),
            ("+", 12, "parts(S) -> {ok, re:split(S, \",\", [{return, list}])}."),
            ("-", 3, "    case regexp:match(S, \"x\") of"),
            ("-", 4, "        {match, A, L} -> {A, L};"),
            ("-", 8, "    case regexp:first_match(S, \"y\") of"),
            ("-", 10, "        {match, _, Len} -> Len"),
            ("-", 12, "parts(S) -> regexp:split(S, \",\")."),
        ],
    ),
    "edit_migrate_keysearch": (
        "kind string, line int, text string",
        [
            ("+", 14, "    case lists:keyfind(K, 1, L) of false -> none; V -> V end."),
            ("-", 14, "    case lists:keysearch(K, 1, L) of"),
            ("-", 15, "        {value, V} -> V;"),
            ("-", 16, "        false -> none"),
        ],
    ),
    "edit_migrate_groups": (
        "kind string, line int, text string",
        [
            ("+", 18, "groups() -> s_group:own_nodes()."),
            ("-", 18, "groups() -> global_group:own_nodes()."),
        ],
    ),
    "fold_arithmetic_calc": (
        "kind string, line int, text string",
        [
            ("+", 2, "numbers(X) -> 7 - X * 1 + 0."),
            ("-", 2, "numbers(X) -> 1 + 2 * 3 - X * 1 + 0."),
        ],
    ),
    "fold_arithmetic_simpl": (
        "kind string, line int, text string",
        [
            ("+", 2, "numbers(X) -> 1 + 2 * 3 - X."),
            ("-", 2, "numbers(X) -> 1 + 2 * 3 - X * 1 + 0."),
        ],
    ),
    "fold_arithmetics": (
        "kind string, line int, text string",
        [
            ("+", 2, "numbers(X) -> 7 - X."),
            ("-", 2, "numbers(X) -> 1 + 2 * 3 - X * 1 + 0."),
        ],
    ),
    "fold_booleans": (
        "kind string, line int, text string",
        [
            ("+", 3, "truths(X) -> X orelse false."),
            ("+", 5, "ifs(X) -> if false -> a; true -> X end."),
            ("-", 3, "truths(X) -> (true andalso X) orelse false."),
            ("-", 5, "ifs(X) -> if 1 > 2 -> a; true -> X end."),
        ],
    ),
    "fold_case": (
        "kind string, line int, text string",
        [
            ("+", 4, "cases() -> 5."),
            ("-", 4, "cases() -> case {ok, 5} of {error, _} -> no; {ok, N} -> N end."),
        ],
    ),
    "fold_if": (
        "kind string, line int, text string",
        [
            ("+", 5, "ifs(X) -> X."),
            ("-", 5, "ifs(X) -> if 1 > 2 -> a; true -> X end."),
        ],
    ),
    "fold_lists_concat": (
        "kind string, line int, text string",
        [
            ("+", 6, "appended(Xs) -> [1, 2, 3] ++ Xs."),
            ("-", 6, "appended(Xs) -> ([1] ++ [2, 3]) ++ Xs."),
        ],
    ),
    "fold_calls": (
        "kind string, line int, text string",
        [
            ("+", 7, "called() -> 2 * 4 + 2."),
            ("-", 7, "called() -> (fun(A, B) -> A * B end)(2, 4) + length([a, b])."),
        ],
    ),
    "fold_unused": (
        "kind string, line int, text string",
        [
            ("+", 8, "unused(X) -> Z = X, Z."),
            ("-", 8, "unused(X) ->"),
            ("-", 9, "    Y = X + 1,"),
            ("-", 10, "    Z = X,"),
            ("-", 11, "    Z."),
        ],
    ),
    "fold_inline": (
        "kind string, line int, text string",
        [
            ("+", 8, "unused(X) -> X."),
            ("-", 8, "unused(X) ->"),
            ("-", 9, "    Y = X + 1,"),
            ("-", 10, "    Z = X,"),
            ("-", 11, "    Z."),
        ],
    ),
    "fold_all": (
        "kind string, line int, text string",
        [
            ("+", 2, "numbers(X) -> 7 - X."),
            ("+", 3, "truths(X) -> X orelse false."),
            ("+", 4, "cases() -> 5."),
            ("+", 5, "ifs(X) -> X."),
            ("+", 6, "appended(Xs) -> [1, 2, 3] ++ Xs."),
            ("+", 7, "called() -> 10."),
            ("+", 8, "unused(X) -> Z = X, Z."),
            ("-", 2, "numbers(X) -> 1 + 2 * 3 - X * 1 + 0."),
            ("-", 3, "truths(X) -> (true andalso X) orelse false."),
            ("-", 4, "cases() -> case {ok, 5} of {error, _} -> no; {ok, N} -> N end."),
            ("-", 5, "ifs(X) -> if 1 > 2 -> a; true -> X end."),
            ("-", 6, "appended(Xs) -> ([1] ++ [2, 3]) ++ Xs."),
            ("-", 7, "called() -> (fun(A, B) -> A * B end)(2, 4) + length([a, b])."),
            ("-", 8, "unused(X) ->"),
            ("-", 9, "    Y = X + 1,"),
            ("-", 10, "    Z = X,"),
            ("-", 11, "    Z."),
        ],
    ),
    "edit_refused": (
        "path string, error string, changed boolean",
        [
            ("src/behave.erl", "no such expression without bindings", False),
            ("src/bugs.erl", "no such expression without bindings", False),
            ("src/edit.erl", None, True),
            ("src/folds.erl", "no such expression without bindings", False),
            ("src/parallel.erl", "no such expression without bindings", False),
            ("src/regexps.erl", "no such expression without bindings", False),
            ("src/server.erl", "no such expression without bindings", False),
            ("src/store_eqc.erl", "no such expression without bindings", False),
        ],
    ),
    "edit_instance_module": (
        "line int, text string",
        [
            (0, "-module(inst)."),
            (1, "-behaviour(behave)."),
            (2, "-export([init/2])."),
            (4, "init(X, Y) -> {X, Y}."),
        ],
    ),
    "editor_actions": (
        "module string, action string, start_line int, start_col int, end_line int, end_col int, subject string",
        [
            ("ledger", "extract function", 7, 1, 11, 0, "5 statements"),
            ("ledger", "extract function", 14, 1, 16, 0, "3 statements"),
            ("ledger", "extract function", 24, 1, 25, 0, "2 statements"),
            ("ledger", "generalise function", 10, 15, 10, 28, "\"average ~p~n\""),
            ("ledger", "generalise function", 14, 34, 14, 34, "1"),
            ("ledger", "generalise function", 24, 24, 24, 24, "1"),
            ("ledger", "inline variable", 9, 5, 9, 27, "Average"),
            ("ledger", "inline variable", 14, 5, 14, 35, "E"),
            ("ledger", "move function", 6, 1, 6, 7, "balance/1"),
            ("ledger", "move function", 13, 1, 13, 6, "report/2"),
            ("ledger", "move function", 18, 1, 18, 6, "format/2"),
            ("ledger", "move function", 20, 1, 20, 4, "fold/3"),
            ("ledger", "move function", 23, 1, 23, 4, "same/1"),
            ("ledger", "move function", 27, 1, 27, 4, "deep/3"),
            ("ledger", "new variable", 7, 13, 7, 30, "lists:sum(Entries)"),
            ("ledger", "new variable", 8, 13, 8, 27, "length(Entries)"),
            ("ledger", "new variable", 9, 15, 9, 27, "Total / Count"),
            ("ledger", "new variable", 10, 5, 10, 40, "io:format(\"average ~p~n\", [Average])"),
            ("ledger", "new variable", 10, 31, 10, 39, "[Average]"),
            ("ledger", "new variable", 11, 5, 11, 27, "{Total, Count, Average}"),
            ("ledger", "new variable", 15, 14, 15, 25, "format(X, E)"),
            ("ledger", "new variable", 15, 35, 15, 50, "reverse(Entries)"),
            ("ledger", "new variable", 16, 5, 16, 28, "lists:append(Lines, [E])"),
            ("ledger", "new variable", 16, 25, 16, 27, "[E]"),
            ("ledger", "new variable", 18, 34, 18, 39, "{X, A}"),
            ("ledger", "new variable", 21, 26, 21, 46, "fold(F, F(H, Acc), T)"),
            ("ledger", "new variable", 21, 34, 21, 42, "F(H, Acc)"),
            ("ledger", "new variable", 24, 9, 24, 25, "counter:add(X, 1)"),
            ("ledger", "new variable", 33, 36, 33, 40, "V + W"),
            ("ledger", "new variable", 33, 36, 33, 44, "V + W + U"),
            ("ledger", "new variable", 34, 30, 34, 34, "V + W"),
            ("ledger", "rename function", 6, 1, 6, 7, "balance/1"),
            ("ledger", "rename function", 13, 1, 13, 6, "report/2"),
            ("ledger", "rename function", 18, 1, 18, 6, "format/2"),
            ("ledger", "rename function", 20, 1, 20, 4, "fold/3"),
            ("ledger", "rename function", 23, 1, 23, 4, "same/1"),
            ("ledger", "rename function", 27, 1, 27, 4, "deep/3"),
        ],
    ),
    "editor_action_counts": (
        "module string, action string, n bigint",
        [
            ("counter", "extract function", 3),
            ("counter", "inline variable", 1),
            ("counter", "rename function", 6),
            ("ledger", "extract function", 3),
            ("ledger", "inline variable", 2),
            ("ledger", "rename function", 6),
            ("router", "extract function", 3),
            ("router", "rename function", 5),
            ("shapes", "extract function", 2),
            ("shapes", "inline variable", 1),
            ("shapes", "rename function", 5),
            ("table", "extract function", 1),
            ("table", "rename function", 6),
        ],
    ),
    "editor_lenses": (
        "module string, line int, title string",
        [
            ("counter", 6, "comment out specification"),
            ("counter", 8, "refactor start/0"),
            ("counter", 11, "refactor loop/1"),
            ("counter", 22, "refactor drain/1"),
            ("counter", 32, "refactor add/2"),
            ("counter", 34, "refactor total/1"),
            ("counter", 41, "refactor kind/1"),
            ("ledger", 6, "refactor balance/1"),
            ("ledger", 13, "refactor report/2"),
            ("ledger", 18, "refactor format/2"),
            ("ledger", 20, "refactor fold/3"),
            ("ledger", 23, "refactor same/1"),
            ("ledger", 27, "refactor deep/3"),
            ("router", 4, "refactor route/2"),
            ("router", 9, "refactor dispatch/3"),
            ("router", 15, "refactor broadcast/2"),
            ("router", 18, "refactor sum_to/1"),
            ("router", 21, "refactor old/1"),
            ("shapes", 4, "refactor area/1"),
            ("shapes", 7, "refactor perimeter/1"),
            ("shapes", 10, "refactor scale/2"),
            ("shapes", 17, "refactor simple/1"),
            ("shapes", 24, "refactor both/1"),
            ("table", 4, "refactor lookup/1"),
            ("table", 10, "refactor fallback/1"),
            ("table", 12, "refactor insert/2"),
            ("table", 16, "refactor all/0"),
            ("table", 18, "refactor log/2"),
            ("table", 21, "refactor pure/1"),
        ],
    ),
    "editor_highlights": (
        "module string, at_line int, at_col int, line int, col int",
        [
            ("ledger", 9, 15, 7, 5),
            ("ledger", 9, 15, 9, 15),
            ("ledger", 9, 15, 11, 6),
        ],
    ),
    "semantic_tokens": (
        "module string, seq int, delta_line int, delta_col int, length int, kind int",
        [
            ("router", 1, 1, 15, 1, 5),
            ("router", 2, 0, 12, 1, 5),
            ("router", 3, 0, 13, 1, 5),
            ("router", 4, 0, 10, 1, 5),
            ("router", 5, 0, 7, 1, 5),
            ("router", 6, 2, 0, 5, 1),
            ("router", 7, 0, 6, 4, 0),
            ("router", 8, 0, 6, 3, 0),
            ("router", 9, 1, 4, 6, 0),
            ("router", 10, 0, 15, 6, 1),
            ("router", 11, 0, 7, 4, 0),
            ("router", 12, 1, 4, 6, 0),
        ],
    ),
    "tree_index": (
        "module string, key string, n bigint",
        [
            ("counter", "if_expr", 1),
            ("counter", "infix_expr", 14),
            ("counter", "match_expr", 4),
            ("counter", "receive_expr", 2),
            ("ledger", "case_expr", 3),
            ("ledger", "infix_expr", 10),
            ("ledger", "match_expr", 7),
            ("ledger", "record_expr", 2),
            ("router", "fun_expr", 1),
            ("router", "infix_expr", 8),
            ("router", "match_expr", 2),
            ("shapes", "case_expr", 1),
            ("shapes", "infix_expr", 13),
            ("shapes", "match_expr", 4),
            ("table", "case_expr", 1),
            ("table", "infix_expr", 5),
        ],
    ),
    "tree_rebuilt": (
        "module string, code string",
        [
            ("counter", "Len = length(Xs)"),
            ("counter", "Mean = Sum / Len"),
            ("counter", "R = drain(N + K)"),
            ("counter", "Sum = lists:sum(Xs)"),
            ("ledger", "Average = Total / Count"),
            ("ledger", "Count = length(Entries)"),
            ("ledger", "E = #entry{id = Id, amount = 1}"),
            ("ledger", "Lines = [format(X, E) || X <- reverse(Entries)]"),
            ("ledger", "Total = lists:sum(Entries)"),
            ("ledger", "Y = counter:add(X, 1)"),
            ("ledger", "amount = 0"),
            ("router", "D1 = dict:store(key, 1, D)"),
            ("router", "Target = table:lookup(Node)"),
            ("shapes", "Number = length(Shapes)"),
            ("shapes", "Ratio = Totals / Number"),
            ("shapes", "Totals = lists:sum(Shapes)"),
            ("shapes", "Unused = 1 + 2"),
        ],
    ),
    "tree_breadth_first": (
        "module string, rank int, type string",
        [
            ("ledger", 1, "function"),
            ("ledger", 2, "atom"),
            ("ledger", 3, "clause"),
            ("ledger", 4, "variable"),
            ("ledger", 5, "match_expr"),
            ("ledger", 6, "variable"),
            ("ledger", 7, "variable"),
            ("ledger", 8, "application"),
            ("ledger", 9, "module_qualifier"),
            ("ledger", 10, "variable"),
            ("ledger", 11, "integer"),
            ("ledger", 12, "atom"),
            ("ledger", 13, "atom"),
        ],
    ),
    "tree_clusters": (
        "module string, common boolean, size bigint, frontier bigint",
        [
            ("shapes", False, 28, 3),
            ("shapes", True, 1, 1),
            ("shapes", True, 3, 1),
            ("shapes", True, 3, 1),
        ],
    ),
    "function_blocks": (
        "module string, f string, a int, seq_id int, start int, n bigint, common boolean",
        [
            ("shapes", "area", 1, 0, 0, 1, False),
            ("shapes", "area", 1, 1, 0, 1, False),
            ("shapes", "both", 1, 0, 0, 1, False),
            ("shapes", "perimeter", 1, 0, 0, 1, False),
            ("shapes", "perimeter", 1, 1, 0, 1, False),
            ("shapes", "scale", 2, 0, 0, 4, True),
            ("shapes", "scale", 2, 0, 4, 1, False),
            ("shapes", "simple", 1, 0, 0, 2, False),
            ("shapes", "simple", 1, 1, 0, 1, False),
            ("shapes", "simple", 1, 2, 0, 1, False),
        ],
    ),
    "block_interfaces": (
        "module string, f string, a int, start int, needs array<string>, gives array<string>",
        [
            ("shapes", "area", 1, 0, [], []),
            ("shapes", "area", 1, 0, [], []),
            ("shapes", "both", 1, 0, [], []),
            ("shapes", "perimeter", 1, 0, [], []),
            ("shapes", "perimeter", 1, 0, [], []),
            ("shapes", "scale", 2, 0, ["Shapes"], ["Number", "Ratio", "Totals"]),
            ("shapes", "scale", 2, 4, ["Factor", "Number", "Ratio", "Totals"], []),
            ("shapes", "simple", 1, 0, [], []),
            ("shapes", "simple", 1, 0, [], []),
            ("shapes", "simple", 1, 0, ["X"], []),
        ],
    ),
    "argument_names": (
        "m string, f string, a int, at int, name string",
        [
            ("ledger", "balance", 1, 0, "Entries"),
            ("ledger", "deep", 3, 0, "A"),
            ("ledger", "deep", 3, 1, "B"),
            ("ledger", "deep", 3, 2, "C"),
            ("ledger", "fold", 3, 0, "F"),
            ("ledger", "fold", 3, 1, "Acc"),
            ("ledger", "fold", 3, 2, "Arg3"),
            ("ledger", "format", 2, 0, "X"),
            ("ledger", "format", 2, 1, "Arg2"),
            ("ledger", "report", 2, 0, "Id"),
            ("ledger", "report", 2, 1, "Entries"),
            ("ledger", "same", 1, 0, "X"),
            ("shapes", "area", 1, 0, "Arg1"),
            ("shapes", "both", 1, 0, "Xs"),
            ("shapes", "perimeter", 1, 0, "Arg1"),
            ("shapes", "scale", 2, 0, "Factor"),
            ("shapes", "scale", 2, 1, "Shapes"),
            ("shapes", "simple", 1, 0, "X"),
        ],
    ),
    "redirected_calls": (
        "path string, kind string, line int, text string",
        [
            ("src/table.erl", "+", 14, "    store:log(\"insert\", Key)."),
            ("src/table.erl", "+", 16, "all() -> [store:lookup(K) || K <- [a, b, c]]."),
            ("src/table.erl", "-", 14, "    log(\"insert\", Key)."),
            ("src/table.erl", "-", 16, "all() -> [lookup(K) || K <- [a, b, c]]."),
        ],
    ),
    "forward_slice_calls": (
        "module string, at int, to_module string, line int",
        [
            ("ledger", 24, "counter", 32),
            ("ledger", 24, "ledger", 24),
            ("ledger", 24, "ledger", 25),
            ("ledger", 24, "router", 11),
            ("ledger", 24, "router", 13),
        ],
    ),
    "backward_slice_calls": (
        "module string, at int, to_module string, line int",
        [
            ("table", 16, "router", 4),
            ("table", 16, "router", 5),
            ("table", 16, "router", 7),
            ("table", 16, "router", 9),
            ("table", 16, "router", 12),
            ("table", 16, "router", 15),
            ("table", 16, "router", 16),
            ("table", 16, "table", 4),
            ("table", 16, "table", 5),
            ("table", 16, "table", 6),
            ("table", 16, "table", 7),
            ("table", 16, "table", 10),
            ("table", 16, "table", 16),
        ],
    ),
    "process_order": (
        "mfa string, level int",
        [
            ("counter:loop/1", 0),
            ("counter:start/0", 1),
            ("router:broadcast/2", 1),
            ("router:dispatch/3", 1),
            ("router:route/2", 0),
            ("table:all/0", 1),
            ("table:fallback/1", 0),
            ("table:lookup/1", 0),
        ],
    ),
    "function_text": (
        "m string, f string, a int, text string",
        [
            ("ledger", "same", 1, "same(X) ->\n    Y = counter:add(X, 1),\n    Y."),
        ],
    ),
    "module_graph_updated": (
        "src string, dst string",
        [
            ("extra", "counter"),
            ("ledger", "counter"),
            ("router", "counter"),
        ],
    ),
    "edit_parallel_accumulator": (
        "line int, text string",
        [
            (0, "weigh(Items, K, Acc) ->"),
            (1, "    Parent = self(),"),
            (2, "    Pids = weigh_dispatch(Items, Parent, K),"),
            (3, "    weigh_collect(Pids, Acc)."),
            (5, "weigh_dispatch(Items, Parent, K) ->"),
            (6, "    [spawn(fun() -> weigh_worker(Item, Parent, K) end) || Item <- Items]."),
            (8, "weigh_worker(X, Parent, K) ->"),
            (9, "    Parent ! {self(), f(X) * K}."),
            (11, "weigh_collect([], Acc) ->"),
            (12, "    Acc;"),
            (13, "weigh_collect([Pid | Pids], Acc) ->"),
            (14, "    receive"),
            (15, "        {Pid, Value} ->"),
            (16, "            weigh_collect(Pids, Acc + Value)"),
            (17, "    end."),
        ],
    ),
    "bindings_of_functions": (
        "f string, a int, role string, var string, line int, col int",
        [
            ("fold", 3, "bind", "Acc", 20, 9),
            ("fold", 3, "bind", "Acc", 21, 9),
            ("fold", 3, "bind", "F", 21, 6),
            ("fold", 3, "bind", "H", 21, 15),
            ("fold", 3, "bind", "T", 21, 19),
            ("fold", 3, "use", "Acc", 20, 21),
            ("fold", 3, "use", "Acc", 21, 39),
            ("fold", 3, "use", "F", 21, 31),
            ("fold", 3, "use", "F", 21, 34),
            ("fold", 3, "use", "H", 21, 36),
            ("fold", 3, "use", "T", 21, 45),
            ("report", 2, "bind", "E", 14, 5),
            ("report", 2, "bind", "Entries", 13, 12),
            ("report", 2, "bind", "Id", 13, 8),
            ("report", 2, "bind", "Lines", 15, 5),
            ("report", 2, "bind", "X", 15, 30),
            ("report", 2, "use", "E", 15, 24),
            ("report", 2, "use", "E", 16, 26),
            ("report", 2, "use", "Entries", 15, 43),
            ("report", 2, "use", "Id", 14, 21),
            ("report", 2, "use", "Lines", 16, 18),
            ("report", 2, "use", "X", 15, 21),
            ("same", 1, "bind", "X", 23, 6),
            ("same", 1, "bind", "Y", 24, 5),
            ("same", 1, "use", "X", 24, 21),
            ("same", 1, "use", "Y", 25, 5),
        ],
    ),
    "statements_of_function": (
        "seq_id int, idx int, hash string, ntoks int, gen_text string, start_line int, end_line int",
        [
            (0, 0, "476e3ced25a72aa346e453bfb345c88e", 8, "V = lists : sum ( V )", 7, 7),
            (0, 1, "9c5a8d67509dbd74a59483b7e4eaf773", 6, "V = length ( V )", 8, 8),
            (0, 2, "41a8b0a701415807e68c2eb50219783e", 5, "V = V / V", 9, 9),
            (0, 3, "a8e8de659d388143f7bb5af0afbc57c7", 10, "io : format ( S , [ V ] )", 10, 10),
            (0, 4, "0b01ab81eb3985c1ba66b483e0a8f75c", 7, "{ V , V , V }", 11, 11),
        ],
    ),
    "atoms_of_module": (
        "module string, value string, role string, n bigint",
        [
            ("router", "add", "function", 1),
            ("router", "add", "unknown", 1),
            ("router", "apply", "function", 2),
            ("router", "broadcast", "function", 1),
            ("router", "broadcast", "unknown", 1),
            ("router", "counter", "module", 1),
            ("router", "counter", "unknown", 1),
            ("router", "dict", "module", 2),
            ("router", "dispatch", "function", 1),
            ("router", "dispatch", "unknown", 1),
            ("router", "fetch", "function", 1),
            ("router", "foreach", "function", 1),
            ("router", "key", "unknown", 2),
            ("router", "lists", "module", 1),
            ("router", "lookup", "function", 1),
            ("router", "lookup", "unknown", 1),
            ("router", "old", "function", 1),
            ("router", "old", "unknown", 1),
            ("router", "route", "function", 2),
            ("router", "route", "unknown", 1),
            ("router", "router", "unknown", 1),
            ("router", "spawn", "function", 1),
            ("router", "store", "function", 1),
            ("router", "sum_to", "function", 2),
            ("router", "sum_to", "unknown", 1),
            ("router", "table", "module", 1),
            ("router", "table", "unknown", 1),
        ],
    ),
    "nodes_of_function": (
        "depth int, type string, value string, category string, ctx string, start_line int, start_col int, end_line int, end_col int",
        [
            (0, "function", "same", "function", "form", 23, 1, 25, 6),
            (1, "atom", "same", "function_name", "function.0", 23, 1, 23, 4),
            (1, "clause", "", "clause", "function.1", 23, 1, 25, 5),
            (2, "match_expr", "=", "expression", "clause.2", 24, 5, 24, 25),
            (2, "variable", "X", "pattern", "clause.0", 23, 6, 23, 6),
            (2, "variable", "Y", "expression", "clause.2", 25, 5, 25, 5),
            (3, "application", "", "expression", "match_expr.1", 24, 9, 24, 25),
            (3, "variable", "Y", "pattern", "match_expr.0", 24, 5, 24, 5),
            (4, "integer", "1", "expression", "application.1", 24, 24, 24, 24),
            (4, "module_qualifier", "", "expression", "application.0", 24, 9, 24, 19),
            (4, "variable", "X", "expression", "application.1", 24, 21, 24, 21),
            (5, "atom", "add", "expression", "module_qualifier.1", 24, 17, 24, 19),
            (5, "atom", "counter", "expression", "module_qualifier.0", 24, 9, 24, 15),
        ],
    ),
}

_SOURCES = "src(path, content) AS (VALUES " + ", ".join(f"({_value(p)}, {_value(t)})" for p, t in corpus.FILES.items()) + ")"
_LEX = r"""%[^\n]*|"(?:[^"\\]|\\.)*"|[0-9]+\.[0-9]+|[0-9]+|[A-Z_][A-Za-z0-9_@]*|[a-z][A-Za-z0-9_@]*|\.\s+|<<|>>|->|<-|<=|=>|:=|=<|>=|=:=|=/=|==|/=|\+\+|--|\|\||[^\sA-Za-z0-9_"%]|\s+"""
_KIND = f"""CASE WHEN starts_with(v, '%') THEN 'comment' WHEN starts_with(v, '"') THEN 'string' WHEN regexp_full_match(v, '[0-9]+') THEN 'integer' WHEN regexp_matches(v, '^[A-Z_]') THEN 'var'
         WHEN v IN ({", ".join(map(_value, sorted(KEYWORDS)))}) THEN 'keyword' WHEN regexp_matches(v, '^[a-z]') THEN 'atom' WHEN regexp_matches(v, '^[.]\\s') THEN 'dot' WHEN trim(v, E' \\n') = '' THEN 'white' ELSE 'punct' END"""
_TOKENS = f"WITH {_SOURCES}, t AS (SELECT unnest(regexp_extract_all(content, {_value(_LEX)})) AS v FROM src), k AS (SELECT {_KIND} AS kind FROM t)"

SQL = {
    "code_files": f"WITH {_SOURCES} SELECT path, regexp_extract(content, '-module\\(([a-z]+)\\)', 1) AS module, 'src' AS dir, md5(content) AS digest, 'unix' AS fmt FROM src",
    "code_tokens": f"{_TOKENS} SELECT kind, count(*) AS n FROM k WHERE kind NOT IN ('comment', 'white') GROUP BY kind",
    # the white space after a dot is part of the dot here, so each dot stands for one piece of it
    "code_layout_tokens": f"{_TOKENS}, l AS (SELECT kind FROM k UNION ALL SELECT 'white' FROM k WHERE kind = 'dot') SELECT kind, count(*) AS n FROM l GROUP BY kind",
}

ORACLES.update(SQL)
ORACLES.update({name: _sql(*x) for name, x in ROWS.items()})
