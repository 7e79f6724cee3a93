"""Small modules of our own, one for each kind of edit, and what is edited in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.operators import behaviours, pattern, processes, properties, refactor, scripts, skeletons, statem, symbolic
from quercus.plans.registry import query
from quercus.sources.files import from_strings

EDIT = """-module(edit).
-export([area/2, main/1, sum/2]).
-import(lists, [reverse/1]).
-record(point, {x, y = 0, z}).
-define(DOUBLE(X), X * 2).

area(W, H) ->
    Size = W * H,
    Twice = Size * 2,
    print(Twice),
    Twice.

print(X) -> io:format("~p~n", [X]).

main(A) ->
    S = A * 10,
    T = S * 2,
    print(T),
    lists:max([S, T]),
    P = #point{z = 3, x = S},
    {P, sum(A, 1), sum(T, 1)}.

sum(A, B) -> A + B.

twin(Q) ->
    Size = Q * Q,
    Twice = Size * 2,
    print(Twice),
    Twice.

back(L) -> reverse(L).
"""

BEHAVE = """-module(behave).
-export([run/2]).

run(Mod, X) -> Mod:init(X), Mod:step(X, 1), other:init(X).

init(X) -> X.
init(X, Y) -> {X, Y}.

behaviour_info(callbacks) ->
    [{init, 1}, {step, 2}];
behaviour_info(_) ->
    undefined.
"""

STORE = """-module(store_eqc).
-export([put/2, get/1]).
-define(SUT, store).

command(_S) ->
    oneof([{call, ?MODULE, put, [key(), int()]}, {2, {call, ?MODULE, get, [key()]}}]).

precondition({_, N}, {call, _, put, [_K, _V]}) ->
    N < 10;
precondition({L, _}, {call, _, get, [K]}) ->
    lists:keymember(K, 1, L).

next_state({L, N}, _R, {call, _, put, [K, V]}) ->
    {[{K, V} | L], N + 1};
next_state(S, _R, {call, _, get, [_K]}) ->
    S.

initial_state() -> {[], 0}.

put(K, V) ->
    ?SUT:put(K, V).

get(K) ->
    ?SUT:get(K).
"""

BUGS = """-module(bugs).
first(X) -> ?a_bug_1 orelse X.
guarded(X) when not ?a_bug_2, X > 1 -> 1;
guarded(X) when ?a_bug_2 -> 2;
guarded(_) -> 3.
chosen(X) -> if ?a_bug_3 -> 1; true -> X end.
listed(Xs) -> [X || X <- Xs, not ?b_bug_1] ++ [Y || Y <- Xs, ?b_bug_1].
"""

PARALLEL = """-module(parallel).
each(Xs) -> [f(X) || X <- Xs].
mapped(Xs) -> lists:map(fun ?MODULE:f/1, Xs).
chained(Xs) -> [f(g(other:h(X))) || X <- Xs].
worker() -> {seq, fun ?MODULE:f/1}.
weigh([], _, Acc) -> Acc;
weigh([X | Xs], K, Acc) -> weigh(Xs, K, Acc + f(X) * K).
"""

SERVER = """-module(server).
-export([power/2, boss/0]).

power(0, _) -> 1;
power(N, M) when N > 1 -> N * M.

boss() ->
    Pid = spawn(server, loop, [power(2, 3)]),
    Pid ! {add, 2},
    Pid.

loop(N) ->
    receive
        {add, K} -> loop(N + K);
        stop -> ok
    end.

named() ->
    register(printer, spawn(fun() -> ok end)),
    printer ! hello.
"""

PROPERTIES = """-module(properties).
gen() -> wrap(nat()).
prop() -> ?FORALL(X, nat(), ?FORALL(Y, int(), X + Y >= 0)).
pair() -> ?LET(X, nat(), ?LET(Y, int(), ?LET(Z, vec(X), {X, Y, Z}))).
add_test() -> 3 = add(1, 2), 5 = add(2, [3, a]).
add(A, B) -> A + B.
"""

REGEXPS = """-module(regexps).
found(S) ->
    case regexp:match(S, "x") of
        {match, A, L} -> {A, L};
        nomatch -> none
    end.
length_of(S) ->
    case regexp:first_match(S, "y") of
        nomatch -> 0;
        {match, _, Len} -> Len
    end.
parts(S) -> regexp:split(S, ",").
search(K, L) ->
    case lists:keysearch(K, 1, L) of
        {value, V} -> V;
        false -> none
    end.
groups() -> global_group:own_nodes().
"""

FOLDS = """-module(folds).
numbers(X) -> 1 + 2 * 3 - X * 1 + 0.
truths(X) -> (true andalso X) orelse false.
cases() -> case {ok, 5} of {error, _} -> no; {ok, N} -> N end.
ifs(X) -> if 1 > 2 -> a; true -> X end.
appended(Xs) -> ([1] ++ [2, 3]) ++ Xs.
called() -> (fun(A, B) -> A * B end)(2, 4) + length([a, b]).
unused(X) ->
    Y = X + 1,
    Z = X,
    Z.
"""

SAMPLES = {
    "src/edit.erl": EDIT, "src/behave.erl": BEHAVE, "src/store_eqc.erl": STORE, "src/bugs.erl": BUGS, "src/parallel.erl": PARALLEL,
    "src/server.erl": SERVER, "src/properties.erl": PROPERTIES, "src/regexps.erl": REGEXPS, "src/folds.erl": FOLDS,
}

R, B, S, K, P, Q = refactor, behaviours, statem, skeletons, processes, properties

#: Name of the query: the file and the edit.
EDITS = {
    "rename_variable": ("edit", lambda t: R.rename_variable(t, 8, 5, "Surface")),
    "extract_function": ("edit", lambda t: R.extract_function(t, (8, 9), "double_size")),
    "introduce_variable": ("edit", lambda t: R.introduce_variable(t, 17, "S * 2", "Both")),
    "inline_variable": ("edit", lambda t: R.inline_variable(t, 17)),
    "generalise_function": ("edit", lambda t: R.generalise_function(t, "edit", "print", 1, '"~p~n"', "Format")),
    "fold_expression": ("edit", lambda t: R.fold_against(t, "area", 2)),
    "fold_against_macro": ("edit", lambda t: R.fold_against_macro(t, "DOUBLE")),
    "new_macro": ("edit", lambda t: R.new_macro(t, "A * 10", "TENFOLD")),
    "specialise_function": ("edit", lambda t: R.specialise(t, "sum", 2, 2, "1", "next")),
    "unfold_application": ("edit", lambda t: R.unfold(t, 21)),
    "add_to_export": ("edit", lambda t: R.add_export(t, "twin", 1)),
    "add_import": ("edit", lambda t: R.add_import(t, "io")),
    "normalise_record": ("edit", lambda t: R.normalise_record(t, "point")),
    "remove_argument": ("edit", lambda t: R.remove_argument(t, "edit", "sum", 2, 1, force=True)),
    "inline_all_variables": ("edit", lambda t: scripts.inline_all(t, lambda v: v in ("Twice", "Size"))),
    "add_callback": ("behave", lambda t: B.add_callback(t, "stop", 0)),
    "add_callbacks": ("behave", lambda t: B.add_callbacks(t, "init")),
    "remove_behaviour": ("behave", B.remove_declaration),
    "instantiate_calls": ("behave", lambda t: B.instantiate_calls(t, "inst")),
    "function_to_instance": ("behave", lambda t: B.function_to_instance(t, "init", 2, "inst")[0]),
    "expression_to_instance": ("behave", lambda t: B.expression_to_instance(t, 4, "begin_with", "behave", "inst")[0]),
    "unfold_instance": ("behave", lambda t: B.unfold_instance(t, "-module(other).\n-behaviour(behave).\n-export([init/3]).\n\ninit(A, B, C) -> {A, B, C}.\n", "behave")),
    "add_operation": ("store_eqc", lambda t: S.add_operation(t, "delete", ["key()"])),
    "add_operation_argument": ("store_eqc", lambda t: S.add_argument(t, "get", 2, "Default", "int()")),
    "remove_operation": ("store_eqc", lambda t: S.remove_operation(t, "get")),
    "swap_operation_arguments": ("store_eqc", lambda t: S.swap_arguments(t, "put", [2, 1])),
    "rename_operation_argument": ("store_eqc", lambda t: S.rename_argument(t, "get", 1, "Key")),
    "state_to_record": ("store_eqc", lambda t: Q.statem_to_record(t, "state", ["items", "size"])),
    "bug_conditions": ("bugs", S.bug_conditions),
    "farm": ("parallel", lambda t: K.farm(t, 4)),
    "chunks": ("parallel", lambda t: K.chunk(K.farm(t, 4, 3), 10)),
    "parallel_map": ("parallel", lambda t: K.parallel_map(t, "f", "split", "join")),
    "pipe": ("parallel", K.pipe),
    "function_to_process": ("server", lambda t: P.function_to_process(t, "power", 2, "power_server")),
    "register_process": ("server", lambda t: P.register_process(t, 8, "counter")),
    "add_tag": ("server", lambda t: P.add_tag(t, "loop", 1, "ctl")),
    "rename_process": ("server", lambda t: R.rename_process(t, "printer", "writer")),
    "new_let": ("properties", lambda t: Q.new_let(t, 2, "nat()", "N")),
    "merge_let": ("properties", Q.merge_let),
    "merge_forall": ("properties", Q.merge_forall),
    "tests_to_property": ("properties", lambda t: Q.tests_to_property(t, "add", 2)),
    "migrate_regexp": ("regexps", lambda t: R.migrate(t, "regexp to re")),
    "migrate_keysearch": ("regexps", lambda t: R.migrate(t, "keysearch to keyfind")),
    "migrate_groups": ("regexps", lambda t: R.migrate(t, "global groups to s_groups")),
}
RULES = ("arithmetic_calc", "arithmetic_simpl", "arithmetics", "booleans", "case", "if", "lists_concat", "calls", "unused", "inline", "all")


def samples(spark) -> DataFrame:
    return from_strings(spark, SAMPLES)


def _edited(name: str, edit):
    def run(spark, sf_dir):
        files = samples(spark).where(F.col("module") == name)
        return pattern.changed_lines(pattern.rewrite_files(files, edit)).select("kind", "line", "text")

    return run


for _name, (_file, _edit) in EDITS.items():
    query(f"edit_{_name}")(_edited(_file, _edit))
for _name in RULES:
    query(f"fold_{_name}")(lambda spark, sf_dir, n=_name: pattern.changed_lines(symbolic.fold(samples(spark).where("module = 'folds'"), n)).select("kind", "line", "text"))


@query("edit_refused")
def edit_refused(spark, sf_dir):
    """A file that an edit refuses has a row with the reason; the others are edited."""
    return refactor.everywhere(samples(spark), lambda t: refactor.new_macro(t, "A * 10", "TENFOLD"), "f").select("path", "error", F.col("new_content").isNotNull().alias("changed"))


@query("edit_instance_module")
def edit_instance_module(spark, sf_dir):
    """The instance that takes a function of a behaviour module, and an empty one."""
    made = pattern.rewrite_files(samples(spark).where("module = 'behave'"), lambda t: behaviours.function_to_instance(t, "init", 2, "inst")[1])
    return made.select(F.posexplode(F.split("new_content", "\n")).alias("line", "text")).where("text <> ''")


@query("edit_parallel_accumulator")
def edit_parallel_accumulator(spark, sf_dir):
    """The functions that would run an accumulating recursion in parallel."""
    made = pattern.rewrite_files(samples(spark).where("module = 'parallel'"), lambda t: skeletons.parallel_accumulator(t, "weigh", 3))
    return made.select(F.posexplode(F.split("new_content", "\n")).alias("line", "text")).where("text <> ''")
