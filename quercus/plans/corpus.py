"""A small code base of our own in two revisions, for the queries that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quercus.sources.files import from_strings
from quercus.sources.stages import Stages

COUNTER = """-module(counter).
-behaviour(worker).
-export([start/0, loop/1, add/2, total/1, kind/1, drain/1]).
-define(STEP, 2).
-include_lib("eunit/include/eunit.hrl").
-spec add(integer(), integer()) -> integer().

start() -> spawn(counter, loop, [0]).

%% a server that keeps messages it does not know
loop(N) ->
    receive
        {add, K} ->
            loop(N + K);
        {get, From} ->
            From ! {total, N},
            loop(N);
        stop ->
            ok
    end.

drain(N) ->
    receive
        {add, K} ->
            R = drain(N + K),
            io:format("done ~p~n", [R]),
            R;
        _ ->
            N
    end.

add(A, B) -> A + B * ?STEP.

total(Xs) ->
    Sum = lists:sum(Xs),
    Len = length(Xs),
    Mean = Sum / Len,
    io:format("mean ~p~n", [Mean]),
    {Sum, Len, Mean}.

kind(X) ->
    if
        X > 0 -> positive;
        X < 0 -> negative;
        true -> zero
    end.
"""

LEDGER = """-module(ledger).
-export([balance/1, report/2, fold/3, same/1, deep/3]).
-import(lists, [reverse/1]).
-record(entry, {id, amount = 0, note}).

balance(Entries) ->
    Total = lists:sum(Entries),
    Count = length(Entries),
    Average = Total / Count,
    io:format("average ~p~n", [Average]),
    {Total, Count, Average}.

report(Id, Entries) ->
    E = #entry{id = Id, amount = 1},
    Lines = [format(X, E) || X <- reverse(Entries)],
    lists:append(Lines, [E]).

format(X, #entry{amount = A}) -> {X, A}.

fold(_, Acc, []) -> Acc;
fold(F, Acc, [H | T]) -> fold(F, F(H, Acc), T).

same(X) ->
    Y = counter:add(X, 1),
    Y.

deep(A, B, C) ->
    case A of
        {ok, V} ->
            case B of
                {ok, W} ->
                    case C of
                        {ok, U} -> V + W + U;
                        _ -> V + W
                    end;
                _ -> V
            end;
        _ -> none
    end.
"""

ROUTER = """-module(router).
-export([route/2, dispatch/3, broadcast/2, sum_to/1, old/1]).

route(Node, Msg) ->
    Target = table:lookup(Node),
    Target ! Msg,
    Msg.

dispatch(M, F, Args) ->
    apply(M, F, Args),
    apply(counter, add, [1, 2]),
    spawn(table, lookup, [Args]),
    counter:add(3, 4).

broadcast(Nodes, Msg) ->
    lists:foreach(fun(N) -> route(N, Msg) end, Nodes).

sum_to(0) -> 0;
sum_to(N) -> N + sum_to(N - 1).

old(D) ->
    D1 = dict:store(key, 1, D),
    dict:fetch(key, D1).
"""

TABLE = """-module(table).
-export([lookup/1, insert/2, all/0, fallback/1]).

lookup(Key) ->
    case get(Key) of
        undefined -> fallback(Key);
        Value -> Value
    end.

fallback(Key) -> router:route(Key, {missing, Key}).

insert(Key, Value) ->
    put(Key, Value),
    log("insert", Key).

all() -> [lookup(K) || K <- [a, b, c]].

log(What, Key) ->
    io:format("~s ~p~n", [What, Key]).

pure(X) -> {X, length([1, 2, 3]), 2 + 3}.
"""

SHAPES = """-module(shapes).
-compile(export_all).

area({square, S}) -> S * S;
area({circle, R}) -> 3 * R * R + 0.

perimeter({square, S}) -> 4 * S;
perimeter({circle, R}) -> 2 * 3 * R.

scale(Factor, Shapes) ->
    Totals = lists:sum(Shapes),
    Number = length(Shapes),
    Ratio = Totals / Number,
    io:format("ratio ~p~n", [Ratio]),
    {Totals * Factor, Number, Ratio}.

simple(X) ->
    Unused = 1 + 2,
    case {ok, X} of
        {ok, Y} -> Y + 0;
        error -> 0
    end.

both(Xs) -> [1, 2] ++ [3] ++ Xs.
"""

FILES = {"src/counter.erl": COUNTER, "src/ledger.erl": LEDGER, "src/router.erl": ROUTER, "src/table.erl": TABLE, "src/shapes.erl": SHAPES}

#: The revision after: one clone less, a function more, a module gone.
LATER = {
    "src/counter.erl": COUNTER.replace("Mean = Sum / Len,", "Mean = Sum div Len,"),
    "src/ledger.erl": LEDGER,
    "src/router.erl": ROUTER.replace("old(D) ->", "fresh() -> 1.\n\nold(D) ->"),
    "src/shapes.erl": SHAPES,
    "src/extra.erl": LEDGER.replace("module(ledger)", "module(extra)"),
}


#: Behaviours of the code base and of the library, and modules that have them.
WITH_CALLBACKS = {
    "src/worker.erl": "-module(worker).\n-callback start() -> pid().\n-callback add(integer(), {integer(), integer()}) -> integer().\n",
    "src/adder.erl": "-module(adder).\n-behaviour(worker).\n-export([start/0, add/2, add/3]).\nstart() -> self().\nadd(A, {B, C}) -> A + B + C.\nadd(A, B, C) -> A + B + C.\n",
    "src/keeper.erl": "-module(keeper).\n-behaviour(gen_server).\n-export([init/1, handle_call/3]).\ninit(X) -> {ok, X}.\nhandle_call(R, _, S) -> {reply, R, S}.\nhelp(X) -> X.\n",
}

#: Modules with macros, and the headers they include.
WITH_MACROS = {
    "src/mac.erl": """-module(mac).
-include("units.hrl").
-define(ADD(X, Y), X + Y * ?SCALE).
-define(SHOW(X), {??X, X}).
-ifdef(DEBUG).
-define(LOG(M), io:format(M)).
-else.
-define(LOG(M), ok).
-endif.
sum(Z) -> ?ADD(Z, length([1, 2])).
show(Z) -> ?LOG("x"), ?SHOW(Z + 1).
who() -> {?MODULE, ?LINE, ?BASE}.
bad() -> ?NONE.
""",
    "src/plain.erl": """-module(plain).
-include("gone.hrl").
f() -> 1.
""",
}
HEADERS = {"include/units.hrl": '-include("base.hrl").\n-define(SCALE, 60).\n-record(unit, {name}).\n', "include/base.hrl": "-define(BASE, base).\n"}


def files(spark: SparkSession, later: bool = False) -> DataFrame:
    return from_strings(spark, LATER if later else FILES)


def stages(spark: SparkSession, later: bool = False) -> Stages:
    return Stages(files(spark, later), persist=False)
