"""Scripts, plug-ins, parts of clone examination, macros and names."""

import pytest

from quercus.operators import cloneparts as C
from quercus.operators import edits, plugins, refactor, scripts, statem
from quercus.operators.edits import Refused
from quercus.operators.pattern import Rule, candidates, changed_lines, rewrite_files
from quercus.plans import corpus, samples
from quercus.sources.files import from_strings
from quercus.sources.preprocess import expand, macros_used
from quercus.trees.match import parse_annotated

FILES = dict(corpus.FILES)


def test_names_follow_renamings():
    names = scripts.Names()
    out = scripts.Script([scripts.rename_module("table", "store"), scripts.rename_function("table", "lookup", 1, "find"), scripts.rename_module("store", "depot")]).run(FILES, names)
    assert names.current("table") == "depot" and names.current(("table", "lookup", 1)) == ("depot", "find", 1)
    assert "src/depot.erl" in out and "Target = depot:find(Node)" in out["src/router.erl"] and "spawn(depot, find, [Args])" in out["src/router.erl"]


def test_scripts_are_atomic_or_not():
    steps = [scripts.rename_module("table", "store"), scripts.rename_function("counter", "add", 2, "Bad")]
    assert scripts.Script(steps).run(FILES) == FILES
    assert "src/store.erl" in scripts.Script(steps, atomic=False).run(FILES)


def test_prefix_and_inline():
    out = scripts.Script([scripts.prefix_modules("app_")]).run(FILES)
    assert sorted(out) == sorted(p.replace("src/", "src/app_") for p in FILES)
    assert "app_counter:add(3, 4)" in out["src/app_router.erl"]
    assert scripts.Script([scripts.prefix_modules("app_")]).run(out) == out
    assert "g(((A + 1) * 2))" in scripts.inline_all("-module(x).\nf(A) ->\n    B = A + 1,\n    C = B * 2,\n    g(C).\n")


def test_clone_elimination():
    au = "new_fun(Xs, NewVar_1) ->\n    Sum = lists:sum(Xs),\n    Len = length(Xs),\n    Mean = Sum / Len,\n    io:format(NewVar_1, [Mean]),\n    {Sum, Len, Mean}."
    text = scripts.Script([scripts.eliminate_clones("src/counter.erl", au, "summary", [2, 1])]).run(FILES)["src/counter.erl"]
    assert 'total(Xs) ->\n    summary("mean ~p~n", Xs).' in text and "summary(NewVar_1, Xs) ->" in text


def test_rename_operation_argument():
    files = {"a.erl": samples.STORE, "b.erl": samples.BUGS}
    out = scripts.Script([scripts.rename_operation_argument("get", 1, "Key")]).run(files)
    assert "get(Key) ->" in out["a.erl"] and out["b.erl"] == files["b.erl"]
    assert statem.operations(samples.STORE) == [("get", 1), ("put", 2)]


def test_repeat_ends():
    turn = {"a": "b", "b": "a"}
    assert refactor.repeat("a", turn.__getitem__) == "a"  # comes back
    assert refactor.repeat("x", lambda t: t + "x" if len(t) < 300 else t) == "x" * 300


def test_plugins(spark):
    own = plugins.Plugins()
    own.add(plugins.Refactoring("length", rules=lambda a: [Rule("length(L@)", "erlang:length(L@)")], strategy="stop_td"))
    own.add(plugins.Refactoring("tag", prompts=("word",), check=lambda t, a: None if a.inputs[0].isalpha() else "no word", transform=lambda t, a: f"%% {a.inputs[0]}\n{t}"))
    own.add(plugins.Composite("prefix", lambda a: [scripts.prefix_modules(a.inputs[0])], ("prefix",)))
    own.add(plugins.Inspector("long", lambda s, n: s.functions.where(f"code_lines > {int(n)}"), ("lines",)))
    with pytest.raises(ValueError):
        own.add(plugins.Inspector("long", lambda s: s))
    files = from_strings(spark, {"a.erl": "f(L) -> length(L).\n", "b.erl": "f() -> 1.\n"})
    assert [tuple(r) for r in own.run("length", files).select("path", "new_content").collect()] == [("a.erl", "f(L) -> erlang:length(L).\n")]
    assert {r.error for r in own.run("tag", files, plugins.Args(("7",))).collect()} == {"no word"}
    assert plugins.difference("a\nb", own.known["tag"].apply("a\nb", plugins.Args(("w",)))) == [("+", "%% w")]
    assert "src/z_table.erl" in own.script("prefix", FILES, plugins.Args(("z_",))) and own.prompts("prefix") == ("prefix",)
    assert [r.f for r in own.inspect("long", corpus.stages(spark), 10).collect()] == ["deep"]
    with pytest.raises(Refused):
        own.known["tag"].apply("x")
    own.remove("tag")
    assert sorted(own.known) == ["length", "long", "prefix"]


def test_error_rows_and_candidates(spark):
    files = from_strings(spark, {"ok.erl": "f() -> 1.\n", "bad.erl": "-module(bad).\nf( -> .\n"})

    def edit(t):
        edits.module_of(t)
        return t.replace("1", "2")

    out = rewrite_files(files, edit)
    rows = {r.path: r for r in out.collect()}
    assert rows["ok.erl"].error is None and rows["bad.erl"].new_content is None and "parse" in rows["bad.erl"].error
    assert sorted(tuple(r) for r in changed_lines(out).collect()) == [("ok.erl", "+", 1, "f() -> 2."), ("ok.erl", "-", 1, "f() -> 1.")]
    own = candidates(out)
    assert own.count() == 1 and candidates(out, own.select("key")).count() == 0


def test_splitting_runs():
    a = parse_annotated("A = f(X), B = g(A, 1), C = h(B), D = k(C, x, y)")
    b = parse_annotated("P = f(Y), Q = g(P, 2), R = h(P), T = k(R, z, w)")
    assert C.split_by_conflict(a, b) == [(0, 2), (2, 4)]  # B stands for Q and for P
    assert C.split_by_conflict(a[:1] + a[2:], b[:1] + parse_annotated("k(1)") + b[3:]) == [(0, 1), (2, 3)]
    assert C.split_by_new_vars([(("1", "2"),), (("3", "4"),), (), (("5", "6"),)], 2) == [(0, 3), (1, 4)]
    assert C.split_by_new_vars([(("1", "2"), ("3", "4"))], 1) == []
    assert C.split_by_similarity([1, 1, 0.2, 1, 1, 1], 0.9, 2) == [(0, 2), (3, 6)]
    runs = C.pair_runs(a, b, 1, 4, 0.5)
    assert [(r.start, r.end) for r in runs] == [(0, 2), (2, 4)] and [r.new_vars for r in runs] == [1, 2]
    assert C.pack_under_budget(runs, 2) == runs[:1] and C.pack_under_budget(runs, 3) == runs


def test_new_names():
    assert edits.new_name("X", {"X", "X_1"}) == "X_1_1"
    it = edits.numbered({"NewVar_2"})
    assert [next(it), next(it)] == ["NewVar_1", "NewVar_3"]


def test_macros():
    e = expand("-define(A(X), {X, ??X}).\n-ifndef(B).\n-define(B, ?A(1)).\n-endif.\nf() -> ?B, ?A(g(1, [2, 3])).\n-undef(B).\ng() -> ?B.\n-define(C, ?C).\nh() -> ?C.\n-ifdef(B).\n")
    assert e.text == 'f()->{1,"1"},{g(1,[2,3]),"g(1,[2,3])"}.\n'
    assert e.errors == ["7: no macro B", "8: the macro C uses itself", "a condition does not end"]
    assert macros_used('f() -> ?X, "?No", ??Y, ?X(?Z).') == ["X", "Z"]
    both = {"a/h.hrl": '-include("b.hrl").\n', "a/b.hrl": '-include("h.hrl").\n-define(W, 3).\n'}
    assert expand('-include("h.hrl").\nf() -> ?W.\n', both).text == "f()->3.\n"
