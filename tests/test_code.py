"""Queries over the embedded code base against rows worked out by hand."""

import pytest

from quercus.operators import analyses, clones, inspections, lookup, pattern
from quercus.plans import corpus
from quercus.plans.code import stages
from quercus.sources.files import changed, read_files
from quercus.sources.tokenizer import scan, tokens
from quercus.trees import diff


@pytest.fixture(scope="module")
def s(spark):
    return stages(spark)


def got(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_files(spark, s, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.erl").write_bytes(b"-module(x).\r\nf() -> 1.\r\n")
    (tmp_path / "y.txt").write_text("no")
    assert got(read_files(spark, str(tmp_path)), "module", "fmt") == {("x", "dos")}
    assert got(changed(s.files, corpus.files(spark, True)), "path", "status") == {
        ("src/counter.erl", "changed"), ("src/ledger.erl", "unchanged"), ("src/router.erl", "changed"), ("src/shapes.erl", "unchanged"), ("src/table.erl", "deleted"), ("src/extra.erl", "new"),
    }


def test_tokens(spark, s):
    assert [t.value for t in scan('f(X) -> {a, 1.5, "s"}.')] == ["f", "(", "X", ")", "->", "{", "a", ",", "1.5", ",", '"s"', "}", "."]
    assert tokens(s.files, layout=True).where("kind = 'comment'").count() == 1


def test_inspections(s):
    assert got(inspections.long_functions(s, 10), "m", "f", "a") == {("ledger", "deep", 3)}
    assert got(inspections.long_functions(s, 13), "m") == set()
    assert got(inspections.nested(s, "case", 3), "module", "f", "level") == {("ledger", "deep", 3)}
    assert got(inspections.callers(s, "counter", "add", 2), "caller", "sure") == {("ledger:same/1", True), ("router:dispatch/3", True), ("ledger:fold/3", False)}
    assert got(inspections.fan_in(s, 2), "module", "n") == {("counter", 2)} and got(inspections.fan_out(s, 1), "module", "n") == {("router", 2)}
    assert got(inspections.not_flushing(s), "mfa") == {("counter:loop/1",)}
    assert got(inspections.non_tail_recursive(s), "f") == {("drain",), ("sum_to",)}
    assert got(inspections.top_level_if(s), "f") == {("kind",)}
    assert got(inspections.unnecessary_match(s), "f") == {("same",)}
    assert got(inspections.export_all(s), "module") == {("shapes",)}
    assert [r.cycle for r in inspections.cyclic_modules(s).collect()] == [["router", "table"]]
    classes = dict(got(inspections.api_classes(s), "mfa", "class"))
    assert classes["router:broadcast/2"] == "api" and classes["router:route/2"] == "non-api"


def test_calls_in_all_shapes(s):
    found = inspections.calls_to(s, [("counter", "add", 2), ("table", "lookup", 1)])
    assert got(found, "path", "rule", "start_line") == {
        ("src/ledger.erl", "counter:add/2", 24), ("src/router.erl", "counter:add/2", 11), ("src/router.erl", "counter:add/2", 13), ("src/router.erl", "table:lookup/1", 5), ("src/router.erl", "table:lookup/1", 12), ("src/table.erl", "table:lookup/1", 16),
    }


def test_positions(spark, s):
    point = s.files.where("module = 'ledger'").selectExpr("file_id", "7 line", "5 col")
    assert got(lookup.instances(s.bindings, point), "var", "line") == {("Total", 7), ("Total", 9), ("Total", 11)}
    v = lookup.free_and_exported(s.ast_nodes.where("type = 'match_expr' and text = 'Average = Total / Count'"), s.bindings)
    assert [tuple(map(tuple, r)) for r in v.select("free", "bound", "exported").collect()] == [(("Count", "Total"), ("Average",), ("Average",))]
    assert got(lookup.outermost(s.ast_nodes.where("type = 'case_expr'")), "f") == {("deep",), ("lookup",), ("simple",)}


def test_collect_and_transform(s):
    two = pattern.collect(s.files, [pattern.Collector("S@ = lists:sum(L@), N@ = length(L@)")])
    assert got(two, "path") == {("src/counter.erl",), ("src/ledger.erl",), ("src/shapes.erl",)}
    new = pattern.transform(s.files, [pattern.Rule("lists:append(A@, B@)", "A@ ++ B@")]).collect()
    assert len(new) == 1 and "Lines ++ [E]" in new[0].new_content
    with pytest.raises(ValueError):
        pattern.collect(s.files, [pattern.Collector("X@")])


def test_clones(s):
    p = clones.CloneParams(min_len=3, min_toks=15)
    found = {(r.len, r.freq): r for r in clones.similar_code(s, p).collect()}
    assert set(found) == {(4, 3), (5, 2)}
    assert {(m.m, m.f) for m in found[4, 3].members} == {("counter", "total"), ("ledger", "balance"), ("shapes", "scale")}
    assert found[5, 2].n_new_vars == 1 and found[5, 2].au.startswith("new_fun(")
    assert clones.similar_code(s, clones.CloneParams(min_toks=30)).count() == 1 and clones.similar_code(s).count() == 0
    status = {r.status for r in clones.evolution(clones.similar_code(s, p), clones.similar_code(stages(s.files.sparkSession, True), p)).collect()}
    assert "vanished" in status and "new" in status


def test_analyses(spark, s):
    effect = dict(got(analyses.side_effects(s), "mfa", "effect"))
    assert effect["ledger:fold/3"] is None and effect["table:all/0"] is True and effect["shapes:area/1"] is False
    point = spark.createDataFrame([("ledger", 7)], "module string, line int")
    assert got(analyses.slice_from(s, point), "line") == {(7,), (9,), (10,), (11,)}
    assert got(analyses.dead_assignments(s), "f", "var") == {("simple", "Unused")}
    assert got(analyses.processes(s), "spawner", "entry") == {("counter:start/0", "counter:loop/1"), ("router:dispatch/3", "table:lookup/1")}


def test_behaviour(spark):
    a = "-module(a).\nrun(X) -> step(X) + 1.\nstep(X) -> X.\n"
    b = "-module(b).\nrun(X) -> step(X) + 1.\nstep(X) -> X * 2.\n"
    head, one, two = diff.infer_behaviour(a, b, "worker")
    assert "-callback step(term()) -> term()." in head and "run(X)" in head and "-behaviour(worker)." in one and "run(X)" not in two


def test_stream(spark, tmp_path):
    from quercus.streaming.incremental import latest, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.erl").write_text("-module(a).\nf() -> g().\ng() -> 1.\n")
    out = str(tmp_path / "out")
    watch(spark, str(tmp_path / "in"), out).awaitTermination()
    assert {r.f for r in latest(spark, out, "functions").collect()} == {"f", "g"}
    (tmp_path / "in" / "b.erl").write_text("-module(b).\nh() -> 2.\n")
    watch(spark, str(tmp_path / "in"), out).awaitTermination()
    assert {r.f for r in latest(spark, out, "functions").collect()} == {"f", "g", "h"}
