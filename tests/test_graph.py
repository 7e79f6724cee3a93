import random

import pytest

from quercus.operators import graph


def brute(edges):
    own = {x for e in edges for x in e}
    reach = {v: {v} for v in own}
    for _ in own:
        for a, b in edges:
            for v in own:
                if a in reach[v]:
                    reach[v].add(b)
    return own, reach


@pytest.mark.parametrize("seed", [5, 6])
def test_against_brute_force(spark, seed):
    """Equal to a plain closure."""
    rnd = random.Random(seed)
    n = 9
    edges = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(n + 2)})
    df = spark.createDataFrame(edges, "src long, dst long")
    own, reach = brute(edges)
    assert {tuple(r) for r in graph.closure(df).collect()} == {(v, x) for v in own for x in reach[v]}
    scc = {v: min(x for x in reach[v] if v in reach[x]) for v in own}
    assert {tuple(r) for r in graph.scc(df).collect()} == set(scc.items())
    order = {r.node: r.level for r in graph.callee_first(df).collect()}
    assert all(order[a] > order[b] or scc[a] == scc[b] for a, b in edges)
    _, both = brute(edges + [(b, a) for a, b in edges])
    assert {tuple(r) for r in graph.components(df).collect()} == {(v, min(both[v])) for v in own}
    seeds = spark.createDataFrame([(edges[0][0],)], "node long")
    assert {r.node for r in graph.reachable(df, seeds).collect()} == reach[edges[0][0]]


def test_short_cycles_and_weakest_links(spark):
    df = spark.createDataFrame([("a", "b", 3), ("b", "a", 1), ("b", "c", 2), ("c", "d", 2), ("d", "b", 5), ("d", "e", 1)], "src string, dst string, weight int")
    cycles = graph.short_cycles(df)
    assert sorted(r.cycle for r in cycles.collect()) == [["a", "b"], ["b", "c", "d"]]
    assert sorted((r.src, r.dst) for r in graph.weakest_links(df, cycles).collect()) == [("b", "a"), ("b", "c")]


def test_empty_and_self_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.scc(none).count() == graph.components(none).count() == graph.closure(none).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.scc(one).collect()) == [(1, 1), (2, 2)]
    assert [r.scc for r in graph.cyclic(one, graph.scc(one)).collect()] == [1]


def test_long_ways(spark):
    """More rounds than a union of rounds holds as it is, and a cycle of many nodes."""
    n = 2 * graph.COMPACT + 3
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert {r.node: r.level for r in graph.levels(chain, graph.nodes(chain)).collect()} == {i: n - i for i in range(n + 1)}
    assert {r.label for r in graph.components(chain).collect()} == {0}
    ring = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)] + [(3, 20)], "src long, dst long")
    assert [r.cycle for r in graph.short_cycles(ring).collect()] == [list(range(9))]
    labels = graph.scc(ring)
    assert {r.node for r in graph.components_of(ring, labels, spark.createDataFrame([(4,)], "node long")).collect()} == set(range(9))
    assert graph.inside_components(ring, labels).count() == 9 and graph.into(ring, spark.createDataFrame([(20,)], "node long")).count() == 1

def test_reach_by_jumps_and_forks(spark, monkeypatch):
    """Chains into rings, forks and back: equal to a plain closure; a long chain takes few rounds."""
    rnd = random.Random(11)
    for n in (12,):
        edges = sorted({(i, rnd.randrange(n)) for i in range(n) if i % 5} | {(rnd.randrange(n), rnd.randrange(n)) for _ in range(3)})
        _, reach = brute(edges)
        df = spark.createDataFrame(edges, "src long, dst long")
        seeds = [edges[0][0], edges[2][0], edges[-1][0]]
        for back in (False, True):
            _, reach = brute([(b, a) for a, b in edges] if back else edges)
            got = [tuple(r) for r in graph.reachable(df, spark.createDataFrame([(x,) for x in seeds], "node long"), back).collect()]
            assert len(got) == len(set(got)) and set(got) == {(x, y) for x in seeds for y in reach[x]}
    made = []
    monkeypatch.setattr(graph, "staged", lambda df, what="stage", real=graph.staged: made.append(what) or real(df, what))
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert graph.reachable(chain, spark.createDataFrame([(0,)], "node long")).count() == 61
    assert made.count("front") <= 10


def test_degrees_in_small_tasks(spark, monkeypatch):
    """Edges are dealt out by their number before equal ones go; each still counts once."""
    monkeypatch.setattr(graph, "TASK_ROWS", 50)
    edges = spark.range(400).selectExpr("id % 20 as src", "id % 90 as dst")
    found = graph.degrees(edges)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    want = {(i % 20, i % 90) for i in range(400)}
    assert {tuple(r) for r in found.collect()} == {(v, sum(b == v for _, b in want), sum(a == v for a, _ in want)) for v in {x for e in want for x in e}}


def test_components_contract(spark, monkeypatch):
    """Later rounds see only the edges between roots; nodes with only themselves stay."""
    made = []
    monkeypatch.setattr(graph, "staged", lambda df, what="stage", real=graph.staged: made.append((what, (x := real(df, what)).count())) or x)
    edges = [(1, 9), (9, 2), (2, 8), (8, 3), (3, 7), (20, 20), (5, 5), (5, 3), (30, 31)]
    found = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == {(v, 1) for v in (1, 2, 3, 5, 7, 8, 9)} | {(20, 20), (30, 30), (31, 30)}
    sizes = [n for what, n in made if what == "pairs"]
    assert sizes[0] == 7 and sizes[-1] == 0 and all(b <= a // 2 for a, b in zip(sizes, sizes[1:]))
