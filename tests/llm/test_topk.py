import math
import random

import numpy as np
import pytest

from quercus.llm import topk as t


def brute(rows, queries, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted({(i, tuple(v)) for i, v in ok})
    out = []
    for q, v in ok:
        if q in queries:
            best = {}
            for i, w in ok:
                if i != q and len(w) == len(v):
                    best[i] = max(best.get(i, -math.inf), sum(a * b for a, b in zip(v, w, strict=True)))
            s = sorted((-x, i) for i, x in best.items())
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 1000, 10**6])
def test_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(t, "BUCKET", 16)
    monkeypatch.setattr(t, "BLOCK", 4)
    monkeypatch.setattr(t, "GROUP_BYTES", 400)  # several rounds
    rnd = random.Random(scale)
    rows = []
    for i in range(220):
        v = [rnd.gauss(0, 1) * scale * 10 ** rnd.uniform(-2, 0) for _ in range(6)]
        rows.append((i, v if i % 7 else [round(x) * 1.0 for x in v]))
    rows += [(300 + i, rows[5][1]) for i in range(9)] + [(400, None), (401, [None] * 6), (402, [math.nan] * 6), (403, [math.inf] * 6), (404, [0.0] * 6), (405, [1.0, 2.0]), (450, [3.0, -2.0]), (None, [1.0] * 6), (5, rows[5][1]), (33, [scale * 3.0] * 6), (44, [scale * 2.5] * 6), (500, []), (550, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    queries = {i for i, _ in rows if i is not None and i % 10 == 0} | {404, 405}
    got = t.top_k(df, df.where(df.vec_id.isin(sorted(queries))))
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 5)
    assert t.top_k(df.limit(0), df).count() == 0


def test_pruning_loses_nothing():
    rnd = np.random.default_rng(1)
    c = rnd.integers(-300, 300, (500, 8))
    q = c[:40] + rnd.integers(-9, 9, (40, 8))
    s = q @ c.T
    for k, low in ((1, 0), (5, 20), (3, 450)):
        bound = np.sort(s, axis=1)[:, -k].astype(float) - low
        a, b, x = t.search(np.arange(1000, 1040), q, bound, np.arange(500), c, k)
        found = set(zip((a - 1000).tolist(), b.tolist(), x.tolist(), strict=True))
        for i in range(40):
            for j in np.argsort(-s[i])[:k]:
                assert (i, j, s[i, j]) in found


def test_many_equal_vectors(spark, monkeypatch):
    """Ties of a third of the rows: the smaller ids win, and no group returns more than k rows a query."""
    rnd = random.Random(8)
    rows = [(i, [1.0, 2.0, 0.5] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(3)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = {i for i, _ in rows if i % 50 == 0}
    got = t.top_k(df, df.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 5)
    q, c, s = t.best((np.zeros(9, int), np.asarray([5, 4, 3, 2, 1, 1, 7, 8, 9]), np.asarray([1, 1, 1, 1, 0, 1, 5, 0, 1])), 3)
    assert c.tolist() == [7, 1, 2] and s.tolist() == [5, 1, 1]
