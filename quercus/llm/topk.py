"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets of a fixed number of rows;
neighbouring buckets make a group of a fixed size. Groups are met in rounds, the
longest vectors first, twice as many in each round; a round raises each query's
lower bound on its k-th score. In a bucket, that bound over (query length times
the bucket's longest vector) is a local cosine threshold: above 1 the bucket is
skipped for the query; high thresholds prune by coordinates (a unit vector
within the threshold must lie in an interval around the query's value on its
largest coordinates), low ones by length only; what is left is verified by exact
integer products. A block of queries goes once to each group, and not at all to
groups that are too short for it; vectors move as the narrowest integers that
hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.common import bounded, trimmed, written

BUCKET, BLOCK, FOCUS, COORDINATES, SALTS = 2048, 512, 4, 0.6, 64
GROUP_BYTES = 1 << 25  # of the vectors of a group
LEAST = np.iinfo(np.int64).min
Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # query, candidate, score


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``id, v`` (array of long), without null vectors and those with null or non-finite components."""
    v = F.col(vec_col)
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows; floating point only where every partial sum is exact in it."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 24:
        return np.rint(q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)  # raises where a score is no long


def best(found: Found, k: int) -> Found:
    """The k best candidates of each query: each candidate once, by its highest score; ties to the smaller one."""
    q, c, s = found
    by = np.lexsort((-s, c, q))
    q, c, s = q[by], c[by], s[by]
    new = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])) if len(q) else np.zeros(0, bool)
    q, c, s = q[new], c[new], s[new]
    by = np.lexsort((c, -s, q))
    q, c, s = q[by], c[by], s[by]
    start = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
    at = np.arange(len(q))
    keep = at - np.maximum.accumulate(np.where(start, at, 0)) < k
    return q[keep], c[keep], s[keep]


def _near_coordinates(u: np.ndarray, unit: np.ndarray, th: np.ndarray, slack: float) -> np.ndarray:
    """For each query (unit vector, threshold) the unit vectors whose values on its largest coordinates allow the threshold."""
    keep = np.ones((len(u), len(unit)), bool)
    rows = np.arange(len(u))
    for f in np.argsort(-np.abs(u), axis=1)[:, :FOCUS].T:
        own, x = u[rows, f], unit[:, f].T
        # an angle of at most arccos(th) moves coordinate f by no more than this
        width = np.sqrt(np.maximum(0.0, 1 - th * th)) * np.sqrt(np.maximum(0.0, 1 - own * own)) + slack
        keep &= (x >= (th * own - width)[:, None]) | (own < -th)[:, None]
        keep &= (x <= (th * own + width)[:, None]) | (own > th)[:, None]
    return keep


def search(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Found:
    """(query, candidate, score) of one bucket for one block: all that can be among the k best."""
    qn, cn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    longest = cn.max(initial=0)
    slack = 1e-9  # keeps rounding from pruning a score that equals the bound
    low = bound.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(qn * longest > 0, low / (qn * longest), np.where(low > 0, np.inf, -np.inf))
    live = np.flatnonzero(cosine <= 1 + slack)
    out = []

    def verify(rows: np.ndarray, keep: np.ndarray, allowed: np.ndarray | None = None) -> None:
        if not len(rows) or not len(keep):
            return
        s = products(q[rows], c[keep])
        ok = (s >= bound[rows][:, None]) & (qid[rows][:, None] != cid[keep][None, :])
        if allowed is not None:
            ok &= allowed
        i, j = np.nonzero(ok)
        out.append(best((qid[rows][i], cid[keep][j], s[i, j]), k))

    high = live[cosine[live] >= COORDINATES]
    if len(high):  # coordinate pruning
        unit = c / np.maximum(cn, 1e-300)[:, None]
        keep = _near_coordinates(q[high] / qn[high][:, None], unit, np.maximum(-1.0, cosine[high] - slack), slack)
        keep &= cn[None, :] * qn[high][:, None] >= (low[high] - slack * np.maximum(1.0, np.abs(low[high])))[:, None]
        some = np.flatnonzero(keep.any(axis=0))
        rows = np.flatnonzero(keep.any(axis=1))
        verify(high[rows], some, keep[np.ix_(rows, some)])
    rest = live[cosine[live] < COORDINATES]
    if len(rest):  # length pruning: the bound of the least demanding query of the block
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(qn[rest] > 0, low[rest] / qn[rest], -np.inf).min()
        verify(rest, np.flatnonzero(cn >= need - slack * max(1.0, abs(need))))
    return _joined(out)


def _joined(parts: list[Found]) -> Found:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def _kth(qid: np.ndarray, found: Found, k: int) -> np.ndarray:
    """The k-th score of each query in ``found`` (as :func:`best` gives it), or the least number."""
    out = np.full(len(qid), LEAST)
    q, _, s = found
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    full = start[np.diff(np.append(start, len(q))) >= k]
    order = np.argsort(qid)
    out[order[np.searchsorted(qid, q[full], sorter=order)]] = s[full + k - 1]
    return out


def _narrow(vs: np.ndarray) -> np.ndarray:
    for kind in ("<i2", "<i4"):
        if vs.size == 0 or (np.iinfo(kind).min <= vs.min() and vs.max() <= np.iinfo(kind).max):
            return vs.astype(kind)
    return vs.astype("<i8")


def _vectors(ids: bytes, vs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    width = len(vs) // max(1, len(i) * dim) or 2
    return i, np.frombuffer(vs, f"<i{width}").reshape(len(i), dim)


def _blocks(df: DataFrame, size: int, by: list) -> DataFrame:
    """Rows (dim, norm, ids, vs) of at most ``size`` vectors, as the narrowest integers; ``norm`` is that of the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column("id").to_numpy(), b.column("dim").to_numpy()
            flat, off = b.column("v").values.to_numpy(), b.column("v").offsets.to_numpy()
            cuts = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else np.zeros(0, int)
            rows = []
            for a, e in zip(cuts, [*cuts[1:], len(n)], strict=True):
                for i in range(a, e, size):
                    j = min(e, i + size)
                    vs = flat[off[i] : off[j]].reshape(j - i, int(n[a]))
                    rows.append((int(n[a]), float(np.sqrt((vs.astype(float) ** 2).sum(1)).max(initial=0)), ids[i:j].astype("<i8").tobytes(), _narrow(vs).tobytes()))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["dim", "norm", "ids", "vs"])

    dealt = df.withColumn("dim", F.size("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions("dim", F.desc("norm2"), "id").select("id", "dim", "v")
    return dealt.mapInArrow(trimmed(run), "dim int, norm double, ids binary, vs binary")


def _meet(k: int):
    """Streams the rows of each group, its buckets (``kind`` 0) first, then the blocks of queries that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buckets = None, []
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if (r["dim"], r["group"]) != now:
                    now, buckets = (r["dim"], r["group"]), []
                if r["kind"] == 0:
                    buckets.append(_vectors(r["ids"], r["vs"], r["dim"]))
                    continue
                qid, q = _vectors(r["ids"], r["vs"], r["dim"])
                low, own = np.frombuffer(r["low"], "<i8"), _joined([])
                for cid, c in buckets:
                    more = search(qid, q, low, cid, c, k)
                    if len(more[0]):
                        own = best(_joined([own, more]), k)
                        low = np.maximum(low, _kth(qid, own, k))
                rows.append((np.full(len(own[0]), r["block"]), *own))
            cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["block", "query_id", "vec_id", "score"])

    return trimmed(run)


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the bounds of their queries raised to the k-th scores ``kth`` found so far."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            qid, q = _vectors(r["ids"], r["vs"], r["dim"])
            known = {x["query_id"]: x["score"] for x in r["kth"] or ()}
            low = np.asarray([known.get(i, LEAST) for i in qid.tolist()], np.int64)
            length = np.sqrt((q.astype(float) ** 2).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((low > LEAST) & (length > 0), low / length, np.where(low > 0, np.inf, -np.inf)).min(initial=np.inf)
            rows.append((r["block"], r["dim"], float(need), r["ids"], r["vs"], low.astype("<i8").tobytes()))
        cols = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "dim", "need", "ids", "vs", "low"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` with the largest product for each of ``queries``.

    Components are floor(scale * x). A row is no candidate of a query with its id; ties go to the smaller
    id. Vectors that are null, or hold null or non-finite components, take no part, nor do null ids; only vectors of
    one dimension meet, however long. Equal rows count once; the score of two ids is the best of their rows, if an id
    has several. Fewer than k candidates: all of them. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded(spark)
    all_ = quantised(vectors, id_col, vec_col, scale).where("id is not null").distinct()
    asked = quantised(queries, id_col, vec_col, scale).where("id is not null").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = _blocks(all_, BUCKET, [n, "dim", F.desc("norm2"), "id"]).withColumn("bucket", F.monotonically_increasing_id())
    per = F.greatest(F.lit(1), F.floor(F.lit(GROUP_BYTES) / F.greatest(F.lit(1), F.octet_length("vs"))))
    # buckets of one partition follow each other: so many of them make a group
    buckets = written(buckets.withColumn("group", F.col("bucket") - F.pmod(F.col("bucket").bitwiseAND((1 << 33) - 1), per)), "topk-buckets")
    groups = buckets.groupBy("dim", "group").agg(F.max("norm").alias("longest"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "group"))
    groups = written(groups.withColumn("round", F.floor(F.log2(place)).cast("int")), "topk-groups")
    blocks = _blocks(asked, BLOCK, [max(1, n // 4), "dim", "norm2", "id"]).withColumn("block", F.monotonically_increasing_id()).drop("norm")
    blocks = written(blocks.withColumn("kth", F.lit(None).cast("array<struct<query_id:long,score:long>>")), "topk-blocks")
    rounds = groups.agg(F.max("round")).first()[0]
    found = spark.createDataFrame([], "block long, query_id long, vec_id long, score long")
    if rounds is None or blocks.isEmpty():
        return found.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    state = "block long, dim int, need double, ids binary, vs binary, low binary"
    known = written(blocks.mapInArrow(trimmed(_raise), state), "topk-bounds")
    for at in range(rounds + 1):
        here = groups.where(F.col("round") == at)
        # pairs are made of names alone, dealt by salt, and the vectors follow
        names = here.select("dim", "group", "longest", F.pmod(F.xxhash64("group"), F.lit(SALTS)).alias("salt"))
        salted = known.select("dim", "block", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        pairs = salted.join(names, ["dim", "salt"]).where(F.col("longest") >= F.col("need") - 1e-6 * (1 + F.abs("need"))).select("dim", "block", "group")
        pairs = written(pairs, "topk-pairs")
        one = pairs.join(known.select("block", "ids", "vs", "low"), "block").select("dim", "group", F.lit(1).alias("kind"), "block", "ids", "vs", "low")
        other = buckets.join(pairs.select("dim", "group").distinct(), ["dim", "group"]).select("dim", "group", F.lit(0).alias("kind"), F.col("bucket").alias("block"), "ids", "vs", F.lit(None).cast("binary").alias("low"))
        rows = other.unionByName(one).repartition(n, "dim", "group").sortWithinPartitions("dim", "group", "kind", "block")
        new = written(rows.mapInArrow(_meet(k), "block long, query_id long, vec_id long, score long"), "topk-met")
        both = found.union(new).groupBy("block", "query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = written(both.withColumn("rank", rank).where(F.col("rank") <= k), "topk-found")
        if at < rounds:
            # the queries of a block that have k results: at most as many rows as the block has vectors
            kth = found.where(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("kth"))
            known = written(blocks.drop("kth").join(kth, "block", "left").select(blocks.columns).mapInArrow(trimmed(_raise), state), "topk-bounds")
            found = found.drop("rank")
    return found.select("query_id", "rank", "vec_id", "score")
