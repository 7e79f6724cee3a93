"""Sequence packing by non-negative least squares.

Each document's ids are cut into full windows and one rest. Only the histogram
of rest lengths (at most ``window`` numbers) meets on the driver. There, shallow
combinations of two or three lengths that fill a window exactly are enumerated,
their repeat counts solve a non-negative least squares problem against the
histogram, the counts are rounded, and what remains is packed greedily. The
result is a bounded table of rank intervals per length; every piece finds its
place by its rank among the pieces of its length, which is counted over salted
groups of a bounded size, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.bpe import codec
from quercus.llm.common import slices, texts, trimmed, written

WINDOW = 1024
SALTED = 1 << 10  # pieces of a length that are ranked together, or the root of their number where that is more
BEYOND = 1 << 42  # more pieces of one length than there can be


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of each window of each whole text, ended by ``end_id``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, width = codec(path), 4 * window
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = c.encode(t) + end
                    rows += [(i, a // 4, min(width, len(ids) - a) // 4, zlib.crc32(ids[a : a + width]), len(ids) // 4) for a in range(0, len(ids), width)]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(trimmed(run), "id long, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", "doc_id")


def combinations(window: int, per_length: int = 8) -> np.ndarray:
    """Pairs and an even choice of triples of lengths that add up to ``window``; pairs have a third length 0."""
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    triples = []
    for a in range(1, window // 3 + 1):
        low, high = a, (window - a) // 2
        step = max(1, (high - low) // per_length)
        triples += [(a, b, window - a - b) for b in range(low, high + 1, step)]
    return np.asarray(pairs + triples, np.int64).reshape(-1, 3)


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts ``x >= 0`` that minimise ``|Ax - hist|``, column j of A counting the lengths of combination j.

    Projected gradient with momentum; the length 0 of a pair has no row.
    """
    n, m = len(hist), len(combos)
    if not m:
        return np.zeros(0)
    times = lambda x: np.bincount(combos.ravel(), np.repeat(x, 3), n) * (np.arange(n) > 0)
    back = lambda r: np.where(np.arange(n) > 0, r, 0)[combos].sum(1)
    v = np.ones(m)
    for _ in range(20):
        v = back(times(v / np.linalg.norm(v)))
    step = 1 / (1.05 * np.linalg.norm(v))
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * back(times(y) - hist))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = nxt + (was - 1) / t * (nxt - x)
        x = nxt
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) that use up ``hist`` (index: length, up to ``window``) exactly."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            left[x] -= times
        out.append((lengths, times))

    def room(lengths: tuple[int, ...]) -> int:
        return min(int(left[x]) // lengths.count(x) for x in lengths)

    if left[window]:
        use((window,), int(left[window]))
    combos = combinations(window)
    x = nnls(combos, left[: window + 1].astype(float))
    own = [tuple(c for c in row if c) for row in combos.tolist()]
    for whole in (True, False):  # first the whole counts, then one more where the fraction says so
        for j in np.argsort(-(x - np.floor(x)), kind="stable").tolist() if not whole else range(len(own)):
            times = min(int(x[j]) if whole else int(x[j] % 1 >= 0.5), room(own[j]))
            if times > 0:
                use(own[j], times)
    while left.any():  # greedily: the longest first, filled with the longest that fit
        free, taken, rest = window, [], left.copy()
        while free > 0 and (some := np.flatnonzero(rest[: free + 1])).size:
            k = int(some[-1])
            taken.append(k)
            rest[k] -= 1
            free -= k
        use(tuple(taken), room(tuple(taken)))
    return out


def intervals(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns: length * BEYOND + first rank, first sequence, offset; sorted by the first."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in found:
        at = 0
        for x in lengths:
            rows.append((x * BEYOND + rank.get(x, 0), base, at))
            rank[x] = rank.get(x, 0) + times
            at += x
        base += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 3)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0, salted: int = SALTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    A null or empty text is its end id alone; a very long text is cut into many windows. Repeated rows are packed
    each; null ids stay null; pieces of one length are alike to the plan, and the order of ids, starts and checksums
    tells them apart; an empty table gives no rows; other columns are ignored.
    """
    cut = written(pieces(docs, path, window, end_id, id_col, text_col), "pieces")
    hist = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # window rows at most
        hist[r.length] = r.n
    # the groups of a length and the pieces in one grow alike, so neither their sums nor their ranks gather in one task
    salts = F.element_at(F.array(*(F.lit(1 + int(x) // max(salted, isqrt(int(x)))) for x in hist)), F.col("length").cast("int") + 1)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    count = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = cut.sparkSession.sparkContext.broadcast(intervals(plan(hist, window)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1)
    ranked = ranked.join(written(count, "piece-counts").hint("merge"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, offset = starts.value.T
        for b in batches:
            want = b.column("length").to_numpy() * BEYOND + b.column("rank").to_numpy()
            i = np.searchsorted(key, want, side="right") - 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(base[i] + want - key[i]), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(trimmed(place), out)
