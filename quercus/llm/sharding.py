"""Sharding: minimax contiguous partition of atomic groups of equal texts.

Groups are ordered by the digest of their text. The smallest feasible capacity
is found by binary search; a capacity is feasible if cutting greedily, as late
as it allows, needs no more than ``n_shards`` shards. The driver holds sums over
ranges of digests, a bounded number of them: a cut inside a range is bracketed
by the range's start (a valid cut, so an upper bound) and by a cut at any byte
(a lower bound). Only ranges in which the two differ are split further, until
the bounds meet; then the capacity is the exact optimum over single groups.
Ranges in which no cut can lie any more are held as one sum.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.common import written

FIRST = 3  # hex digits of the first ranges
MOST = 1 << 17  # ranges the driver holds at most
NULL = "~"  # key of the null text: no digest, after all of them
SLOTS = 1024  # salted groups per shard for the slots

Range = tuple[str, int, int]  # digest prefix, bytes, groups


def _cuts(edges: list[int], single: list[bool], capacity: int, n_shards: int, whole: bool) -> list[float] | None:
    """Greedy cut positions; ``whole``: only at edges of ranges, else anywhere inside a range of several groups."""
    at, out = 0, []
    for _ in range(n_shards):
        if at + capacity >= edges[-1]:
            return out
        i = bisect_right(edges, at + capacity) - 1
        nxt = edges[i] if whole or single[i] else at + capacity
        if nxt <= at:
            return None
        out.append(nxt)
        at = nxt
    return None


def _smallest(edges: list[int], single: list[bool], n_shards: int, whole: bool) -> int:
    low, high = max(1, -(-edges[-1] // n_shards)), max(1, edges[-1])
    while low < high:
        mid = (low + high) // 2
        if _cuts(edges, single, mid, n_shards, whole) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax(ranges: list[Range], split, n_shards: int) -> tuple[int, list[str]]:
    """Smallest capacity and the digest prefixes at which the shards after the first begin.

    ``split(prefixes)`` gives the ranges that the ranges of these prefixes fall into.
    """
    ranges = sorted(ranges)
    sums, low = set(), 0  # prefixes of ranges that stand for several; a sum forgets the single groups in it, the bound does not
    while True:
        edges = [0]
        for _, size, _ in ranges:
            edges.append(edges[-1] + size)
        single = [n == 1 for *_, n in ranges] + [True]
        high = _smallest(edges, single, n_shards, True)
        low = max(low, _smallest(edges, single, n_shards, False))
        cuts = _cuts(edges, single, high, n_shards, True) or []
        if low == high:
            return high, [ranges[edges.index(c)][0] for c in cuts]
        # a cut of any capacity between the bounds lies between the earliest and the latest of both
        early = _early(edges, low, n_shards)
        late = _cuts(edges, single, high, n_shards, False) or []
        late += [edges[-1]] * (len(early) - len(late))
        near = set()
        for a, b in zip(early, late, strict=True):
            i, j = max(0, bisect_right(edges, a) - 1), bisect_right(edges, b)
            near.update(range(max(0, i - 1), min(j + 1, len(ranges))))
        open_ = [k for k in near if not single[k] and ranges[k][0] not in sums]
        if not open_:
            raise RuntimeError("no range is left to split")
        # ranges of the longest reach first, as many as the driver holds
        names = {ranges[k][0] for k in sorted(open_, key=lambda k: -ranges[k][1])[: MOST // 256]}
        held: list[Range] = []
        for k, r in enumerate(ranges):
            if k in near or not held or k - 1 in near:
                held.append(r)
            else:
                held[-1] = (held[-1][0], held[-1][1] + r[1], held[-1][2] + r[2])
                sums.add(held[-1][0])
        ranges = sorted([r for r in held if r[0] not in names] + split(names))


def _early(edges: list[int], capacity: int, n_shards: int) -> list[float]:
    """Cuts at whole ranges, going on past a range that is larger than the capacity."""
    at, out = 0, []
    for _ in range(n_shards - 1):
        i = bisect_right(edges, at + capacity) - 1
        at = max(edges[i], at)
        out.append(at)
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; equal texts share a shard.

    Law ``bytes``: no partition of the ordered groups has a smaller largest shard. A null text has no
    bytes (size 1, checksum 0) and forms a group of its own, apart from the empty text. Repeated rows
    each get a slot; a null id is kept; a very long text counts whole; of groups of one size none is preferred, as
    the digests order them; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col)
    skinny = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(NULL)).alias("key"),
    )
    skinny = written(skinny, "shard-rows")
    groups = written(skinny.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")

    def sums(df: DataFrame, digits: int) -> list[Range]:
        by = df.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        return [tuple(r) for r in by.collect()]  # at most MOST rows

    def split(names: set[str]) -> list[Range]:
        out = []
        for length in sorted({len(x) for x in names}):
            own = [x for x in names if len(x) == length]
            more = 1 if len(own) > MOST // 256 else 2
            inside = groups.join(F.broadcast(groups.sparkSession.createDataFrame([(x,) for x in own], "p string")), F.substring("key", 1, length) == F.col("p"), "left_semi")
            out += sums(inside, min(64, length + more))
        return out

    _, starts = minimax(sums(groups, FIRST), split, n_shards)
    number = sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOTS)).cast("int")
    rows = skinny.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), salt.alias("salt"))
    count = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))  # n_shards * SLOTS rows at most
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("slot", F.row_number().over(own) - 1)
        .join(F.broadcast(count), ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
