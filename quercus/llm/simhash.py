"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of the fingerprint gets a vector m(i) of r + 1 bits. For each of the
2^(r+1) - 1 non-zero vectors v, a mask keeps the bits with <m(i), v> = 1. Two
fingerprints that differ in at most r bits always agree under some mask: r
vectors m(i) cannot span a space of r + 1 dimensions, so some v is orthogonal
to all of them. No pair within the radius is lost.

Equal fingerprints are one node. A bucket with many nodes is dealt out again
by covering masks over the bits its own mask leaves free, so a crowded bucket
never meets in one task; each bucket gives a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import MAYBE, bitmap, bounded, disposable, drop, join_skewed, may_hold, slices, texts, trimmed, written

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
CROWDED = 256  # nodes of a bucket that is dealt out again


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[start : start + size]`` for all spans at once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    by = np.argsort(-size, kind="stable")
    at, n = start[by].astype(np.int64), size[by].astype(np.int64)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(n), s + P5, np.uint64)
        big = int(np.searchsorted(-n, -32, side="right"))  # spans of 32 bytes or more come first
        if big:
            v = [np.full(big, x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            pos, stripes, k = at[:big].copy(), n[:big] // 32, 0
            m = big
            while m:
                for j in range(4):
                    v[j][:m] = _round(v[j][:m], u64[pos[:m] + 8 * j])
                pos[:m] += 32
                k += 1
                m = int(np.searchsorted(-stripes[:m], -(k + 1), side="right"))
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros(big, np.uint64), x)) * P1 + P4
            acc[:big] = h
            at[:big] = pos
        acc += n.astype(np.uint64)
        rest = n % 32
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if len(i):
                acc[i] = _rotl(acc[i] ^ _round(np.zeros(len(i), np.uint64), u64[at[i]]), 27) * P1 + P4
                at[i] += 8
        rest %= 8
        i = np.flatnonzero(rest >= 4)
        if len(i):
            acc[i] = _rotl(acc[i] ^ (u32[at[i]].astype(np.uint64) * P1), 23) * P2 + P3
            at[i] += 4
        rest %= 4
        for k in range(3):
            i = np.flatnonzero(rest > k)
            if len(i):
                acc[i] = _rotl(acc[i] ^ (padded[at[i]].astype(np.uint64) * P5), 11) * P1
                at[i] += 1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        acc ^= acc >> np.uint64(32)
    out = np.empty(len(n), np.uint64)
    out[by] = acc
    return out


def shingles(rows: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of shingles of each text and the hashes of all in a row; no words: none, fewer words than a shingle: one."""
    docs = [(t or "").encode().lower().split() for t in rows]
    n = np.fromiter(map(len, docs), np.int64, len(docs))
    words = [w for d in docs for w in d]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n  # first word of each text
    offset = np.cumsum(count) - count
    word = np.repeat(first - offset, count) + np.arange(int(count.sum()))
    last = word + np.repeat(np.minimum(n, shingle), count) - 1
    return count, xxh64(buf, start[word], start[last] + size[last] - start[word])


def simhashes(rows: list[str | None], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints of whole texts; no words: zero."""
    count, h = shingles(rows, shingle)
    out = np.zeros(len(rows), np.uint64)
    if not len(h):
        return out
    total = np.zeros((len(rows), 64), np.int64)
    owner = np.repeat(np.arange(len(rows)), count)
    step = 1 << 15
    for a in range(0, len(h), step):
        part, of = h[a : a + step], owner[a : a + step]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        total[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    bits = (2 * total > count[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().copy()


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` (the 64 bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = simhashes(part.column("text").to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], ["id", "fp"])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(trimmed(run), "id long, fp long").withColumnRenamed("id", id_col)


def covering(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions: any two values that differ in at most ``radius`` of them agree under one."""
    m = {b: 1 + i % (2 ** (radius + 1) - 1) for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (m[b] & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(node, smaller linked node) edges that connect what the radius links, by breadth-first search in blocks."""
    fps = np.sort(fps)
    edges, todo = [], np.ones(len(fps), bool)
    u = fps.view(np.uint64)
    for i in range(len(fps)):
        if not todo[i]:
            continue
        todo[i] = False
        queue = [i]
        while queue and todo.any():
            rest = np.flatnonzero(todo)
            hit = rest[np.bitwise_count(u[rest] ^ u[queue.pop()]) <= radius]
            todo[hit] = False
            queue += hit.tolist()
            edges += [(x, int(fps[i])) for x in fps[hit].tolist()]
    return edges


def _edges(groups: DataFrame, radius: int) -> DataFrame:
    """Edges inside groups (array column ``fps``); each group is of a proven size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for x in batch.column("fps"):
                fps = x.values.to_numpy(zero_copy_only=False)
                if len(fps) == 2:
                    a, b = fps.tolist()
                    if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                        found.add((max(a, b), min(a, b)))
                else:
                    found.update(_spanning(fps, radius))
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return groups.select("fps").mapInArrow(run, "u long, v long")


@disposable
def links(nodes: DataFrame, radius: int = 3, crowded: int = CROWDED) -> DataFrame:
    """Edges ``u > v`` between different fingerprints (column ``fp``) that connect all pairs within ``radius``.

    Level 1 keeps about half of the 64 bits; buckets of more than ``crowded`` nodes go to level 2, where
    masks over the free bits keep half of them. There, at most 16 bits are free, so a group has 2^16 nodes at
    the very most; no third level is needed.
    """
    masks = covering(list(range(64)), radius)
    tables = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(_long(m)).alias("k")) for j, m in enumerate(masks)])
    rows = nodes.select("fp", F.inline(tables))
    count = rows.groupBy("j", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(count, ["j", "k"]), "simhash-rows")
    small = rows.where(F.col("n") <= crowded).groupBy("j", "k").agg(F.collect_list("fp").alias("fps"))
    found = _edges(small, radius)
    if rows.where(F.col("n") > crowded).limit(1).count():
        big = rows.where(F.col("n") > crowded)
        each = [covering([b for b in range(64) if not m >> b & 1], radius) for m in masks]
        subs = F.array(*[F.array(*[F.lit(_long(s)) for s in own]) for own in each])
        subs = big.select("j", "k", "fp", F.posexplode(F.element_at(subs, F.col("j") + 1)).alias("j2", "m"))
        subs = subs.select("j", "k", "j2", F.col("fp").bitwiseAND(F.col("m")).alias("k2"), "fp")
        groups = subs.groupBy("j", "k", "j2", "k2").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        found = found.unionByName(_edges(groups, radius))
    return written(found.distinct(), "simhash-edges")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``u, root``: the smallest node reachable from each node that isn't the smallest itself.

    Alternating large-star and small-star rounds; a round's edges are a written table.
    """

    def star(sym: DataFrame, keep: str) -> DataFrame:
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return sym.join(least, "a").where(keep)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, was = edges.select("u", "v"), None
    for _ in range(most_rounds):
        sym = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = star(sym, "b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.col("u").alias("a"), F.col("v").alias("b"))
        down = star(down.union(down.select("a", F.col("a").alias("b"))), "b <> m")
        nxt = written(down.select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "simhash-star")
        key = state(nxt)
        if was is not None:
            drop(now)
        now = nxt
        if key == was:
            return now.select("u", F.col("v").alias("root"))
        was = key
    raise RuntimeError("the components did not settle")


@disposable
def named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, n, component_id, rows, keep_id, keep_node`` of each of ``nodes`` (``node, n, least``: how many rows, smallest id).

    A component has ``rows`` rows; the one that stands for it has the smallest id, and of those the smallest node.
    """
    root = components(edges) if not edges.isEmpty() else edges.select("u", F.col("v").alias("root"))
    of = nodes.join(root, nodes["node"] == root["u"], "left").select("node", "n", F.coalesce("root", "node").alias("root"), "least")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    by = of.groupBy("root").agg(F.sum("n").alias("rows"), first.alias("k"), F.count("*").alias("nodes"))
    by = by.select("root", "rows", F.col("k.least").alias("keep_id"), F.col("k.node").alias("keep_node"), "nodes")
    return written(join_skewed(of, by, "root", "nodes").select("node", "n", F.col("keep_id").alias("component_id"), "rows", "keep_id", "keep_node"), "named")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id``: the smallest id that links of at most ``radius`` bits reach.

    Texts without words (null, empty, white space) have fingerprint zero and link as any other. A very long text is
    hashed whole. Repeated rows come out repeated; a null id stays null and never names a component unless all its
    members' ids are null. Ties do not matter: a component is a set. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    of = named_fps(fps, radius, crowded, id_col).select(F.col("node").alias("fp"), "n", "component_id")
    return join_skewed(fps, of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@disposable
def named_fps(fps: DataFrame, radius: int, crowded: int, id_col: str) -> DataFrame:
    """What :func:`named` says of each fingerprint of ``fps`` (``fp, id_col``), by the links of at most ``radius`` bits."""
    nodes = written(fps.groupBy(F.col("fp").alias("node")).agg(F.count("*").alias("n"), F.min(id_col).alias("least")), "simhash-nodes")
    return named(nodes, links(nodes.select(F.col("node").alias("fp")), radius, crowded))


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, and of rows with that id of the smallest fingerprint.

    Rows are told apart by their own fingerprints, so rows of one id with unlike texts each have their own group. Rows
    with a null id stay only where no member of their group has an id. Of rows equal in id and fingerprint the
    smallest stays, by all columns in their order (maps aside). An empty table gives no rows.
    """
    names = docs.columns
    key = free_name(names, "node")

    @F.arrow_udf("long")
    def fp(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(run)(columns)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts_ in columns:
            batch = pa.RecordBatch.from_arrays([texts_], ["text"])
            found = [simhashes(part.column("text").to_pylist(), shingle).view(np.int64) for part in slices(batch, "text")]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))

    bounded(docs.sparkSession)
    marked = written(docs.withColumn(key, fp(F.col(text_col))), "simhash-docs")
    of = named_fps(marked.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("fp")), radius, CROWDED, "id")
    return kept(marked, of, key, id_col).select(names)


def free_name(names: list[str], new: str) -> str:
    while new in names:
        new += "_"
    return new


def kept(docs: DataFrame, of: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (with their node in column ``key``) that :func:`named` keeps.

    Rows whose group has but them stay where they are. Of the others, those that are no group's first go before
    anything is dealt; only firsts are, and rows that share the bit of a first.
    """
    several = written(of.where("rows > 1"), "near-several")
    in_several = may_hold(docs, key, written(bitmap(several, "node"), "near-node-bits"))
    alone, rest = in_several.where(~F.col(MAYBE)).drop(MAYBE), in_several.where(MAYBE).drop(MAYBE)
    names = docs.columns
    first, n = free_name(names, "first"), free_name(names, "n")
    group = several.select(F.col("node").alias(key), F.col("n").alias(n), F.struct("keep_id", "keep_node").alias(first))
    # false hits of the bitmap are in no group of several: they meet nothing and stay
    met = join_skewed(rest, group, key, n, left=True)
    own = F.col(id_col).cast("long").eqNullSafe(F.col(first)["keep_id"]) & (F.col(key) == F.col(first)["keep_node"])
    single = met.where(F.col(first).isNull()).select(names)
    firsts = met.where(own).select(names)
    return alone.unionByName(single).unionByName(_smallest(firsts, [id_col, key]))


def _smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``, the smallest by all columns; columns that have no order (maps) do not count."""
    whole = F.struct(*rows.columns)
    if any("map<" in kind or kind == "variant" for _, kind in rows.dtypes):
        best = F.min_by(whole, F.struct(*(c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant")))
    else:
        best = F.min(whole)
    return rows.groupBy(*(F.col(k).alias(f"q_key_{i}") for i, k in enumerate(keys))).agg(best.alias("q_row")).select("q_row.*")
