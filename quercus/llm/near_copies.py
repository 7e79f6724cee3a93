"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash bands find the candidates: a pair at 0.8 shares none of the 40 bands of
five places with a probability of 1.2e-7, a closer pair less. Every candidate is
then checked on the whole sets, so no pair below 0.8 is linked. Equal texts are
one node. In a crowded bucket each first meets the most usual node; those that
are in different components then meet by prefix filtering, which is exact.

With a ``radius``, texts whose SimHash fingerprints differ in at most that many
bits are linked too, by the covering masks of :mod:`simhash`: each of the two
reaches near copies that the other leaves apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import MAYBE, bitmap, disposable, join_skewed, may_hold, slices, texts, trimmed, written
from quercus.llm import simhash
from quercus.llm.simhash import components, free_name, kept, named, named_fps, shingles, simhashes

SHINGLE = 5  # words
NUM, DEN = 4, 5  # similarity of a link, as a fraction
BANDS, PLACES = 40, 5
CROWDED = 2  # nodes of a bucket up to which all pairs are candidates at once: more, and a large group would list its pairs over its small buckets

_RND = np.random.Generator(np.random.PCG64(20240301))
_XOR = _RND.integers(0, 1 << 32, BANDS * PLACES, np.uint32)
_ODD = _RND.integers(0, 1 << 32, BANDS * PLACES, np.uint32) | np.uint32(1)
_MIX = _RND.integers(0, 1 << 63, (BANDS, PLACES), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RND.integers(0, 1 << 63, BANDS, np.uint64)


def _hashes(rows: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`shingles`, with one shingle (zero) for texts without words."""
    count, h = shingles(rows, shingle)
    if count.all():
        return count, h
    return np.maximum(count, 1), np.insert(h, np.cumsum(count)[count == 0], np.uint64(0))


def bands(rows: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """A row of ``BANDS`` keys for each text."""
    if not rows:
        return np.zeros((0, BANDS), np.int64)
    count, h = _hashes(rows, shingle)
    first, low = np.cumsum(count) - count, (h >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(rows), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(rows), _BAND[b])
            for p in range(PLACES):
                k = b * PLACES + p
                least = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], first)
                key = (key ^ least) * _MIX[b, p]
                key ^= key >> np.uint64(29)
            keys[:, b] = key
    return keys.view(np.int64)


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat, pa.int64()))


def _keys(src: DataFrame, shingle: int, marked: bool) -> DataFrame:
    """``id, node, keys, fp`` of every text; ``node`` is a digest of the text, ``fp`` its fingerprint if ``marked``, else zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = part.column("text").to_pylist()
                keys = bands(rows, shingle)
                fp = simhashes(rows).view(np.int64) if marked else np.zeros(len(rows), np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), _lists(keys.ravel(), np.full(len(keys), BANDS)), pa.array(fp)], ["id", "node", "keys", "fp"])

    return src.select("id", "node", "text").mapInArrow(trimmed(run), "id long, node long, keys array<long>, fp long")


@disposable
def _sets(src: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """``node, set``: the different shingles of each node of ``pairs``."""
    want = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    known = may_hold(src, "node", written(bitmap(want, "node"), "near-bits")).where(MAYBE)
    one = known.groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                count, h = _hashes(part.column("text").to_pylist(), shingle)
                own = [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
                size = np.fromiter(map(len, own), np.int64, len(own))
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(np.concatenate(own).view(np.int64), size)], ["node", "set"])

    return written(one.select("node", "text").mapInArrow(trimmed(run), "node long, set array<long>"), "near-sets")


@disposable
def _similar(src: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs ``u, v`` that reach the similarity, by their whole sets."""
    sets = _sets(src, pairs, shingle)
    size = sets.select("node", F.size("set").alias("n"))
    # sizes first: sets of unlike sizes cannot reach it
    sized = pairs.join(size.withColumnsRenamed({"node": "u", "n": "nu"}), "u").join(size.withColumnsRenamed({"node": "v", "n": "nv"}), "v")
    sized = sized.where(DEN * F.least("nu", "nv") >= NUM * F.greatest("nu", "nv"))
    both = sized.join(sets.withColumnsRenamed({"node": "u", "set": "su"}).hint("merge"), "u").join(sets.withColumnsRenamed({"node": "v", "set": "sv"}).hint("merge"), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return written(both.where((DEN + NUM) * common >= NUM * (F.col("nu") + F.col("nv"))).select("u", "v"), "near-edges")


def _prefix_pairs(src: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Pairs ``u, v`` of the nodes (``node, root``) with different roots that can reach the similarity: none is missed.

    Two sets that reach it share one of the shingles that come first in each, by how few of the nodes have them,
    and from the places of a shared one on enough must be left. What many share comes last, where little is left,
    so copies that each changed much at places of their own are no pairs.
    """
    sets = _sets(src, nodes.select(F.col("node").alias("u"), F.col("node").alias("v")), shingle)
    token = sets.select("node", F.size("set").alias("size"), F.explode("set").alias("token"))
    often = token.groupBy("token").agg(F.count("*").alias("df")).withColumn("n", F.col("df"))
    ranked = join_skewed(token, often, "token").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    first = F.slice("t", F.lit(1), (F.col("size") - F.ceil(F.col("size") * NUM / DEN) + 1).cast("int"))
    first = ranked.select("node", "size", F.posexplode(first).alias("at", "t")).where("t.df > 1").join(nodes, "node")
    first = written(first.select("node", "root", F.col("t.token").alias("token"), "size", (F.col("size") - F.col("at") - 1).alias("left")), "near-prefixes")
    a, b = first.alias("a"), first.alias("b")
    can = (DEN + NUM) * (1 + F.least("a.left", "b.left")) >= NUM * (F.col("a.size") + F.col("b.size"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.node") > F.col("b.node")) & can)
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges ``u, v`` from each of the nodes (``node, fp``) to the least that links of at most ``radius`` bits reach."""
    of = named_fps(nodes.select("fp", "node"), radius, simhash.CROWDED, "node").where("rows > 1")
    least = of.select(F.col("node").alias("fp"), "n", F.col("keep_id").alias("least"))
    return join_skewed(nodes.select("node", "fp"), least, "fp").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))


def _roots(edges: DataFrame) -> DataFrame:
    return components(edges) if not edges.isEmpty() else edges.select("u", F.col("v").alias("root"))


def digest(text) -> Column:
    """The node of a text: 64 bits, as pairs of nodes are all that is compared of equal texts."""
    return F.xxhash64(text)


@disposable
def _groups(docs: DataFrame, shingle: int, crowded: int, id_col: str, text_col: str, radius: int | None) -> tuple[DataFrame, DataFrame]:
    """``id, node`` of each row, and what :func:`simhash.named` says of each node."""
    src = texts(docs, id_col, text_col).withColumn("node", digest("text"))
    keys = written(_keys(src, shingle, radius is not None), "near-keys")
    nodes = written(keys.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "near-nodes")
    rows = nodes.select("node", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n"))
    rows = written(join_skewed(rows, several, "key", "members"), "near-rows")
    small = rows.where(F.col("n") <= crowded).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("own"))
    small = small.select(F.posexplode("own").alias("i", "u"), "own").select("u", F.explode(F.slice("own", F.lit(1), F.col("i"))).alias("v"))
    # the node that meets most others over its buckets is the most usual of its bucket: most copies are linked to it
    weight = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    big = written(rows.where(F.col("n") > crowded).join(weight, "node"), "near-crowded")
    centre = big.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("centre"), F.count("*").alias("n"))
    star = join_skewed(big.select("key", "node"), centre, "key").where("node <> centre").select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v"))
    edges = _similar(src, written(small.union(star).distinct(), "near-pairs"), shingle)
    if radius is not None:
        edges = written(edges.union(_by_fingerprint(nodes, radius)), "near-and-fp-edges")
    big = big.select("key", "node").join(_roots(edges).withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    part = big.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    open_ = written(join_skewed(big, part.select("key", "n"), "key").select("node", "root").distinct(), "near-open")
    if not open_.isEmpty():
        edges = written(edges.union(_similar(src, written(_prefix_pairs(src, open_, shingle), "near-more"), shingle)), "near-all-edges")
    return written(keys.select("id", "node"), "near-rows-of"), named(nodes.select("node", "n", "least"), edges)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """``id_col, component_id``: the smallest id that links of the similarity reach, or with ``radius`` links of either kind.

    Texts without words (null, empty, white space) are copies of each other, and a text of fewer words than a
    shingle is one shingle; a very long text counts whole. Rows with null ids, repeated rows, ties, empty tables and
    other columns as in ``simhash.near_duplicates``.
    """
    keys, of = _groups(docs, shingle, crowded, id_col, text_col, radius)
    return join_skewed(keys, of.select("node", "n", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """``docs`` with one row of each component, chosen as in ``simhash.keep_one``, by the digest of the text after the id."""
    _, of = _groups(docs, shingle, crowded, id_col, text_col, radius)
    key = free_name(docs.columns, "node")
    return kept(docs.withColumn(key, digest(text_col)), of, key, id_col).select(docs.columns)
