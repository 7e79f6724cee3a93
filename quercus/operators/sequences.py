"""Sequences of K words that recur in several documents, with few bytes moved for each place.

A task hashes the words of some documents (a chunk, about ``CHUNK`` places) and sends each different sequence once: 96
bits, sorted and packed, dealt by the first bits. So a sequence that is everywhere comes once from a chunk, and a range
has about ``CHUNK`` sequences however large the input. Whether a sequence recurs goes back as one bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.plans.staging import staged

CHUNK = 1 << 20
ROW = "key long, chunk long, n long, m long, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split(" ")[0] for x in ROW.split(", ")]
_ARROW = pa.schema([(x, pa.int64()) for x in _NAMES[:4]] + [(x, pa.binary()) for x in _NAMES[4:]])
PLAIN, SHARED, NAMELESS = 0, 1, 2  # documents by their id: of one row, of several, without one


def _pack(a: np.ndarray) -> bytes:
    """Bytes of one place together, so that those which hardly change cost nothing."""
    a = np.ascontiguousarray(a)
    return pa.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def _unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def _hashed(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits for the ``k`` words from each place on."""
    n = len(words) - k + 1
    one, two = np.full(n, 0x9E3779B97F4A7C15, np.uint64), np.full(n, 0xD1B54A32D192ED03, np.uint64)
    coef = np.random.default_rng(7).integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    for j in range(k):
        w = words[j : j + n]
        one ^= w
        one ^= one >> np.uint64(32)
        one *= np.uint64(0xD6E8FEB86659FD93)
        one ^= one >> np.uint64(29)
        one *= np.uint64(0xBF58476D1CE4E5B9)
        two += w * coef[j]
    return one ^ (one >> np.uint64(32)), (two >> np.uint64(32)).astype(np.uint32)


def _groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both hashes (ties as they were), and where in it a new pair begins."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    a, b = one[order], two[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _chunk(number: int, parts: list[tuple], k: int, bits: int, places: bool) -> pa.RecordBatch:
    words, sizes, ids, kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
    lens = sizes - k + 1  # places of each document
    at = np.arange(lens.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(lens) - lens), lens)
    one, two = (x[at] for x in _hashed(words, k))
    doc = np.repeat(np.arange(len(lens)), lens)
    order, new = _groups(one, two)
    start = np.flatnonzero(new)
    u1, u2, by = one[order[start]], two[order[start]], doc[order]
    fresh = new.copy()
    fresh[1:] |= by[1:] != by[:-1]
    docs = np.add.reduceat(fresh & (kinds[by] == PLAIN), start, dtype=np.uint32)
    freq = np.diff(start, append=len(order)).astype(np.uint32)
    shared = np.flatnonzero(fresh & (kinds[by] == SHARED))
    s1, s2, sid = one[order[shared]], two[order[shared]], ids[by[shared]]
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
    cuts, named = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (u1, s1))
    rows = []
    for r in range(1 << bits):
        x, y = slice(cuts[r], cuts[r + 1]), slice(named[r], named[r + 1])
        if x.start == x.stop:
            continue
        own = b"".join(v[y].tobytes() for v in (s1, s2, sid))
        rows.append((r, number, x.stop - x.start, y.stop - y.start, _pack(np.diff(u1[x], prepend=np.uint64(0))), _pack(u2[x]), _pack(docs[x]), b"" if places else _pack(freq[x]), own))
    if places:
        inverse = np.empty(len(order), np.uint32)
        inverse[order] = np.cumsum(new) - 1
        rows.append((-1 - number, number, len(order), len(ids), _pack(ids), _pack(lens), _pack(kinds), _pack(inverse), b""))
    return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _chunks(k: int, bits: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("hs")), 0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(sizes >= k))
            if not batch.num_rows:
                continue
            sizes = sizes[sizes >= k].astype(np.int64)
            words = batch.column("hs").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            id_ = batch.column("doc_id")
            ids, none = id_.fill_null(0).to_numpy(zero_copy_only=False), id_.is_null().to_numpy(zero_copy_only=False)
            kinds = np.where(none, NAMELESS, np.where(batch.column("several").to_numpy(zero_copy_only=False), SHARED, PLAIN)).astype(np.uint8)
            ends = np.cumsum(sizes)
            cuts = [0, *(np.flatnonzero(np.diff((ends - sizes) // CHUNK)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                parts.append((words[ends[a] - sizes[a] : ends[b - 1]].copy(), sizes[a:b], ids[a:b].copy(), kinds[a:b]))
                held += int(ends[b - 1] - ends[a] + sizes[a])
                if held >= CHUNK:
                    yield _chunk(number, parts, k, bits, places)
                    number, parts, held = number + 1, [], 0
        if parts:
            yield _chunk(number, parts, k, bits, places)

    return run


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, beginnings and documents of the sequences of one range; those of shared ids come last, once for each id."""
    one = [np.cumsum(_unpack(r["a"], r["n"], np.uint64), dtype=np.uint64) for r in rows]
    two = [_unpack(r["b"], r["n"], np.uint32) for r in rows]
    docs = [_unpack(r["c"], r["n"], np.uint32) for r in rows]
    cut = [(r["e"], r["m"]) for r in rows if r["m"]]
    if cut:
        s1, s2, sid = (np.concatenate([np.frombuffer(e[lo * m : hi * m], t) for e, m in cut]) for lo, hi, t in ((0, 8, np.uint64), (8, 12, np.uint32), (12, 20, np.int64)))
        by = np.lexsort((sid, s2, s1))
        s1, s2, sid = s1[by], s2[by], sid[by]
        once = np.ones(len(by), bool)
        once[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (sid[1:] != sid[:-1])
        one, two, docs = [*one, s1[once]], [*two, s2[once]], [*docs, np.ones(once.sum(), np.uint32)]
    order, new = _groups(np.concatenate(one), np.concatenate(two))
    return order, new, np.add.reduceat(np.concatenate(docs)[order].astype(np.int64), np.flatnonzero(new))


def _counted(min_docs: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        order, new, docs = _merged(rows)
        freq = np.zeros(len(order), np.int64)
        own = np.concatenate([_unpack(r["d"], r["n"], np.uint32) for r in rows])
        freq[: len(own)] = own
        freq = np.add.reduceat(freq[order], np.flatnonzero(new))
        keep = docs >= min_docs
        found, n = np.unique(np.stack([freq[keep], docs[keep]], 1), axis=0, return_counts=True)
        return pa.table({"freq": found[:, 0], "docs": found[:, 1], "sequences": n.astype(np.int64)})

    return run


def _marked(min_docs: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("key")[0].as_py() < 0:  # the places of a chunk go on as they are
            return t
        rows = t.to_pylist()
        order, new, docs = _merged(rows)
        ok = np.empty(len(order), bool)
        ok[order] = (docs >= min_docs)[np.cumsum(new) - 1]
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        out = [(r["key"], r["chunk"], r["n"], 0, b"", b"", b"", _pack(np.packbits(ok[e - r["n"] : e])), b"") for r, e in zip(rows, ends, strict=True)]
        return pa.Table.from_batches([_batch(out)])

    return run


def _spans(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["key"])  # the one with the places is first
    own = rows[0]
    ok = np.concatenate([np.unpackbits(_unpack(r["d"], (r["n"] + 7) // 8, np.uint8), count=r["n"]) for r in rows[1:]]).astype(bool)
    ids, lens, kinds = _unpack(own["a"], own["m"], np.int64), _unpack(own["b"], own["m"], np.int64), _unpack(own["c"], own["m"], np.uint8)
    keep = ok[_unpack(own["d"], own["n"], np.uint32)]
    doc = np.repeat(np.arange(len(lens)), lens)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens)
    joined = keep[1:] & keep[:-1] & (doc[1:] == doc[:-1]) & (kinds[doc[1:]] == PLAIN)
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    at = doc[first]
    return pa.table({"doc_id": pa.array(ids[at], mask=kinds[at] == NAMELESS), "a": i[first], "b": i[last], "several": kinds[at] != PLAIN})


def _dealt(docs: DataFrame, word: str, k: int, places: bool) -> tuple[DataFrame, bool]:
    """Packed sequences of ``docs`` (``doc_id, text``), and whether some id is missing or has several rows.

    Rows of such an id name it with each of their sequences; they are written first, as a task that is run again has to
    give the same chunks.
    """
    per = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    odd = "n > 1 or doc_id is null"
    size, several = per.agg(F.sum("size"), F.count_if(F.expr(odd))).first()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("several"))
    if several:
        named = per.where(odd).select(F.col("doc_id").alias("other"), F.lit(True).alias("several"))
        joined = docs.join(named, F.col("doc_id").eqNullSafe(F.col("other")), "left")
        own = staged(joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("several", F.lit(False)).alias("several")), "documents")
    bits = max(0, ((size or 0) // (6 * CHUNK)).bit_length())
    hashed = own.select("doc_id", "several", F.transform(F.regexp_extract_all("text", F.lit(word), F.lit(0)), lambda w: F.xxhash64(w)).alias("hs"))
    return hashed.mapInArrow(_chunks(k, bits, places), ROW), bool(several)


def recurring(docs: DataFrame, word: str, k: int, min_docs: int) -> DataFrame:
    """``freq, docs, sequences``: how many sequences of ``k`` words occur ``freq`` times in ``docs`` documents, at least ``min_docs``."""
    rows, _ = _dealt(docs, word, k, False)
    found = rows.groupBy("key").applyInArrow(_counted(min_docs), "freq long, docs long, sequences long")
    return found.groupBy("freq", "docs").agg(F.sum("sequences").alias("sequences"))


def spans(docs: DataFrame, word: str, k: int, min_docs: int) -> DataFrame:
    """``doc_id, a, b``: first and last place of each run of adjacent places whose sequences are in ``min_docs`` documents or more.

    Rows of one id count as one document, so their places are numbered together.
    """
    rows, several = _dealt(docs, word, k, True)
    found = rows.groupBy("key").applyInArrow(_marked(min_docs), ROW).groupBy("chunk").applyInArrow(_spans, "doc_id long, a long, b long, several boolean")
    if not several:
        return found.drop("several")
    found = staged(found, "spans")
    island = F.col("a") - F.row_number().over(Window.partitionBy("doc_id").orderBy("a"))
    shared = found.where("several").withColumn("island", island).groupBy("doc_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return found.where("not several").drop("several").union(shared.select("doc_id", "a", "b"))
