"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends after a word if the gear hash of the last eight bytes says so, or
if that hash is the least within six words either way, so that equal words and
unlucky passages are cut too. An insertion moves cuts near it only, and equal
passages fall into equal chunks. Short chunks are common phrases, and the more
text there is, the more of them are: so what is compared is, from each chunk on,
the run of chunks that first has ``least`` bytes, by its digest (96 bits) over
the whole corpus. The document with the smallest id keeps a run, and within a
document its first place does; all other places of it are removed, with what
overlaps united. Of a passage that repeats, what reaches from its ends to the
next cut stays, three words on average. Only digests and ids are shuffled to
find the duplicates; texts meet their duplicate digests only where there are some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quercus.llm.common import MAYBE, bitmap, bounded, disposable, join_skewed, may_hold, slices, texts, trimmed, written
from quercus.llm.simhash import xxh64

EVERY = 4  # of words, one in so many ends a chunk by its hash
AROUND = 6  # words either way among which the least hash ends a chunk
INSIDE = 64  # of long words, one in so many characters ends a chunk
LONG_WORD = 64  # bytes
LEAST = 100  # bytes that a run of chunks has at least
BITS = 1 << 17  # words of the bitmap of shared digests, whatever the input

_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)
_GEAR[10] = 0  # so eight line feeds between texts leave nothing of the text before in the window
_BETWEEN = b"\n" * 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash of the eight bytes up to each place, by doubling the window three times."""
    h = _GEAR[buf]
    for w in (1, 2, 4):
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    return h >> np.uint32(8)


def _least_around(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a word's hash (mixed) is less than those of the text's words before and no more than those after, ``AROUND`` each way."""
    h = h * np.uint32(0x9E3779B1)
    out = np.ones(len(h), bool)
    for k in range(1, AROUND + 1):
        other = doc[k:] != doc[:-k]
        out[k:] &= (h[k:] < h[:-k]) | other
        out[:-k] &= (h[:-k] <= h[k:]) | other
    return out


def chunks(docs: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Of a list of texts: the document, start, end and following start (in its text) of each chunk; then of each run of
    chunks that first has ``least`` bytes its first and last chunk, digest and check."""
    buf = np.frombuffer(_BETWEEN.join(docs) + _BETWEEN, np.uint8)
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    base = np.cumsum(size + len(_BETWEEN)) - size - len(_BETWEEN)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    begin, end = edge[~space[edge]], edge[space[edge]]
    if not len(begin):
        return (np.zeros(0, np.int64),) * 6 + (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    h = gear(buf)
    cut = (h[end - 1] % EVERY == 0) | _least_around(h[end - 1], np.searchsorted(base, begin, side="right"))
    long = np.flatnonzero(end - begin > LONG_WORD)
    if len(long):  # text without white space is cut inside, between characters
        inside = [begin[long][i] + 1 + np.flatnonzero((h[a : b - 1] % INSIDE == 0) & (buf[a + 1 : b] & 0xC0 != 0x80)) for i, (a, b) in enumerate(zip(begin[long], end[long], strict=True))]
        at = np.concatenate(inside)
        begin, end_, cut_ = np.concatenate([begin, at]), np.concatenate([end, at]), np.concatenate([cut, np.ones(len(at), bool)])
        begin.sort()
        by = np.argsort(end_, kind="stable")
        end, cut = end_[by], cut_[by]
    doc = np.searchsorted(base, begin, side="right") - 1
    cut |= np.append(doc[1:] != doc[:-1], True)
    last = np.flatnonzero(cut)
    first = np.append(0, last[:-1] + 1)
    start, stop, owner = begin[first], end[last], doc[first]
    follow = np.append(start[1:], 0)
    tail = np.append(owner[1:] != owner[:-1], True)
    follow[tail] = (base + size)[owner[tail]]
    end_of = np.searchsorted(stop, start + least)  # the chunk with which the run from each chunk on has enough
    i = np.flatnonzero(end_of < len(stop))
    i = i[owner[end_of[i]] == owner[i]]
    j = end_of[i]
    digest = xxh64(buf, start[i], stop[j] - start[i], seed=7)
    check = xxh64(buf, start[i], stop[j] - start[i], seed=11).astype(np.uint32)
    return owner, start - base[owner], stop - base[owner], follow - base[owner], i, j, digest, check


def _flags(owner: np.ndarray, first: np.ndarray, last: np.ndarray, digest: np.ndarray, dup: list) -> np.ndarray:
    """True for chunks in runs that another document keeps or that the same text held before."""
    own = owner[first]
    gone = np.zeros(len(first), bool)
    order = np.lexsort((first, digest, own))
    o, d = own[order], digest[order]
    gone[order[1:]] = (o[1:] == o[:-1]) & (d[1:] == d[:-1])
    for k, x in enumerate(dup):
        if x is not None:
            a, b = np.searchsorted(own, k), np.searchsorted(own, k, side="right")
            gone[a:b] |= np.isin(digest[a:b], x)
    depth = np.zeros(len(owner) + 1, np.int64)
    np.add.at(depth, first[gone], 1)
    np.add.at(depth, last[gone] + 1, -1)
    return np.cumsum(depth[:-1]) > 0


def strip(docs: list[str | None], dup: list, least: int = LEAST) -> list[tuple[str | None, int, int, int]]:
    """(text without its duplicate runs, chunks, removed chunks, removed bytes) of each text."""
    raw = [(t or "").encode() for t in docs]
    owner, start, _, follow, first, last, digest, _ = chunks(raw, least)
    flag = _flags(owner, first, last, digest, dup)
    n = np.bincount(owner, minlength=len(docs))
    out = [(t, int(k), 0, 0) for t, k in zip(docs, n, strict=True)]
    if not flag.any():
        return out
    edge = np.flatnonzero(np.append(True, (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1])))
    stop = np.append(edge[1:], len(flag))
    runs = [(int(owner[a]), int(start[a]), int(follow[b - 1]), int(b - a)) for a, b in zip(edge, stop, strict=True) if flag[a]]
    by: dict[int, list] = {}
    for d, *x in runs:
        by.setdefault(d, []).append(x)
    for d, own in by.items():
        kept, at = [], 0
        for a, b, _ in own:
            kept.append(raw[d][at:a])
            at = b
        kept.append(raw[d][at:])
        text = b"".join(kept).decode()
        out[d] = (text, int(n[d]), sum(k for *_, k in own), len(raw[d]) - len(text.encode()))
    return out


def dedup(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``text_col`` cleaned, and ``n_chunks, removed_chunks, removed_bytes``
    (named ``chunk_count`` and so on where ``docs`` has such columns already: see ``_names``).

    Every row stays; the text of a full copy becomes empty. Rows with one id count as one document: between
    them nothing is removed. A row with a null id loses only what its own text repeats. A null text stays
    null, an empty one empty. A very long text is chunked whole, long words inside. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    dup = _duplicates(docs, least, id_col, text_col)
    own = _names(docs)
    known = may_hold(docs, id_col, written(bitmap(dup, "id"), "chunk-doc-bits"))
    with_dup = known.where(MAYBE).drop(MAYBE).join(dup.withColumnsRenamed({"id": own["id"], "dup": own["dup"]}), F.col(id_col) == F.col(own["id"]), "left").drop(own["id"])
    without = known.where(~F.col(MAYBE)).drop(MAYBE).withColumn(own["dup"], F.lit(None).cast("array<bigint>"))
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                dups = [None if not x.is_valid else x.values.to_numpy().view(np.uint64) for x in part.column(len(names))]
                found = strip(part.column(text_col).to_pylist(), dups, least)
                cols = [pa.array([x[0] for x in found], part.schema.field(n).type) if n == text_col else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[i] for x in found], pa.int64()) for i in (1, 2, 3))], [*names, own["n"], own["k"], own["b"]])

    schema = StructType([*docs.schema.fields, *(StructField(own[x], LongType()) for x in ("n", "k", "b"))])
    return with_dup.union(without).mapInArrow(trimmed(clean), schema)


@disposable
def _duplicates(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """``id, dup``: the digests of a document's runs of chunks that another document keeps."""
    src = texts(docs, id_col, text_col).where("id is not null")
    names_of = "id long, digest long, check int"

    def digests(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                chunk_of, *_, first, _, digest, check = chunks([(t or "").encode() for t in part.column("text").to_pylist()], least)
                owner = chunk_of[first]
                if bits is not None:
                    hit = (bits[(digest >> np.uint64(6)) % np.uint64(BITS)] >> (digest & np.uint64(63))) & np.uint64(1) == 1
                    owner, digest, check = owner[hit], digest[hit], check[hit]
                ids = part.column("id").to_numpy(zero_copy_only=False)
                order = np.lexsort((check, digest, owner))
                o, d, c = owner[order], digest[order], check[order]
                new = np.append(True, (o[1:] != o[:-1]) | (d[1:] != d[:-1]) | (c[1:] != c[:-1])) if len(o) else np.zeros(0, bool)
                cols = [pa.array(ids[o[new]].astype(np.int64)), pa.array(d[new].view(np.int64)), pa.array(c[new].view(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "check"])

    seen = src.mapInArrow(trimmed(digests), names_of)
    shared = seen.groupBy("digest", "check").agg(F.min("id").alias("owner"), F.max("id").alias("most"), F.count("*").alias("n")).where("owner < most")
    shared = written(shared.select("digest", "check", "owner", "n"), "chunk-shared")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(shared))
    again = src.mapInArrow(trimmed(lambda batches: digests(batches, bits.value)), names_of)
    dup = join_skewed(again, shared, ["digest", "check"]).where("id > owner")
    return written(dup.groupBy("id").agg(F.collect_set("digest").alias("dup")), "chunk-duplicates")


def _bits(shared: DataFrame) -> np.ndarray:
    """A bit for each shared digest: ``BITS`` numbers, whatever the input. It only spares rows that the exact join would drop."""
    word = F.pmod(F.shiftrightunsigned("digest", 6), F.lit(BITS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("digest").bitwiseAND(63).cast("int"))
    found = shared.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # BITS rows at most
    out = np.zeros(BITS, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _names(docs: DataFrame) -> dict[str, str]:
    """Names for the added columns that do not clash with those there are."""
    out = {}
    for key, name in (("id", "dup_id"), ("dup", "dup"), ("n", "n_chunks"), ("k", "removed_chunks"), ("b", "removed_bytes")):
        while name in docs.columns:
            name += "_"
        out[key] = name
    return out
