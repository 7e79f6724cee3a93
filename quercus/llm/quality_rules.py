"""Quality rules: repetition found with suffix arrays, next to plain counts.

Many texts share one suffix array: word codes of different texts never equal
each other, so no repeat crosses a text. Ranks are refined by prefix doubling,
only where they are not yet unique. The longest common prefixes of neighbours
in suffix order follow from the ranks of each level, or, where a single text is
so long that the levels would take too much memory, from Kasai's walk over the
text. A text position starts a repeated substring of ``m`` words exactly if the
common prefix with one of its two neighbours has ``m`` words; the maximal such
spans are united per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import bounded, slices, texts, trimmed

SYMBOLS = "[#*$%&|<>]"
SPACE = " \t\n\x0b\x0c\r"
PART = 1 << 19  # bytes of texts that share a suffix array
LEVELS = 1 << 19  # words up to which the ranks of each level are kept; above, they would take 80 bytes a word
PACKED = 7  # bytes of a word that fit into a number with the word's length


@dataclass(frozen=True)
class RepetitionRules:
    """``min_span``: words of a repeat that counts; at most ``max_fraction`` of the words may lie
    in such repeats, and no repeat may be longer than ``max_longest`` words."""

    min_span: int = 5
    max_fraction: float = 0.3
    max_longest: int = 100


def suffix_array(codes: np.ndarray, left: np.ndarray, levels_up_to: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``codes`` and the common prefix of each suffix with the one before it.

    ``left``: for each position the number of positions up to its text's end, itself included;
    codes of different texts must differ.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    ordered = codes[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    start = np.flatnonzero(new).astype(np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    levels, h, active = [rank], 1, order
    base = rank[active]
    while True:
        same = np.zeros(len(active), bool)
        if len(active) > 1:
            eq = base[1:] == base[:-1]
            same[1:] |= eq
            same[:-1] |= eq
        active, base = active[same], base[same]
        if not len(active):
            break
        key = base.astype(np.int64) * (n + 1)
        inside = left[active] > h
        key[inside] += rank[active[inside] + h] + 1
        by = np.argsort(key)
        active, base, key = active[by], base[by], key[by]
        del by
        idx = np.arange(len(active), dtype=np.int32)
        group = np.ones(len(active), bool)
        group[1:] = base[1:] != base[:-1]
        sub = np.ones(len(active), bool)
        sub[1:] = key[1:] != key[:-1]
        del key
        base = base + np.maximum.accumulate(np.where(sub, idx, 0)) - np.maximum.accumulate(np.where(group, idx, 0))
        if n <= levels_up_to:
            rank = rank.copy()
            levels.append(rank)
        rank[active] = base
        h *= 2
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    if n > levels_up_to:
        return sa, _kasai(codes, left, sa, rank)
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(n, np.int32)
    at = np.flatnonzero(levels[0][a] == levels[0][b]) if n > 1 else np.zeros(0, np.int64)
    a, b, found = a[at], b[at], np.zeros(len(at), np.int32)
    most = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero(found < most)
        ok = ok[levels[k][a[ok] + found[ok]] == levels[k][b[ok] + found[ok]]]
        found[ok] += 1 << k
    lcp[at + 1] = found
    return sa, lcp


def _kasai(codes: np.ndarray, left: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefixes in text order: a suffix shares at least one word less with its neighbour than the one before it."""
    lcp = np.zeros(len(codes), np.int32)
    c, order, place, room, out, h = *map(memoryview, (codes, sa, rank, left, lcp)), 0
    for i in range(len(c)):
        r = place[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        most = min(room[i], room[j])
        while h < most and c[i + h] == c[j + h]:
            h += 1
        out[r] = h
        h = max(0, h - 1)
    return lcp


def repeats(codes: np.ndarray, left: np.ndarray, levels_up_to: int = LEVELS) -> np.ndarray:
    """For each position the longest substring from there that its text holds at another place too."""
    best = np.zeros(len(codes), np.int32)
    if len(codes):
        sa, lcp = suffix_array(codes, left, levels_up_to)
        best[sa] = np.maximum(lcp, np.append(lcp[1:], np.int32(0)))
    return best


def covered(best: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Positions inside a repeated span of ``least`` words or more (or inside the first ``width`` words of one)."""
    idx = np.arange(len(best), dtype=np.int32)
    end = np.where(best >= least, idx + (best if width is None else np.int32(width)), np.int32(0))
    return np.maximum.accumulate(end) > idx if len(best) else np.zeros(0, bool)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS[1:-1]]] = True


def word_codes(raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each word; equal numbers mean equal words.

    Short words are their own bytes with their length; only longer ones are looked up one by one.
    """
    buf = np.frombuffer(raw + bytes(8), np.uint8)
    lanes = np.ndarray((len(raw) + 1,), "<i8", buf, strides=(1,))
    short = np.minimum(size, PACKED)
    code = lanes[begin] & ((np.int64(1) << (8 * short)) - 1)
    code |= short << 56
    own: dict[bytes, int] = {}
    long = np.flatnonzero(size > PACKED)
    at, end = begin[long].tolist(), (begin[long] + size[long]).tolist()
    code[long] = np.fromiter((-1 - own.setdefault(raw[a:b], len(own)) for a, b in zip(at, end, strict=True)), np.int64, len(long))
    return code


def measure(docs: list[str | None], rules: RepetitionRules, levels_up_to: int = LEVELS) -> dict[str, np.ndarray]:
    """The columns of :func:`quality_rules` for a list of whole texts."""
    raw = [(t or "").encode() for t in docs]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    whole = b"\n".join([*raw, b""])
    cut = np.cumsum(size + 1) - size - 1  # where each text begins; a line feed follows each
    buf = np.frombuffer(whole, np.uint8)
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True)).astype(np.int32)
    begin, length = edge[0::2], edge[1::2].astype(np.int64) - edge[0::2]
    del edge
    if len(docs):
        chars = np.add.reduceat(~space & (buf & 0xC0 != 0x80), cut, dtype=np.int64)
        symbols = np.add.reduceat(_IS_SYMBOL[buf], cut, dtype=np.int64)
    else:
        chars = symbols = np.zeros(0, np.int64)
    first = np.searchsorted(begin, cut)
    n = np.diff(np.append(first, len(begin)))
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), n)
    left = (np.repeat(np.cumsum(n), n) - np.arange(len(begin))).astype(np.int32)
    codes = word_codes(whole, begin, length)
    del length
    by = np.lexsort((codes, doc)) if len(docs) > 1 else np.argsort(codes, kind="stable")
    new = np.append(True, (codes[by][1:] != codes[by][:-1]) | (doc[by][1:] != doc[by][:-1])) if len(by) else np.zeros(0, bool)
    dense = np.empty(len(by), np.int32)
    dense[by] = np.cumsum(new, dtype=np.int32)
    del codes, by, new, begin
    best = repeats(dense, left, levels_up_to)
    del dense, left
    dup = []
    for t in docs:
        lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
        dup.append(len(lines) - len(set(lines)))
    per = lambda mask: np.bincount(doc[mask], minlength=len(n)).astype(np.int64)
    repeat_words, span_words = per(covered(best, 3, 3)), per(covered(best, rules.min_span))
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, doc, best)
    failed = (n < 50) | (100 * repeat_words > 50 * n)
    fraction = span_words / np.maximum(n, 1)
    return {
        "n_words": n.astype(np.int64),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.asarray(dup, np.int64),
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & (fraction <= rules.max_fraction) & (longest <= rules.max_longest),
        "repeated_fraction": fraction,
        "longest_repeat": longest,
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeated_fraction double, longest_repeat long"


def quality_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the measures; ``kept`` is the verdict.

    A null or empty text has no words and is not kept. Repeated rows are measured each; a null id stays
    null; other columns are ignored, whatever their names; an empty table gives no rows. A very long text
    is measured whole, alone, with memory in proportion to it. There are no ties: each row has its own verdict.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                found = measure(part.column("text").to_pylist(), rules)
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, found.values())], ["id", *found])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(trimmed(run), "id long, " + SCHEMA).withColumnRenamed("id", id_col)


def verdict(rules: RepetitionRules, text: Column) -> Column:
    """``kept`` of :func:`quality_rules` as a column: only the texts go to Python."""

    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(judged)(columns)

    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts_ in columns:
            batch = pa.RecordBatch.from_arrays([texts_], ["text"])
            kept = [measure(part.column("text").to_pylist(), rules)["kept"] for part in slices(batch, "text", PART)]
            yield pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))

    return run(text)


def keep_good(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, all columns as they are.

    Null, empty and short texts go, as their verdict says; each row is judged by its own text, so repeated
    rows and ids, and columns of any name, need no care; an empty table gives no rows.
    """
    bounded(docs.sparkSession)
    return docs.where(verdict(rules, F.col(text_col)))
