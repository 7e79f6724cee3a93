"""Byte-level BPE encoding and decoding, equal to the tokenizers library id for id.

Regular text is cut before each single space, where the pre-tokeniser always
cuts too, so every piece is encoded once and then found in a bounded cache.
Text without such cuts goes through the library's own pre-tokeniser; a long
unsplit piece is encoded by **tree concatenation**: halves in parallel, then
growing windows around each join until both sides agree. A sequence of BPE
tokens is the encoding of its bytes exactly if each neighbouring pair is the
encoding of the pair's bytes; a window whose first and last tokens are those
already there keeps every pair valid, so the joined ids are exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quercus.llm.common import slices, texts, trimmed

LONG = 8192  # bytes; longer unsplit pieces are cut in halves
CACHE = 400_000  # pieces kept per worker
#: Characters for which both libraries have the same classes (tests/llm compares them).
PLAIN = re.compile("[\x00-\x7f\xa1-ɏ]*")
#: Signs that a cut before and after leaves as they are.
SIGNS = ".,;:!?*$%&|#<>()-"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Irregular(Exception):
    pass


def byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Cache(dict):
    """Ids of pieces that follow a space; a word and the signs after it are pieces of their own."""

    def __init__(self, encode, single):
        super().__init__()
        self.encode, self.single, self.tails = encode, single, {}

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or PLAIN.fullmatch(piece)):
            ids = array("I", self.single((" " + piece).encode())).tobytes() if len(piece) <= 64 else self.encode(" " + piece)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        else:
            body = piece.rstrip(SIGNS)
            if len(body) < len(piece) and body.isalpha():
                tail = piece[len(body) :]
                if tail not in self.tails:
                    if len(self.tails) >= CACHE // 10:
                        self.tails.clear()
                    self.tails[tail] = self.encode(tail)
                ids = self[body] + self.tails[tail]
            else:
                ids = self.encode(" " + piece)
        if len(piece) <= 64 and len(self) < CACHE:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one tokenizers file (``path`` is a parameter; nothing is trained)."""

    def __init__(self, path: str, long: int = LONG):
        import tiktoken
        from tokenizers import Tokenizer

        self.long = long
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = byte_chars(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("merges are not in the order of the ids")
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with own rules are not supported")
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # shortcuts of the encoder; where a version lacks them, its public calls give the same ids more slowly
        core = getattr(self.fast, "_core_bpe", None)
        self.plain = getattr(core, "encode_ordinary", None) or self.fast.encode_ordinary
        self.piece = getattr(core, "encode_single_piece", None) or self._piece
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        self.id_of = ranks
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.cache = _Cache(self._short, self.piece)

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of the bytes of one piece: the pairs that the vocabulary joins first are joined until none is left."""
        ids = [self.id_of[bytes([b])] for b in piece]
        while len(ids) > 1:
            joined = [(self.id_of.get(self.bytes_of[a] + self.bytes_of[b], len(self.bytes_of)), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            best, i = min(joined)
            if best == len(self.bytes_of):
                break
            ids[i : i + 2] = [best]
        return ids

    def _short(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit integers."""
        if len(text) > self.long:
            return self._unsplit(text)
        if text.isascii() or PLAIN.fullmatch(text):
            return array("I", self.plain(text)).tobytes()
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def _unsplit(self, text: str) -> bytes:
        out = []
        for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text):
            piece = text[a:b]
            out.append(array("I", self.tree(piece.encode())).tobytes() if b - a > self.long else self._short(piece))
        return b"".join(out)

    def tree(self, piece: bytes) -> list[int]:
        """Ids of one unsplit piece, by tree concatenation."""
        one = self.piece
        parts = [piece[i : i + self.long] for i in range(0, len(piece), self.long)]
        with ThreadPoolExecutor(2) as pool:  # the encoder releases the interpreter's lock
            level = list(pool.map(one, parts))
            while len(level) > 1:
                pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
                level = list(pool.map(lambda p: self.join(*p) if len(p) == 2 else p[0], pairs))
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined bytes of two encodings."""
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            mid = self.piece(b"".join(map(self.bytes_of.__getitem__, [*a, *b])))
            left_ok = width >= len(left) or (len(mid) > 2 and mid[:2] == a[:2])
            right_ok = width >= len(right) or (len(mid) > 2 and mid[-2:] == b[-2:])
            if left_ok and right_ok:
                return [*left[:-width], *mid, *right[width:]]
            width *= 2

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut and any(s in text for s in self.special):
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.encode(x) for x in self.cut.split(text))
        first, *pieces = text.split(" ")
        if first and first[-1].isspace() and pieces:
            return self._irregular(text)
        last = b""
        if pieces and pieces[-1] and pieces[-1][-1].isspace() and not pieces[-1][0].isspace():
            last = self._short(" " + pieces.pop())
        try:
            return (self._short(first) if first else b"") + b"".join(map(self.cache.__getitem__, pieces)) + last
        except _Irregular:
            return self._irregular(text)

    def _irregular(self, text: str) -> bytes:
        """Cut where a single space stands between two characters that are no white space, and encode what is between."""
        out, at = [], 0
        for m in re.finditer(r"(?<=\S) (?=\S)", text):
            out.append(text[at : m.start()])
            at = m.start()
        out.append(text[at:])
        return b"".join(self.cache[x[1:]] if x[:1] == " " and x[1:2] != " " and len(x) > 1 and not x[1].isspace() and not x[-1].isspace() else self._short(x) for x in out if x)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) of every whole text, however long.

    A null or empty text has no ids; a null id stays null; repeated rows are encoded each; there are no ties; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.frombuffer(c.encode(t), "<i4") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    src = texts(docs, id_col, text_col)
    return src.mapInArrow(trimmed(run), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``text`` of every array of ids, special tokens included.

    Null ids give the empty text, and so do null or unknown ids inside an array (out of the vocabulary), as in the
    library; bytes that are no UTF-8 give replacement characters. A null id stays null; repeated rows are decoded
    each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            text = [c.decode(np.asarray([i for i in x or [] if i is not None and 0 <= i < len(c.bytes_of)], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], ["id", "text"])

    src = df.select(df[id_col].cast("long").alias("id"), df[ids_col].alias("ids"))
    return src.mapInArrow(trimmed(run), "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes every whole text in one pass.

    Null and empty texts, null ids, repeated rows, empty tables and other columns as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids_sha, text_sha = [], [], []
                for t in part.column("text").to_pylist():
                    ids = c.encode(t)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = texts(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")
    return src.mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
