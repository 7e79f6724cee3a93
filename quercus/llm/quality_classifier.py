"""Quality by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words (lower-cased), the surface forms of its words
(letters, capitals, digits and signs, runs of a kind taken once) and marks for
repeated words, pairs and lines. A bounded sample of labelled texts gives the
vocabulary and, by the leading singular vectors of the weighted term matrix, the
latent space; how many documents hold a term is counted over all of them.
The labelled vectors (``max_labelled`` times ``dims`` numbers, whatever the size
of the corpus) are broadcast; each text is compared with all of them by exact
blocked cosine products, and the labels of its nearest neighbours vote with
their similarity.

Vectors are made text by text and rounded to a grid, and products of grid
vectors are exact, so a score never depends on what else is in a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import slices, texts, trimmed, written


@dataclass(frozen=True)
class VotingModel:
    """``max_labelled`` bounds the labelled sample (the documented bound of the fit); ``neighbours`` vote, each with its
    similarity to the power ``sharpness``. Of words and of forms the ``max_words`` and ``max_forms`` that most of the
    sample's texts hold make up the vocabulary; ``word_weight`` is that of words against forms."""

    max_labelled: int = 4096
    max_words: int = 4096
    max_forms: int = 4096
    word_weight: float = 0.3
    dims: int = 48
    neighbours: int = 15
    sharpness: float = 4.0


_KIND = bytes(32 if c in b" \t\n\x0b\x0c\r" else 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
LEVELS = (0.02, 0.05, 0.1, 0.2, 0.4)
WORD = b"\x00"  # begins the term of a word; no form has it first, as forms with it are left out
GRID = 1 << 14  # steps of a unit vector's components


def terms(text: str | None) -> tuple[Counter, int]:
    """Counts of a whole text's terms, and its number of words."""
    raw = (text or "").encode()
    words = raw.split()
    kinds = np.frombuffer(raw.translate(_KIND), np.uint8)
    if len(kinds):
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
    found = Counter(kinds.tobytes().replace(WORD, b"").split(b" "))
    del found[b""]
    found.update(Counter(WORD + w for w in raw.lower().split()))
    nxt = words[1:]
    lines = [x for x in raw.split(b"\n") if x]
    shares = {
        b"same word": sum(map(eq, words, nxt)) / max(1, len(nxt)),
        b"same pair": (len(nxt) - len(set(zip(words, nxt, strict=False)))) / max(1, len(nxt)),
        b"same line": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }
    for k, share in shares.items():  # one more term for each level that the share reaches
        for level in LEVELS:
            if share >= level:
                found[b"%s %d" % (k, 100 * level)] = max(1, len(words) // 10)
    if not words:
        found[b"no word"] = 1
    return found, len(words)


@dataclass
class Space:
    """Fitted on the sample: terms, their weights, the projection, and the labelled vectors on the grid."""

    vocabulary: dict[bytes, int]
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def held(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary (ascending) and weights of a text's terms."""
        found, n = terms(text)
        own = sorted((j, v) for k, v in found.items() if (j := self.vocabulary.get(k)) is not None)
        at = np.fromiter((j for j, _ in own), np.int64, len(own))
        return at, np.log1p(1000 * np.fromiter((v for _, v in own), np.float64, len(own)) / max(1, n)) * self.weight[at]

    def embed(self, docs: list[str | None]) -> np.ndarray:
        """Unit vectors as whole steps of the grid; texts without a known term have zeros."""
        out = np.zeros((len(docs), self.basis.shape[1]))
        for i, t in enumerate(docs):
            at, w = self.held(t)
            out[i] = (w[:, None] * self.basis[at]).sum(0)  # one after another, the same for any batch
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.rint(out / np.where(norm > 0, norm, 1) * GRID)


def vocabulary(sample: list[tuple[str | None, int]], model: VotingModel = VotingModel()) -> list[bytes]:
    """The terms of the sample that most of its texts hold, words and forms counted apart."""
    docs = Counter()
    for t, _ in sample:
        docs.update(terms(t)[0].keys())
    by = sorted(docs, key=lambda k: (-docs[k], k))
    return [k for k in by if k[:1] == WORD][: model.max_words] + [k for k in by if k[:1] != WORD][: model.max_forms]


def fit(sample: list[tuple[str | None, int]], model: VotingModel = VotingModel(), own: list[bytes] | None = None, counts: np.ndarray | None = None, total: int | None = None) -> Space:
    """The space of a labelled sample; an empty one gives a space without votes.

    ``counts``: how many of ``total`` documents hold each term of ``own``; without them the sample itself is counted.
    """
    own = vocabulary(sample, model) if own is None else own
    space = Space({k: j for j, k in enumerate(own)}, np.ones(len(own)), np.zeros((len(own), 0)), np.zeros((0, 0)), np.asarray([y for _, y in sample], np.float64))
    held = [space.held(t) for t, _ in sample]
    if counts is None:
        counts = np.bincount(np.concatenate([at for at, _ in held]) if held else np.zeros(0, np.int64), minlength=len(own))
        total = len(sample)
    kind = np.asarray([model.word_weight if k[:1] == WORD else 1.0 for k in own])
    space.weight = (np.log((1 + total) / (1 + counts)) + 0.1) * kind
    space.basis = _leading([(at, w * space.weight[at]) for at, w in held], len(own), model.dims)
    space.vectors = space.embed([t for t, _ in sample]) if sample else np.zeros((0, space.basis.shape[1]))
    return space


def _leading(rows: list[tuple[np.ndarray, np.ndarray]], width: int, dims: int, rounds: int = 10, block: int = 256) -> np.ndarray:
    """The leading right singular vectors of a matrix of sparse rows, by subspace iteration; only a block of rows is ever dense."""
    some = min(dims + 8, width, len(rows))
    if not some:
        return np.zeros((width, 0))

    def times(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A'A q, q'A'A q) of the matrix A."""
        out, small = np.zeros((width, q.shape[1])), np.zeros((q.shape[1],) * 2)
        for a in range(0, len(rows), block):
            x = np.zeros((min(block, len(rows) - a), width))
            for i, (at, w) in enumerate(rows[a : a + block]):
                x[i, at] = w
            y = x @ q
            out += x.T @ y
            small += y.T @ y
        return out, small

    q = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((width, some)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q)[0])[0]
    values, turn = np.linalg.eigh(times(q)[1])
    top = [i for i in np.argsort(-values)[:dims] if values[i] > 1e-9 * values.max(initial=0)]
    return np.ascontiguousarray(q @ turn[:, top])


def vote(space: Space, docs: list[str | None], model: VotingModel = VotingModel()) -> np.ndarray:
    """Scores from 0 to 1: the share of label 1 in the neighbours' similarity; no neighbour: the share in the sample.

    Of labelled texts that are equally near, those that come first in the sample (the smaller ids) vote.
    """
    n = len(space.labels)
    prior = float(space.labels.mean()) if n else 0.5
    if not n or not docs:
        return np.full(len(docs), prior)
    s = (space.embed(docs) @ space.vectors.T).astype(np.int64)  # whole numbers below 2 ** 53: exact in any order
    key = s * n + np.arange(n - 1, -1, -1)
    k = min(model.neighbours, n)
    near = -np.sort(-np.partition(key, n - k, axis=1)[:, n - k :], axis=1)
    who, cosine = n - 1 - near % n, near // n / GRID**2
    w = np.maximum(cosine, 0) ** model.sharpness
    up, total = np.zeros(len(docs)), np.zeros(len(docs))
    for j in range(k):  # nearest first
        total += w[:, j]
        up += w[:, j] * space.labels[who[:, j]]
    return np.clip(np.where(total > 0, up / np.where(total > 0, total, 1), prior), 0.0, 1.0)


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, model: VotingModel = VotingModel(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The sample is the ``max_labelled`` labelled rows with the smallest hashed ids that are not held out;
    labels other than 0 and 1 and rows with a null id are passed over, of contradicting labels the larger
    counts. Empty and null texts are scored by the term "no word"; a very long text counts whole. Of labelled
    texts that are equally near, those of smaller ids vote. Repeated rows are scored each; a null id is scored and
    never held out; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(model.max_labelled)  # the bound of the sample
    src = texts(docs, id_col, text_col)
    sample = src.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = [(r.text, r.label) for r in written(sample, "quality-sample").orderBy("id").collect()]  # max_labelled rows at most
    own = vocabulary(sample, model)
    places = spark.sparkContext.broadcast({k: j for j, k in enumerate(own)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(places.value) + 1, np.int64)  # the last: documents
        for batch in batches:
            for t in batch.column("text"):
                total[[j for k in terms(t.as_py())[0] if (j := places.value.get(k)) is not None]] += 1
                total[-1] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    counts = np.zeros(len(own) + 1, np.int64)
    for r in src.mapInArrow(trimmed(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the vocabulary
        counts[r.term] = r.n
    space = spark.sparkContext.broadcast(fit(sample, model, own, counts[:-1], int(counts[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(vote(space.value, part.column("text").to_pylist(), model))], ["id", "score"])

    scored = src.mapInArrow(trimmed(run), "id long, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
