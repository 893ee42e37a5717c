"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word, number and run of marks is hashed to one of ``BUCKETS`` buckets, and has a sparse random index
vector by its bucket. A bucket's vector is the sum of the index vectors of the words around its words, over
all documents, brought to unit length; so words used alike get like vectors. A document is the mean and
the spread of its words' vectors, how like and how often the same they are in a row, and how long it is. The network has one hidden layer, trained by
gradient steps on at most ``SAMPLE`` labelled rows; a part of them is held back to stop the training and to
set the temperature that makes the scores probabilities.

What is trained on, and what is sent to every task, has a fixed size: a table of ``BUCKETS`` x ``WIDTH`` and
the network's weights. All counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathclear.llm.pieces import classes, code_points, mixed, powers, steps

BUCKETS, WIDTH, NEIGHBOURS, SPARSE = 1 << 13, 48, 2, 4
#: Most labelled rows that the network is fitted to (those of smallest hash of their id).
SAMPLE = 20_000
#: Code points pooled at once (a word takes some hundred bytes of vectors meanwhile).
PART = 400_000
#: Columns of a pooled document.
FEATURES = 2 * WIDTH + 5
HIDDEN, ROUNDS, BATCH, RATE = 32, 60, 256, 3e-3

_LONGEST = 24  # code points of a word that count for its bucket's hash; beyond, the hash goes on in a circle
_POWERS = powers(0xBF58476D1CE4E5B9, _LONGEST)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every word, and the edges of the texts' words.

    A word is a run of letters, of digits or of other marks. Letters keep their case; the hash of a word
    in capitals alone also tells so (its bucket is another one than that of the same word in small letters).
    """
    joined = "\n".join(texts)
    cp = code_points(joined)
    kind = classes()[cp]
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    kind[(first + size)[:-1]] = 4
    begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(cp) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(cp)].astype(np.int64)
    keep = (kind[begin] >= 1) & (kind[begin] <= 3)
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    length = end - begin
    at = np.cumsum(length) - length
    offset = np.arange(length.sum()) - np.repeat(at, length)
    value = mixed(cp[np.repeat(begin, length) + offset], 17) * _POWERS[offset % _LONGEST]
    bucket = (mixed(np.add.reduceat(value, at), 19) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    doc = np.searchsorted(first, begin, side="right") - 1
    return bucket, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every bucket's index vector."""
    bits = mixed(np.arange(BUCKETS * SPARSE), 23).reshape(BUCKETS, SPARSE)
    return (bits % np.uint64(WIDTH)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of index vectors around the words of each bucket, one row for each bucket this task has met."""
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * WIDTH)
    for batch in batches:
        for _, texts in steps(batch, most=PART):
            bucket, doc, _ = words(texts)
            for gap in range(1, NEIGHBOURS + 1):
                near = np.flatnonzero(doc[gap:] == doc[:-gap])
                a, b = bucket[near], bucket[near + gap]
                for x, y in ((a, b), (b, a)):
                    for k in range(SPARSE):
                        total += np.bincount(x * WIDTH + place[y, k], weights=sign[y, k], minlength=len(total))
    table = total.reshape(BUCKETS, WIDTH)
    met = np.flatnonzero(np.abs(table).sum(1) > 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(met), pa.FixedSizeListArray.from_arrays(pa.array(table[met].ravel().astype(np.float32)), WIDTH).cast(pa.list_(pa.float32()))],
        names=["bucket", "vector"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from the texts of all documents (zero where a bucket has no context)."""
    parts = docs.select("text").mapInArrow(_contexts, "bucket long, vector array<float>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("vector")[i].cast("double")) for i in range(WIDTH)]).alias("vector"))
    vectors = np.zeros((BUCKETS, WIDTH))
    got = sums.toPandas()  # at most BUCKETS rows
    if len(got):
        vectors[got.bucket.to_numpy()] = np.stack(got.vector.to_numpy())
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every text, how they follow each other, and how many there are.

    The last columns: mean product of neighbouring words' vectors, shares of words that are the one before
    or the one before that again, share of distinct words, and the number of words. Zeros for no words.
    """
    bucket, doc, edges = words(texts)
    count = np.diff(edges)
    out = np.zeros((len(texts), FEATURES), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        given = vectors[bucket]
        mean = np.add.reduceat(given, edges[some], axis=0, dtype=np.float64) / count[some, None]
        square = np.add.reduceat(given * given, edges[some], axis=0, dtype=np.float64) / count[some, None]
        out[some, :WIDTH] = mean
        out[some, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        for column, gap, like in ((0, 1, lambda a, b: np.einsum("ij,ij->i", vectors[a], vectors[b])),
                                  (1, 1, np.equal), (2, 2, np.equal)):
            near = np.flatnonzero(doc[gap:] == doc[:-gap])
            got = like(bucket[near], bucket[near + gap]).astype(np.float64)
            out[:, 2 * WIDTH + column] = np.bincount(doc[near], got, len(texts)) / np.maximum(count - gap, 1)
        kinds = np.unique(doc * BUCKETS + bucket) // BUCKETS
        out[:, 2 * WIDTH + 3] = np.bincount(kinds, minlength=len(texts)) / np.maximum(count, 1)
    out[:, -1] = np.log1p(count) / 10
    return out


@dataclass(frozen=True)
class Network:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    shift: np.ndarray
    second: np.ndarray
    bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.first + self.shift, 0)
        return hidden @ self.second + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the mean log loss; the weights of the round that does best on the rows held back.

    Without rows of both labels, the network answers with the share of label 1 (1 without rows).
    """
    rng = np.random.default_rng(seed)
    wide = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    centre = x.mean(0) if len(y) else np.zeros(wide)
    scale = x.std(0) + 1e-3 if len(y) else np.ones(wide)
    start = [rng.normal(0, np.sqrt(2 / wide), (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
             np.array(np.log(share / (1 - share)))]
    if len(set(y.tolist())) < 2:
        return Network(centre, scale, start[0] * 0, start[1], start[2] * 0, float(start[3]), 1.0)
    order = rng.permutation(len(y))
    held, used = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
    given = (x - centre) / scale
    weights, moments, squares = start, [np.zeros_like(w) for w in start], [np.zeros_like(w) for w in start]
    best, kept, step = np.inf, [w.copy() for w in weights], 0
    for _ in range(ROUNDS):
        used = rng.permutation(used)
        for i in range(0, len(used), BATCH):
            a, t = given[used[i : i + BATCH]], y[used[i : i + BATCH]]
            w1, b1, w2, b2 = weights
            hidden = np.maximum(a @ w1 + b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500))) - t) / len(t)
            back = np.outer(error, w2) * (hidden > 0)
            slopes = [a.T @ back + 1e-5 * w1, back.sum(0), hidden.T @ error + 1e-5 * w2, error.sum()]
            step += 1
            for k, g in enumerate(slopes):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                squares[k] = 0.999 * squares[k] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (moments[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
        w1, b1, w2, b2 = weights
        now = _loss(np.maximum(given[held] @ w1 + b1, 0) @ w2 + b2, y[held])
        if now < best:
            best, kept = now, [w.copy() for w in weights]
    w1, b1, w2, b2 = kept
    raw = np.maximum(given[held] @ w1 + b1, 0) @ w2 + b2
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    temperature = min(grid, key=lambda t: _loss(raw / t, y[held]))
    return Network(centre, scale, w1, b1, w2, float(b2), float(temperature))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts and the network fitted to at most ``SAMPLE`` labelled ones."""
    vectors = word_vectors(docs)
    taught = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(
        ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, most=PART):
                yield pa.RecordBatch.from_arrays(
                    [part.column("mark"), part.column("quality"), _rows(pooled(texts, vectors))], names=["mark", "quality", "x"])

    # SAMPLE bounds what is broadcast, and what comes back.
    sample = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").select(
        F.xxhash64("doc_id").alias("mark"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(
        features, "mark long, quality int, x binary").orderBy("mark", "quality", "x").limit(SAMPLE).toPandas()
    x = np.frombuffer(b"".join(map(bytes, sample.x)), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return vectors, fit(x, sample.quality.to_numpy().astype(np.float64))


def with_score(docs: DataFrame, model: tuple[np.ndarray, Network], name: str = "score") -> DataFrame:
    """The rows of ``docs`` with the score of their text as a further column ``name``."""
    vectors, network = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, most=PART):
                scores = network.scores(pooled(texts, vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, from its text alone.

    ``labels`` has doc_id and quality (0 or 1). Null labels or ids teach nothing; a document labelled more
    than once counts each time. Null texts are empty, and scored; rows that repeat are scored each; other
    columns are not read. Without labels every score is that of label 1.
    """
    rows = docs.select("doc_id", "text")
    scored = with_score(rows, learn(rows, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they were."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, learn(docs, labels), name).filter(F.col(name) >= 0.5).select(*docs.columns)
