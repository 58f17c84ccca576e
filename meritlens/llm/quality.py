"""Quality classifier: random-indexing word vectors and a two-layer numpy network.

Every token has a sparse random index vector fixed by a hash of its text.  A token's context vector
is the sum of the index vectors of its neighbours in the training texts (random indexing), damped
and scaled to unit length.  A document is the mean of its tokens' vectors.  Besides each word there
is a token for its shape (runs of lower case, upper case, digits and symbols), one for a word equal
to the one before it and one for a word that the training texts lack.  A network with one hidden
layer scores the pooled vector; its logit is divided by a temperature fitted on examples kept out
of the training.

Everything is fitted on a bounded sample: EXAMPLES labelled rows, chosen by a hash of the id, and of
those whole texts up to BYTES in all; the model keeps the WORDS most frequent words and SHAPES shapes.

Edge cases: null and empty texts pool to the zero vector; a null label is no example; without
examples of both kinds every score is the share of label 1 (0 without examples); very long texts are
pooled whole; repeated rows are scored alike, and equal words and shapes count as often as they occur;
words of equal frequency enter the vocabulary in the order of the sample; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.llm.common import fold_of, labelled_sample, slices, texts_of

#: Bounds of the sample that vectors, network and temperature are fitted on: rows and bytes of text.
EXAMPLES, BYTES = 5000, 32 << 20
#: Words and shapes of the model.
WORDS, SHAPES = 50_000, 500
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
DIM, HIDDEN, SPARSE, REACH = 64, 32, 6, 2
AGAIN, UNKNOWN = "<again>", "<unknown>"


def shape_of(word: str) -> str:
    """Runs of character kinds: 'Abc!!' becomes '<Aa!>' (first four runs)."""
    runs: list[str] = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "w" if c.isalnum() else c
        if not runs or runs[-1] != kind:
            runs.append(kind)
            if len(runs) == 4:
                break
    return f"<{''.join(runs)}>"


def index_vector(token: str) -> np.ndarray:
    """Sparse ternary vector fixed by the token's text."""
    out = np.zeros(DIM, dtype=np.float32)
    for k in range(SPARSE):
        h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), seed=k + 1)
        out[h % DIM] += 1.0 if (h >> 32) & 1 else -1.0
    return out


@dataclass(frozen=True)
class Model:
    """Vectors by vocabulary place; weights of the network; temperature."""

    words: tuple[str, ...]
    shapes: tuple[str, ...]
    vectors: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if not len(self.w2):
            return np.full(len(pooled), self.prior)
        z = np.tanh(pooled @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -60, 60)))


class Pooler:
    """Mean token vectors of texts; remembers the places of words it has met."""

    MEMORY = 400_000

    def __init__(self, model: Model):
        self.words = {w: i for i, w in enumerate(model.words)}
        self.shapes = {s: len(model.words) + i for i, s in enumerate(model.shapes)}
        self.again = self.shapes[AGAIN]
        self.unknown = self.shapes[UNKNOWN]
        self.vectors = model.vectors
        self.known: dict[str, int] = {}
        self.places = np.zeros((1 << 12, 2), dtype=np.int64)

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.MEMORY:
            self.known.clear()
        for w in set(words).difference(self.known):
            k = len(self.known)
            if k == len(self.places):
                self.places = np.concatenate([self.places, np.zeros_like(self.places)])
            self.known[w] = k
            self.places[k] = (self.words.get(w.lower(), self.unknown), self.shapes.get(shape_of(w), self.unknown))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def pool(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]), dtype=np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            if not words:
                continue
            k = self._places(words)
            counts = np.bincount(self.places[k].ravel(), minlength=0)
            again = int((k[1:] == k[:-1]).sum())
            used = np.flatnonzero(counts)
            out[i] = (counts[used].astype(np.float32) @ self.vectors[used] + again * self.vectors[self.again]) / (2 * len(words))
        return out


def random_indexing(texts: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    """Vocabulary, shapes and context vectors learned from the texts."""
    counts, shapes = Counter(), Counter()
    for words in map(str.split, texts):
        counts.update(w.lower() for w in words)
        shapes.update(map(shape_of, words))
    vocabulary = [w for w, n in counts.most_common(WORDS) if n > 1]
    kinds = [AGAIN, UNKNOWN, *(s for s, n in shapes.most_common(SHAPES) if n > 2)]
    place = {w: i for i, w in enumerate(vocabulary)}
    kind = {s: len(vocabulary) + i for i, s in enumerate(kinds)}
    index = np.array([index_vector(t) for t in [*vocabulary, *kinds]], dtype=np.float32)
    context = np.zeros_like(index)
    for words in map(str.split, texts):
        ids = np.array([place.get(w.lower(), kind[UNKNOWN]) for w in words], dtype=np.int64)
        forms = np.array([kind.get(shape_of(w), kind[UNKNOWN]) for w in words], dtype=np.int64)
        for d in range(1, REACH + 1):
            for a, b in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
                np.add.at(context, a, index[b])
            np.add.at(context, forms[d:], index[forms[:-d]])
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
    own = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-6)
    vectors = 0.5 * context + own
    vectors[len(vocabulary) :] = 2 * own[len(vocabulary) :]  # few and telling: kept apart
    return vocabulary, kinds, vectors.astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 400, seed: int = 7):
    """Full-batch Adam on the cross-entropy of a tanh network; kinds weigh alike up to a factor."""
    rng = np.random.default_rng(seed)
    theta = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        h = np.tanh(x @ theta[0] + theta[1])
        p = 1 / (1 + np.exp(-np.clip(h @ theta[2] + theta[3], -30, 30)))
        d = (p - y) / len(y)
        dh = np.outer(d, theta[2]) * (1 - h**2)
        grads = [x.T @ dh + 1e-4 * theta[0], dh.sum(0), h.T @ d + 1e-4 * theta[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            theta[i] = theta[i] - 0.03 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return theta


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy on a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    losses = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(examples: list[tuple[str, int]]) -> Model:
    """Learn vectors, network and temperature from (text, label) examples."""
    y = np.array([int(bool(v)) for _, v in examples], dtype=float)
    none = np.zeros(0)
    if len(set(y)) < 2:
        prior = float(y.mean()) if len(y) else 0.0
        return Model((), (AGAIN, UNKNOWN), np.zeros((2, DIM), np.float32), none, none, none, 0.0, 1.0, prior)
    texts = [t for t, _ in examples]
    words, shapes, vectors = random_indexing(texts)
    bare = Model(tuple(words), tuple(shapes), vectors, none, none, none, 0.0, 1.0, float(y.mean()))
    pooled = Pooler(bare).pool(texts).astype(float)
    mean, spread = pooled.mean(0), pooled.std(0) + 1e-3
    x = (pooled - mean) / spread
    kept = np.arange(len(y)) % 5 == 0  # for the temperature
    if len(set(y[~kept])) < 2:
        kept[:] = False
    w1, b1, w2, b2 = _train(x[~kept], y[~kept])
    z = np.tanh(x @ w1 + b1) @ w2 + b2
    temperature = _temperature(z[kept], y[kept]) if kept.any() else 1.0
    w1 = w1 / spread[:, None]
    return Model(tuple(words), tuple(shapes), vectors, w1, b1 - mean @ w1, w2, float(b2[0]), temperature, float(y.mean()))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = EXAMPLES) -> Model:
    """Model from a bounded sample of labelled documents outside the held-out fold."""
    rows = labelled_sample(spark, docs, labels, "quality", FOLDS, HELD_OUT, max_rows, BYTES)
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r[0]).encode()))
    return fit([(text, y) for _, text, y in rows])


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    shared = spark.sparkContext.broadcast(model)  # bounded by WORDS

    def run(batches):
        pooler = Pooler(shared.value)
        for batch in batches:
            for start, stop in slices(batch, "text"):
                p = shared.value.probability(pooler.pool(texts_of(batch, "text", start, stop)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(p.astype(float))], names=["doc_id", "score"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``."""
    shared = spark.sparkContext.broadcast(learn(spark, docs, labels))

    def run(batches):
        pooler = Pooler(shared.value)
        for batch in batches:
            for start, stop in slices(batch, "text"):
                kept = shared.value.probability(pooler.pool(texts_of(batch, "text", start, stop))) >= threshold
                yield batch.slice(start, stop - start).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(spark, docs, learn(spark, docs, labels)).select(
        "doc_id",
        (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
