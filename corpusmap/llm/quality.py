"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in NumPy.

1. Every term of the corpus has a fixed sparse random index vector. A term's word vector is the sum of the index vectors
   of its neighbours in all documents. Terms share ``TERMS`` buckets by hash, so that a task holds one table of
   neighbour counts of fixed size, and passes on 64 exact integers for each bucket.
2. A document's input is the mean of the word vectors of its terms, and its logarithmic length. Each word gives two
   terms, its letters and its outward form (case, digits, signs); a word like the one before has a form of its own.
3. The network is fitted on the driver on a sample of at most ``FIT_ROWS`` labelled rows, chosen by a hash of the id, of
   which every fifth is left out of training to choose the temperature that divides the network's output.
4. All whole texts are scored in one pass.

Defined cases: null and empty texts have the zero vector and a score like any; repeated rows are scored each; labels
without a document do not matter; without labels of both kinds the score is the share of ones, 0.5 without any;
empty tables give no rows. Rows of one text get one score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmap.llm.bpe import _texts
from corpusmap.llm.common import held_out, map_rows, training_sample

WORDS, FORMS = 1536, 512
TERMS = WORDS + FORMS
# The form of a word like the one before.
AGAIN = TERMS - 1
DIMENSIONS = 64
# Entries of an index vector that are not zero.
ONES = 8
WINDOW = 2
HIDDEN = 32
EPOCHS = 60
BATCH = 128
FIT_ROWS = 20_000
ACCEPT = 0.3
CACHED = 150_000
SEED = 20


def index_vectors() -> np.ndarray:
    """The random index vector of each bucket."""
    rng = np.random.default_rng(SEED)
    table = np.zeros((TERMS, DIMENSIONS), np.int64)
    for row in table:
        row[rng.choice(DIMENSIONS, ONES, replace=False)] = rng.choice([-1, 1], ONES)
    return table


class Terms(dict):
    """The form and the word bucket of each chunk, as one number; bounded."""

    RUNS = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.S)

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        letters = "".join(c for c in chunk if c.isalpha()).lower()
        form = "".join(self.RUNS.sub(self._run, chunk)[:6])
        code = xxhash.xxh32_intdigest(form) % (FORMS - 1) << 16 | xxhash.xxh32_intdigest(letters) % WORDS
        self[chunk] = code
        return code

    @staticmethod
    def _run(m: re.Match) -> str:
        run = m[0]
        if run[0].isalpha():
            return "a" if run.islower() else "A" if len(run) == 1 or run.isupper() else "Aa" if run[1:].islower() else "aA"
        return "9" if run[0].isdigit() else run[:2]

    def stream(self, text: str) -> np.ndarray:
        """The terms of a text in order, form and word in turn."""
        chunks = text.split()
        codes = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        out = np.empty(2 * len(codes), np.int64)
        out[0::2], out[1::2] = (codes >> 16) + WORDS, codes & 0xFFFF
        out[2::2][codes[1:] == codes[:-1]] = AGAIN
        return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The unit word vector of each bucket, from the neighbours in all documents."""
    names = [f"d{k}" for k in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        near = np.zeros(TERMS * TERMS, np.int32)
        held: list[np.ndarray] = []
        size = 0

        def count() -> None:
            line = np.concatenate(held)
            for k in range(1, WINDOW + 1):
                codes = line[:-k] * (TERMS + 1) + line[k:]
                # The number TERMS stands between documents.
                codes = codes[(line[:-k] != TERMS) & (line[k:] != TERMS)]
                a, b = np.divmod(codes, TERMS + 1)
                np.add.at(near, a * TERMS + b, 1)

        for batch in batches:
            for text in _texts(batch.column(0)):
                held += [terms.stream(text), np.full(WINDOW, TERMS)]
                size += len(held[-2])
                if size > 1 << 18:
                    count()
                    held, size = [], 0
        if held:
            count()
        table, index = near.reshape(TERMS, TERMS), index_vectors().astype(np.float64)
        made = np.empty((TERMS, DIMENSIONS), np.int64)
        # A few rows at a time. Counts of a task stay far below 2^53, so the products are exact.
        for k in range(0, TERMS, 128):
            both = table[k : k + 128].astype(np.float64) + table[:, k : k + 128].T
            made[k : k + 128] = np.rint(both @ index)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(TERMS)), *[pa.array(np.ascontiguousarray(made[:, k])) for k in range(DIMENSIONS)]],
            names=["term", *names],
        )

    schema = "term bigint, " + ", ".join(f"{n} bigint" for n in names)
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("term").agg(
        *[F.sum(n).alias(n) for n in names]
    )
    table = np.zeros((TERMS, DIMENSIONS))
    # One row for each bucket.
    for r in sums.collect():
        table[r["term"]] = [r[n] for n in names]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(terms: Terms, vectors: np.ndarray, text: str) -> np.ndarray:
    """The mean word vector of a text, and its logarithmic length."""
    line = terms.stream(text)
    if not len(line):
        return np.zeros(DIMENSIONS + 1, np.float32)
    counts = np.bincount(line, minlength=TERMS)
    some = np.flatnonzero(counts)
    mean = counts[some].astype(np.float32) @ vectors[some] / np.float32(len(line))
    return np.append(mean, np.float32(np.log1p(len(line))))


@dataclass
class Network:
    """Two layers, with the inputs' centre and spread and the temperature of the output."""

    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.centre) / self.spread @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Train on four fifths of the rows, in their order, and choose the temperature on the rest."""
    rng = np.random.default_rng(SEED)
    test = np.arange(len(y)) % 5 == 4
    train_x, train_y = x[~test], y[~test]
    spread = train_x.std(0)
    weights = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    net = Network(train_x.mean(0), np.where(spread > 0, spread, 1), weights)
    z = (train_x - net.centre) / net.spread
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train_y))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            a, b, c, d = net.weights
            hidden = np.tanh(z[rows] @ a + b)
            off = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - train_y[rows]) / len(rows)
            back = np.outer(off, c) * (1 - hidden**2)
            slopes = [z[rows].T @ back + 1e-3 * a, back.sum(0), hidden.T @ off + 1e-3 * c, off.sum(keepdims=True)]
            step += 1
            for w, g, (m, v) in zip(net.weights, slopes, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if test.any():
        logits = net.logits(x[test])

        def loss(t: float) -> float:
            return float(np.logaddexp(0, -np.where(y[test] > 0, 1, -1) * logits / t).mean())

        net.temperature = min(np.geomspace(0.5, 5, 47), key=loss)
    return net


def pooled_sample(sample: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and labels of a bounded sample, in the order of a hash of the id; copies of a text count once."""
    shipped = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            texts = list(_texts(batch.column(1)))
            x = [pooled(terms, shipped.value, t).tolist() for t in texts]
            keys = [xxhash.xxh64_intdigest(t) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(x, pa.list_(pa.float32())), batch.column(2)], names=["key", "x", "y"]
            )

    rows = sample.mapInArrow(run, "key bigint, x array<float>, y int").dropDuplicates(["key"]).collect()
    rows.sort(key=lambda r: r["key"])
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), DIMENSIONS + 1)
    return x, np.array([r["y"] for r in rows])


@dataclass
class Classifier:
    """Word vectors and the network, or the share of ones where there is nothing to learn from."""

    vectors: np.ndarray
    net: Network | None
    share: float

    def scores(self, terms: Terms, texts: Iterable[str]) -> np.ndarray:
        x = np.array([pooled(terms, self.vectors, t) for t in texts]).reshape(-1, DIMENSIONS + 1)
        return self.net.scores(x) if self.net else np.full(len(x), self.share)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Classifier:
    """Word vectors from all of ``docs`` (doc_id, text), the network from a bounded sample of its labelled rows."""
    vectors = word_vectors(docs)
    x, y = pooled_sample(training_sample(docs, labels, label, fit_rows), vectors)
    return Classifier(vectors, fit(x, y) if len(set(y.tolist())) > 1 else None, float(y.mean()) if len(y) else 0.5)


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
    fit_rows: int = FIT_ROWS, accept: float = ACCEPT,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, fit_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, terms = shipped.value, Terms()
        for batch in batches:
            scores = model.scores(terms, _texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted")
    )


def filter_documents(
    docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, accept: float = ACCEPT
) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id`` and ``text``) that the classifier accepts, with all their columns."""
    model = train(docs.select("doc_id", "text"), labels, label, fit_rows)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def each():
        known, terms = shipped.value, Terms()
        return lambda batch, texts: batch.filter(pa.array(known.scores(terms, texts) >= accept))

    return map_rows(docs, each)
