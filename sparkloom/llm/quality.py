"""Document quality: random-indexing word vectors, pooled, into a two-layer network.

Every row of a table has a sparse random index vector.  A word's vector is the
sum of the index vectors met around it in all documents.  The VOCABULARY words
that most labelled documents of the sample have are rows of their own; all other
words share ROWS hashed rows, so the table has the same size at any scale.  A
document is the mean, spread and neighbour products of its words'
vectors; a small numpy network maps it to a probability, and a temperature
fitted on rows that training has not seen calibrates it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, map_texts, removed, spread, table, written
from .toxicity import bounded_sample

VOCABULARY, ROWS, DIM, NONZERO, REACH = 8192, 8192, 32, 4, 2
ALL = VOCABULARY + ROWS
_TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


class _Rows(dict):
    """token -> row of the vector table; `own` has the tokens with rows of their own."""

    LIMIT = 40_000

    def __init__(self, own: dict[str, int]):
        super().__init__(own)
        self.own = own

    def __missing__(self, token: str) -> int:
        if len(self) > len(self.own) + self.LIMIT:
            self.clear()
            self.update(self.own)
        self[token] = row = VOCABULARY + zlib.crc32(token.encode("utf-8", "replace")) % ROWS
        return row


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of every row's random index vector."""
    draw = np.random.default_rng(7)
    return np.argsort(draw.random((ALL, DIM)), axis=1)[:, :NONZERO], draw.choice([-1.0, 1.0], (ALL, NONZERO))


def tokens(text: str | None) -> list[str]:
    """Tokens of a whole text, in order: words, and runs of other marks; none for null."""
    return _TOKEN.findall((text or "").lower())


def token_rows(text: str | None, rows: _Rows) -> np.ndarray:
    """Rows of the tokens of a whole text, in order."""
    found = tokens(text)
    return np.fromiter(map(rows.__getitem__, found), np.int64, len(found))


def vocabulary(sample: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """token -> its own row, for the `most` tokens that most texts of the bounded sample have, at least two."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(set(tokens(text)))
                if len(seen) > 100_000:  # Spark adds the parts up
                    yield pd.DataFrame(list(seen.items()), columns=["token", "n"])
                    seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["token", "n"])

    counts = sample.select("text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1")
    return {r["token"]: k for k, r in enumerate(counts.orderBy(F.desc("n"), "token").limit(most).collect())}


def word_vectors(texts: DataFrame, own: dict[str, int]) -> np.ndarray:
    """Sum the neighbours' index vectors of every word over all documents.

    Each task adds up its own table and sends its rows that occurred; Spark
    sums them by row.  The sums are whole numbers, so their order makes no
    difference.  What reaches the driver is ALL x DIM numbers.
    """
    names = [f"v{k}" for k in range(DIM)]
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        rows, sums = _Rows(shared.value), np.zeros(ALL * DIM)
        gap, held, size = np.full(REACH, -1), [], 0  # no context reaches over the end of a text

        def add() -> None:
            ids = np.concatenate(held)
            for off in range(1, REACH + 1):
                a, b = ids[:-off], ids[off:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for word, near in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        np.add(sums, np.bincount(word * DIM + place[near, j], sign[near, j], ALL * DIM), out=sums)

        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                for text in batch.column(0).slice(at, PART_ROWS).to_pylist():
                    found = token_rows(text, rows)
                    held += [found, gap]
                    size += len(found)
                    if size > 400_000:
                        add()
                        held, size = [], 0
        if held:
            add()
        full = sums.reshape(ALL, DIM)
        met = np.flatnonzero(full.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(full[met, k].astype(np.int64)) for k in range(DIM)]], names=["r", *names])

    parts = texts.select("text").mapInArrow(run, "r long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((ALL, DIM), np.float32)
    for row in parts.groupBy("r").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[row["r"]] = [row[n] for n in names]
    return out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One feature row per document: mean, spread and neighbour products of word vectors, and the log of its length."""
    if not len(ids):
        return np.zeros(3 * DIM + 2, np.float32)
    v = vectors[ids]
    beside = v[:-1] * v[1:] if len(v) > 1 else np.zeros((1, DIM), np.float32)
    return np.concatenate([v.mean(0), v.std(0), beside.mean(0), [beside.sum(1).mean(), np.log1p(len(ids))]])


class QualityModel:
    """Vocabulary, word vectors and the weights of the network."""

    def __init__(self, own: dict[str, int], vectors: np.ndarray, parts: dict[str, np.ndarray]):
        self.own, self.vectors, self.parts = own, vectors, parts

    def predict(self, features: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of feature rows."""
        p = self.parts
        hidden = np.tanh((features - p["mean"]) / p["scale"] @ p["w1"] + p["b1"])
        return 1 / (1 + np.exp(-np.clip((hidden @ p["w2"] + p["b2"]) / p["temperature"], -30, 30)))

    def score(self, texts: list[str | None], rows: _Rows | None = None) -> np.ndarray:
        """Scores of a batch of whole texts."""
        rows = _Rows(self.own) if rows is None else rows
        return self.predict(np.array([pool(token_rows(t, rows), self.vectors) for t in texts]).reshape(-1, 3 * DIM + 2))


def train(features: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> dict[str, np.ndarray]:
    """Fit the network by Adam on nine tenths of the rows and its temperature on the rest.

    With no rows, or labels of one kind only, it gives that kind's share (a half without rows).
    """
    draw = np.random.default_rng(seed)
    n, d = features.shape
    share = (labels.sum() + 1) / (n + 2)
    parts = {"mean": np.zeros(d), "scale": np.ones(d), "w1": draw.normal(0, d**-0.5, (d, hidden)), "b1": np.zeros(hidden), "w2": np.zeros(hidden), "b2": np.array(np.log(share / (1 - share))), "temperature": np.array(1.0)}
    if n < 20 or labels.min() == labels.max():
        return parts
    order = draw.permutation(n)
    cut = max(1, n // 10)
    test, fit = order[:cut], order[cut:]
    parts["mean"], parts["scale"] = features[fit].mean(0), features[fit].std(0) + 1e-3
    x, y = (features - parts["mean"]) / parts["scale"], labels.astype(float)
    parts["w2"] = draw.normal(0, hidden**-0.5, hidden)
    names = ("w1", "b1", "w2", "b2")
    m1, m2, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        mixed = draw.permutation(fit)
        for at in range(0, len(mixed), 128):
            b = mixed[at : at + 128]
            h = np.tanh(x[b] @ parts["w1"] + parts["b1"])
            e = (1 / (1 + np.exp(-(h @ parts["w2"] + parts["b2"]))) - y[b]) / len(b)
            back = np.outer(e, parts["w2"]) * (1 - h * h)
            grads = {"w1": x[b].T @ back + 1e-4 * parts["w1"], "b1": back.sum(0), "w2": h.T @ e + 1e-4 * parts["w2"], "b2": e.sum()}
            step += 1
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                parts[k] = parts[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(x[test] @ parts["w1"] + parts["b1"]) @ parts["w2"] + parts["b2"]
    grid = np.geomspace(0.5, 5, 60)
    loss = [np.mean(np.logaddexp(0, logit / t) - y[test] * logit / t) for t in grid]
    parts["temperature"] = grid[int(np.argmin(loss))]
    return parts


MOST_LABELS = 20_000


def fitted(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> QualityModel:
    """Vectors from all documents; vocabulary and network from at most `most` labelled ones outside the fold (crc32 mod 3 is 1)."""
    sample = written(bounded_sample(documents, labels, "quality", 3, 1, most), "sample")
    own = vocabulary(sample)
    vectors = word_vectors(documents, own)
    shared = documents.sparkSession.sparkContext.broadcast((own, vectors))  # 2 MB at any scale

    def begin():
        own, vectors = shared.value
        rows = _Rows(own)
        return lambda texts: [[pool(token_rows(t, rows), vectors).astype("float32").tobytes() for t in texts]]

    rows = map_texts(sample, "text", ["label"], {"f": ("binary", pa.binary())}, begin).toPandas()
    removed(sample)
    # Rows come in any order; training takes a defined one.
    rows = rows.sort_values(["f", "label"], kind="stable")
    x = np.array([np.frombuffer(f, "float32") for f in rows["f"]]).reshape(-1, 3 * DIM + 2)
    return QualityModel(own, vectors, train(x, (rows["label"] > 0).to_numpy()))


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, quality): the score of every whole text, one row per input row, null and empty texts too."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def begin():
        model = shared.value
        rows = _Rows(model.own)
        return lambda texts: [model.score(texts, rows).tolist()]

    return map_texts(documents, "text", ["doc_id"], {"quality": ("double", pa.float64())}, begin)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Score all documents; see the contract's columns.  A null id counts as the empty text in the fold."""
    documents = spread(table(spark, sf_dir, "documents"))
    scored = score_quality(documents, fitted(documents, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return scored.select("doc_id", held.alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"))
