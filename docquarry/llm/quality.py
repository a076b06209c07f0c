"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Each word (hashed to one of BUCKETS) has a sparse ternary index vector; its word vector is the sum of the index
vectors of the words around it, over a bounded sample of labelled documents. A token also stands for its
shape ("EDTH!!" for "A!!"), which is a word like any other. A document is the mean of its tokens' vectors,
their spread, its length and its share of distinct tokens. A held-back part of the sample sets the temperature.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import Scratch, in_fold, table

BUCKETS, DIMS, NONZERO, NEAR = 1 << 14, 32, 6, 2
#: Documents of each label that are fitted to, by the hash of their ids.
TRAIN_DOCS = 2500
#: Tokens whose contexts are counted at once.
CONTEXT = 1 << 19
HIDDEN, EPOCHS, RATE, L2 = 24, 60, 0.01, 1e-4
CACHE = 150_000
_RUN = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return "\x00" + _RUN.sub(r"\1\1", kinds)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def context_sums(ids: np.ndarray, doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the NEAR words on both sides, by bucket; doc tells documents apart."""
    out = np.zeros((BUCKETS, DIMS), np.float64)
    for d in range(1, NEAR + 1):
        same = doc[d:] == doc[:-d]
        for a, b in ((ids[:-d][same], ids[d:][same]), (ids[d:][same], ids[:-d][same])):
            pair, n = np.unique(a.astype(np.int64) * BUCKETS + b, return_counts=True)
            for k in range(DIMS):
                out[:, k] += np.bincount(pair // BUCKETS, n * index[pair % BUCKETS, k], BUCKETS)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.sd @ w1 + b1) @ w2 + b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Pooler:
    """Features of documents; each distinct token's vector is kept in a bounded cache."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.at = vectors, {}
        self.rows = np.zeros((CACHE, DIMS), np.float32)

    def features(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        n = len(tokens)
        mean, square, seen = np.zeros(DIMS), np.zeros(DIMS), set()
        for i in range(0, n, CACHE // 2):
            part = tokens[i : i + CACHE // 2]
            own = set(part)
            seen |= {hash(t) for t in own}
            new = own.difference(self.at)
            if len(self.at) + len(new) > CACHE:
                self.at.clear()
                new = own
            for t in new:
                row = len(self.at)
                self.rows[row] = self.vectors[bucket(t.lower())] + self.vectors[bucket(shape(t))]
                self.at[t] = row
            x = self.rows[np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))]
            mean += x.sum(0, dtype=np.float64)
            square += np.einsum("ij,ij->j", x, x, dtype=np.float64)
        mean, square = mean / max(n, 1), square / max(n, 1)
        spread = np.sqrt(np.maximum(square - mean**2, 0))
        return np.concatenate((mean, spread, [np.log1p(n), len(seen) / max(n, 1), np.linalg.norm(mean)]))


def network(x: np.ndarray, y: np.ndarray, share: float, seed: int = 3) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
    """Layers, means, deviations and temperature; a fifth of the rows is held back for the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    mean, sd = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = (x - mean) / sd
    w = np.where(y > 0, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    layers = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    step = 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            w1, b1, w2, b2 = layers
            h = np.tanh(z[part] @ w1 + b1)
            q = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -40, 40)))
            g = w[part] * (q - y[part]) / len(part)
            back = g[:, None] * w2 * (1 - h * h)
            step += 1
            for a, grad, mm, vv in zip(layers, (z[part].T @ back + L2 * w1, back.sum(0), h.T @ g + L2 * w2, np.array([g.sum()])), m, v):
                mm += 0.1 * (grad - mm)
                vv += 0.01 * (grad**2 - vv)
                a -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    w1, b1, w2, b2 = layers
    logits = np.tanh(z[held] @ w1 + b1) @ w2 + b2[0]
    candidates = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
    losses = [(w[held] * np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t)).sum() for t in candidates]
    return layers, mean, sd, float(candidates[int(np.argmin(losses))]) if len(held) else 1.0


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits to rows of labels(doc_id, quality) whose documents are in docs, TRAIN_DOCS of each label at most.

    Null ids and labels are left out; of several labels of an id the larger counts, and of several rows of an id the text that comes first.
    Null texts are empty ones. Without rows the model gives every text 0.5.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id")
    tmp = Scratch()
    known = tmp(known, "labelled")
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    chosen = known.where("_y = 0").orderBy(order, "_id").limit(TRAIN_DOCS).unionByName(known.where("_y = 1").orderBy(order, "_id").limit(TRAIN_DOCS))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "_y").agg(F.min(F.col("text").cast("string")).alias("text"))
    rows = tmp(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id"), "sample")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        names = ["bucket", *(f"d{i}" for i in range(DIMS))]

        def summed(held: list[list[int]]) -> pa.RecordBatch:
            ids = np.array([x for h in held for x in h], np.int64)
            total = context_sums(ids, np.repeat(np.arange(len(held)), [len(h) for h in held]), index)
            some = np.nonzero(total.any(1))[0]
            return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(DIMS))], names)

        held, size = [], 0
        for b in batches:
            for text in b.column(2):
                held.append([x for t in (text.as_py() or "").split() for x in (bucket(t.lower()), bucket(shape(t)))])
                size += len(held[-1])
                if size >= CONTEXT:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    # One row for each bucket, whatever the number of tasks.
    parts = rows.mapInArrow(sums, "bucket long, " + ", ".join(f"d{i} double" for i in range(DIMS)))
    got = parts.groupBy("bucket").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIMS))).toArrow()
    total = np.zeros((BUCKETS, DIMS))
    if len(got):
        total[got.column("bucket").to_numpy()] = np.stack([got.column(f"d{i}").to_numpy() for i in range(DIMS)], 1)
    vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shared.value)
        for b in batches:
            x = [pooler.features(t.as_py()).tolist() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sorted(rows.mapInArrow(pooled, "doc_id long, y int, x array<double>").collect(), key=lambda r: r.doc_id)
    tmp.drop()
    if not got:
        size = 2 * DIMS + 3
        return Model(vectors, np.zeros(size), np.ones(size), [np.zeros((size, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 1.0)
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    layers, mean, sd, temperature = network(x, y, n.get(1, 0) / max(1, sum(n.values())))
    return Model(vectors, mean, sd, layers, temperature)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text).

    A null text is scored as an empty one; rows with a null doc_id and repeated rows stay; other columns are
    ignored. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(shared.value.vectors)
        for b in batches:
            x = np.array([pooler.features(t.as_py()) for t in b.column(1)]).reshape(b.num_rows, 2 * DIMS + 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.probabilities(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = trained(docs.where(~held_out), table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
