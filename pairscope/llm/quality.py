"""Operator 5, quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

The vectors are learned by numpy stochastic gradient descent on a bounded sample of labelled documents
(``sample`` rows, by the smallest hash of ``doc_id``). A trained model is linear in the averaged vectors, so scoring
needs one number per bucket: a fixed table of ``BUCKETS`` floats goes to the tasks, whatever the corpus.

Defined cases: a null or empty text has the always present end-of-text feature only and gets a score from it; repeated
rows are scored alike, each in a row of its own; several labels of one document count as their minimum; rows without a
``doc_id`` or label are never learned from; with no usable label (or one class only) every score follows from that:
0.5 with none. Other columns, also ones named like results, are neither read nor needed, and ``keep_good`` keeps them. A very
long text is a chunk for itself, its average goes over all its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.store import chunks, documents, numbered

BUCKETS = 1 << 18
END_OF_TEXT = 0  # bucket of the feature that every document has
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_SHIFT = np.uint64(64 - 18)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def features(data: np.ndarray, offsets: np.ndarray):
    """Yields (bucket, mask or places, starts of the texts) per kind of feature over a chunk of UTF-8 texts.

    Characters are code points, A to Z in lower case. A space stands before every text and after the last, so n-grams
    see where words begin and end; inside an n-gram there is none. A feature belongs to the text in whose span of the
    padded characters it starts.
    """
    n = len(offsets) - 1
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # in characters
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    padded = np.insert(points, begins[:-1], 32)
    padded = np.concatenate([padded, np.full(6, 32, padded.dtype)])
    starts = begins[:-1] + np.arange(n)
    size = int(begins[-1]) + n
    space = (padded == 32) | ((padded >= 9) & (padded <= 13))
    spaces = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    code = padded.astype(np.uint64) + np.uint64(1)
    gram = code[: size + 1].copy()
    for k in range(1, max(GRAMS)):
        gram = gram * _BASE + code[k : k + size + 1]
        if k + 1 in GRAMS:
            inner = spaces[k : k + size] == spaces[1 : size + 1]
            yield ((gram[:size] * _MIX) >> _SHIFT).astype(np.int32), inner, starts
    power = _powers(_BASE, size + 1)
    whole = np.concatenate([[np.uint64(0)], np.cumsum(code[:size] * power[:size], dtype=np.uint64)])
    first = np.flatnonzero(~space[1 : size + 1] & space[:size]) + 1
    last = np.flatnonzero(~space[:size] & space[1 : size + 1]) + 1
    first = first[first < size]
    word = (whole[last] - whole[first]) * _powers(_INVERSE, size + 1)[first]
    yield ((word * _MIX) >> _SHIFT).astype(np.int32), first, starts


def _bags(batches):
    """Of each document, its distinct buckets and their counts."""
    for batch in batches:
        ids, counts = [], []
        for _, _, data, offsets in chunks(batch.column("text")):
            parts = [[] for _ in range(len(offsets) - 1)]
            for bucket, where, starts in features(data, offsets):
                if where.dtype == bool:
                    at = np.flatnonzero(where)
                    bucket = bucket[at]
                else:
                    at = where
                for d, (a, b) in enumerate(zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(at, np.append(starts, 1 << 60))))):
                    parts[d].append(bucket[a:b])
            for p in parts:
                i, c = np.unique(np.concatenate([*p, np.full(1, END_OF_TEXT, np.int32)]), return_counts=True)
                ids.append(i.astype(np.int32).tobytes())
                counts.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "label", "ids", "counts"])


@dataclass(frozen=True)
class Model:
    """vectors: of each bucket; output: of each class."""

    vectors: np.ndarray
    output: np.ndarray

    def table(self) -> np.ndarray:
        """What a feature adds to the log odds of label 1, before averaging."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 1) -> Model:
    """Plain stochastic gradient descent, a document a step, with a falling rate. Only buckets that occur are held."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    output = np.zeros((2, dim), np.float32)
    bags = [(label, ids, (counts / counts.sum())[:, None]) for label, ids, counts in bags]
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            label, ids, share = bags[k]
            lr = rate * (1 - step / steps)
            mine = vectors[ids]
            hidden = (mine * share).sum(0)
            odds = output @ hidden
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= lr * np.outer(p, hidden)
            # shares make the steps of single vectors tiny; scaled by the number of features they move as those of words do
            vectors[ids] = mine - (lr * min(len(ids), 64)) * share * back
            step += 1
    return Model(vectors, output)


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, **how) -> Model:
    """Learns from at most ``sample`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    known = (
        labels.select("doc_id", F.col("quality").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` rows
    bags = texts.mapInArrow(_bags, "doc_id long, label int, ids binary, counts binary")
    # of rows with one doc_id the least, before anything goes to the driver
    least = bags.groupBy("doc_id").agg(F.min(F.struct("ids", "counts", "label")).alias("b")).select("doc_id", "b.*")
    rows = least.toPandas().sort_values("doc_id")  # at most ``sample``
    return fit([(int(r.label), np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.float32)) for r in rows.itertuples()], **how)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, column: str = "score", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.table())  # BUCKETS floats
    names = docs.columns

    def run(batches):
        table = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for lo, hi, data, offsets in chunks(batch.column(names.index(text)), 1 << 20):
                total = np.full(hi - lo, float(table[END_OF_TEXT]))
                count = np.ones(hi - lo)
                for bucket, where, starts in features(data, offsets):
                    if where.dtype == bool:
                        total += np.add.reduceat(np.where(where, table[bucket], np.float32(0)), starts, dtype=np.float64)
                        count += np.add.reduceat(where, starts, dtype=np.int64)
                    else:
                        edges = np.searchsorted(where, np.append(starts, 1 << 60))
                        sums = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
                        total += sums[edges[1:]] - sums[edges[:-1]]
                        count += np.diff(edges)
                out[lo:hi] = 1 / (1 + np.exp(-total / count))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, column])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(column)).schema)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    scored = score(docs.select("doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))), train(docs, labels, **how))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns they have."""
    own, names = numbered(docs)
    columns = own.columns
    scored = score(own, train(docs, labels, **how), "score", columns[names.index("text")])
    return scored.where(F.col("score") >= THRESHOLD).select(*columns).toDF(*names)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
