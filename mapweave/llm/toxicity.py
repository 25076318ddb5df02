"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, its pairs of neighbours and its pairs with one word between them.
Spark turns at most ``MAX_ROWS`` labelled rows (those with the smallest hash of their id, so the choice does not depend on
layout) into feature slots, and one learner takes them in a fixed order, ``EPOCHS`` times: FTRL-proximal is sequential. Each
coordinate has its own rate; the features of the sample stand in that task, 4 bytes each (79 MB at web lengths); L1 leaves few weights, at most ``2 ** BITS`` by construction, which are broadcast. Scoring is
one pass over all whole texts.

Null and empty texts get the score of the bias; labels of unknown documents, null labels and null doc_ids teach nothing; of
repeated labels the largest counts. Without any label all scores stay below one half. Rows that share a doc_id are scored
each; an empty table gives an empty result; extra columns are ignored, or passed through by ``clean_rows``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import Lookup, id_and_bytes, per_task, read

BITS = 20
MAX_ROWS = 16_384
EPOCHS = 5
FOLDS = 5
EDGES = b".,;:!?\"'()[]{}*#$%&|<>~-_/\\"
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of the learner."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.strip(EDGES).decode(errors="replace").lower())


def word_hashes() -> Lookup:
    return Lookup(word_hash)


def slots(body: bytes, words: Lookup) -> np.ndarray:
    """Feature slots of a whole text, with repeats."""
    run = np.array([words[word] for word in body.split()], dtype=np.uint64)
    with np.errstate(over="ignore"):
        pairs = (run[:-1] * np.uint64(3) + (run[1:] ^ _ODD)) * _ODD
        skips = (run[:-2] * np.uint64(5) + (run[2:] ^ _ODD)) * _ODD
        return (np.concatenate([run * _ODD, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.uint32)


def train(features: list[np.ndarray], targets: list[int], bias: float, epochs: int, rates: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= rates.l1, 0.0, (np.sign(z[at]) * rates.l1 - z[at]) / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2))

    for _ in range(epochs):
        for at, target in zip(features, targets, strict=True):
            w = weights(at)
            error = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum()))))) - target
            z[at] += error - (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / rates.alpha * w
            n[at] += error * error
            bias -= 0.02 * error
    return weights(np.arange(1 << BITS)), bias


@dataclass
class Model:
    """Sparse weights: slots with their values, and the bias."""

    at: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << BITS, dtype=np.float32)
        full[self.at] = self.value
        return full


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, rates: Ftrl = Ftrl(),
    doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Learns from labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("key").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("key"))
    )
    # Bounded by max_rows, hence the broadcast.
    chosen = known.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(max_rows)
    rows = id_and_bytes(docs, doc_id, text).join(F.broadcast(chosen), F.col("doc_id") == F.col("key"))

    def featurise():
        words = word_hashes()
        return lambda ids, bodies, toxic: [ids, toxic, [np.unique(slots(b, words)).tobytes() for b in bodies]]

    dealt = per_task(rows.select("doc_id", "body", "toxic"), "doc_id long, toxic int, slots binary", featurise)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        targets = [int(t > 0) for t in table["toxic"].to_pylist()]
        order = np.random.default_rng(0).permutation(len(targets))
        features = [np.frombuffer(value.as_buffer(), dtype=np.uint32) for value in table["slots"]]
        positive = sum(targets)
        prior = math.log((positive + 0.5) / (len(targets) - positive + 1.5))
        weights, bias = train([features[i] for i in order], [targets[i] for i in order], prior, epochs, rates)
        kept = np.flatnonzero(weights).astype(np.uint32)
        return pa.table({
            "bias": pa.array([bias], pa.float64()), "at": pa.array([kept.tobytes()], pa.binary()),
            "value": pa.array([weights[kept].astype(np.float32).tobytes()], pa.binary()),
        })

    found = dealt.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(learn, "bias double, at binary, value binary").collect()  # one row, or none
    if not found:
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), math.log(1 / 3))
    return Model(np.frombuffer(found[0]["at"], np.uint32), np.frombuffer(found[0]["value"], np.float32), found[0]["bias"])


def scorer(model: Model):
    """A function from UTF-8 bytes to a probability."""
    weights, words = model.dense(), word_hashes()

    def score(body: bytes) -> float:
        at = slots(body, words)
        at = np.unique(at[weights[at] != 0])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, model.bias + float(weights[at].sum())))))

    return score


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = scorer(shared.value)
        return lambda ids, bodies: [ids, [score(body) for body in bodies]]

    rows = per_task(id_and_bytes(docs, doc_id, text), "doc_id long, score double", start)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the model does not predict to be toxic, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([score((body or "").encode()) < 0.5 for body in bodies], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels")))
