"""Text quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1; everything else is unlabelled web text, of which some part is good as well.
No negative label is read. With the class prior ``p`` the risk is p R+(positives) + max(0, R-(unlabelled) - p R-(positives)) under
the logistic loss, whose second term would otherwise sink below zero as the learner learns the positives by heart; where it
does, the step goes uphill on that term alone (Kiryo et al., 2017). The prior is estimated first: a learner tells positives from
unlabelled rows, and on rows that it has not seen the smallest ratio of the shares above a threshold bounds the part of
positives (best bin estimation, Garg et al., 2021).

Features of a whole text describe its form: the frequencies of word shapes (letters by ASCII case, digits, symbols) and of their
ends, hashed, and bins of ratios (distinct words, repeated lines, symbols, capitals, word length). Labels, language, source and
ids are never features.

The sample to learn from is bounded: at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled rows, those with the
smallest hashes of their ids, both outside the held-out fold. Their features stand in one task: 12 bytes each, at most
``2 ** BITS + 6`` a row by construction, some 60 in web text (24,576 rows of 60 are 18 MB). Everything is scored.

Null and empty texts have only the bins of an empty text. Labels of unknown documents, null labels and null doc_ids teach
nothing; of repeated labels the largest counts. Without a positive, or without unlabelled rows, every score is one half. Rows
that share a doc_id are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import Lookup, id_and_bytes, per_task, read

BITS = 12
MAX_POSITIVE = 8_192
MAX_UNLABELLED = 16_384
FOLDS, HELD_OUT = 4, 2
LEAST = 0.7
STEPS = 300
# ASCII capitals, digits and all other letters are made equal; all else stands for itself.
SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))
RUN = re.compile(rb"([Aa0])\1+")
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>!~^=+_@\\{}[]"
BIN_EDGES = {
    "distinct": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9), "lines": (0.01, 0.1, 0.3, 0.6), "symbols": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "capitals": (0.01, 0.03, 0.08, 0.2, 0.5, 0.8), "length": (2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 12.0), "words": (1, 5, 20, 50, 200, 1000, 5000),
}


def shape_slots(shape: bytes) -> tuple[int, int]:
    """Feature numbers of a word's shape and of its last two characters."""
    return tuple(xxhash.xxh32_intdigest(part) >> (32 - BITS) for part in (b"w" + shape[:12], b"e" + shape[-2:]))


def features(body: bytes, shapes: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text: root frequencies of its shapes, and one bin of each ratio."""
    words = body.split()
    total, distinct = len(words), len(set(words))
    seen: Counter = Counter()
    # Shapes are made for the whole text at once; a text has few different ones.
    for shape, n in Counter(RUN.sub(rb"\1", body.translate(SHAPES)).split()).items():
        for slot in shapes[shape]:
            seen[slot] += n
    letters = max(1, len(body))
    capitals, symbols = (len(body) - len(body.translate(None, some)) for some in (CAPITALS, SYMBOLS))
    lines = [line for line in body.split(b"\n") if line.strip()]
    ratios = {
        "distinct": distinct / max(1, total), "lines": 1 - len(set(lines)) / max(1, len(lines)), "symbols": symbols / letters,
        "capitals": capitals / letters, "length": letters / max(1, total), "words": total,
    }
    slots = list(seen)
    values = [math.sqrt(n / (2 * total)) for n in seen.values()]
    for at, (name, edges) in enumerate(BIN_EDGES.items()):
        slots.append((1 << BITS) + 16 * at + bisect_right(edges, ratios[name]))
        values.append(0.5)
    return np.array(slots, dtype=np.int32), np.array(values, dtype=np.float32)


WIDTH = (1 << BITS) + 16 * len(BIN_EDGES)


@dataclass
class Rows:
    """Sparse rows: the slots and values of all, and the row of each."""

    slot: np.ndarray
    value: np.ndarray
    row: np.ndarray
    count: int

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = [len(slots) for slots, _ in parts]
        empty = np.zeros(0)
        return cls(
            np.concatenate([s for s, _ in parts] or [empty]).astype(np.int64), np.concatenate([v for _, v in parts] or [empty]).astype(float),
            np.repeat(np.arange(len(parts)), sizes), len(parts),
        )

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights[self.slot] * self.value, self.count) + bias

    def back(self, slopes: np.ndarray) -> np.ndarray:
        """The gradient in the weights from that in the margins."""
        return np.bincount(self.slot, slopes[self.row] * self.value, WIDTH)


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def risk_parts(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the unbiased risk: of positives as such, and of what is left of the unlabelled as negatives."""
    as_negative = np.logaddexp(0, positive).mean()
    return prior * np.logaddexp(0, -positive).mean(), np.logaddexp(0, unlabelled).mean() - prior * as_negative


def direction(positive: Rows, unlabelled: Rows, at: np.ndarray, prior: float) -> np.ndarray:
    """Where to step away from: the gradient of the risk, or, where its second term is below zero, of that term's negative."""
    p, u = positive.margins(at[:-1], at[-1]), unlabelled.margins(at[:-1], at[-1])
    slope_p, slope_u = prior * sigmoid(p) / positive.count, sigmoid(u) / unlabelled.count
    if risk_parts(p, u, prior)[1] >= 0:
        slopes = ((positive, np.full(positive.count, -prior / positive.count)), (unlabelled, slope_u))
    else:
        slopes = ((positive, slope_p), (unlabelled, -slope_u))
    return np.append(sum(rows.back(slope) for rows, slope in slopes), sum(slope.sum() for _, slope in slopes))


def learn(positive: Rows, unlabelled: Rows, prior: float, steps: int = STEPS, rate: float = 0.2, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by steps of adaptive moments over all rows."""
    at, first, second = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for step in range(1, steps + 1):
        gradient = direction(positive, unlabelled, at, prior)
        gradient[:-1] += l2 * at[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient * gradient
        at -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) / math.sqrt(1 + step / 30)
    return at[:-1], float(at[-1])


def prior_bound(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The part of positives among the unlabelled, from scores of rows of both kinds that taught nothing.

    At the threshold where the ratio of the shares above it, plus what chance may add, is least, the ratio itself is the
    estimate: above it the unlabelled are almost only positives.
    """
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    chance = math.sqrt(math.log(4 / doubt) / (2 * len(unlabelled))) + math.sqrt(math.log(4 / doubt) / (2 * len(positive)))
    least = int(np.argmin((above_u + chance) / above_p))
    return float(np.clip(above_u[least] / above_p[least], 0.01, 0.99))


def estimated_prior(positive: list, unlabelled: list) -> float:
    """Learns from the even rows of each kind and counts on the odd ones, and the other way round; the mean of both."""
    found = []
    for turn in (0, 1):
        p, u = Rows.of(positive[turn::2]), Rows.of(unlabelled[turn::2])
        weights, bias = learn(p, u, 0.5, STEPS // 3)
        seen = [Rows.of(part[1 - turn :: 2]).margins(weights, bias) for part in (positive, unlabelled)]
        found.append(prior_bound(*seen))
    return sum(found) / 2


@dataclass
class Model:
    """Sparse weights, the bias and the prior that they were learnt with."""

    at: np.ndarray
    value: np.ndarray
    bias: float
    prior: float

    def dense(self) -> np.ndarray:
        full = np.zeros(WIDTH)
        full[self.at] = self.value
        return full


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` keys, those with the smallest hashes: the choice does not depend on layout."""
    return rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(most)


def fit(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Learns from trusted positives and unlabelled rows outside the held-out fold."""
    usable = F.col("key").isNotNull() & ~held_out(F.col("key"))
    trusted = labels.where("quality > 0").select(F.col("doc_id").cast("long").alias("key")).where(usable)
    web = docs.select(F.col(doc_id).cast("long").alias("key")).where(usable)
    # Both bounded, hence the broadcast. A positive may be drawn as unlabelled text too: that is the population's share.
    chosen = first_by_hash(trusted, max_positive).withColumn("kind", F.lit(1)).union(first_by_hash(web, max_unlabelled).withColumn("kind", F.lit(0)))
    rows = id_and_bytes(docs, doc_id, text).join(F.broadcast(chosen), F.col("doc_id") == F.col("key"))

    def featurise():
        shapes = Lookup(shape_slots)

        def work(ids, bodies, kinds):
            found = [features(body, shapes) for body in bodies]
            return [ids, kinds, [s.tobytes() for s, _ in found], [v.tobytes() for _, v in found]]

        return work

    dealt = per_task(rows.select("doc_id", "body", "kind"), "doc_id long, kind int, slots binary, vals binary", featurise)

    def learn_all(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("slots", "ascending"), ("vals", "ascending")])
        parts = [
            (np.frombuffer(s.as_buffer(), dtype=np.int32), np.frombuffer(v.as_buffer(), dtype=np.float32))
            for s, v in zip(table["slots"], table["vals"], strict=True)
        ]
        kinds = table["kind"].to_pylist()
        positive, unlabelled = ([part for part, kind in zip(parts, kinds, strict=True) if kind == wanted] for wanted in (1, 0))
        if len(positive) < 2 or len(unlabelled) < 2:
            return pa.table({"bias": [0.0], "prior": [0.5], "at": [b""], "value": [b""]})
        prior = estimated_prior(positive, unlabelled)
        weights, bias = learn(Rows.of(positive), Rows.of(unlabelled), prior)
        kept = np.flatnonzero(weights).astype(np.int32)
        return pa.table({"bias": [bias], "prior": [prior], "at": [kept.tobytes()], "value": [weights[kept].tobytes()]})

    schema = "bias double, prior double, at binary, value binary"
    found = dealt.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(learn_all, schema).collect()  # one row, or none
    if not found:
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0, 0.5)
    return Model(np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["value"]), found[0]["bias"], found[0]["prior"])


def scored(docs: DataFrame, model: Model, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, shapes, bias = shared.value.dense(), Lookup(shape_slots), shared.value.bias

        def score(body):
            slots, values = features(body, shapes)
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(weights[slots] @ values)))))

        return lambda ids, bodies: [ids, [score(body) for body in bodies]]

    rows = per_task(id_and_bytes(docs, doc_id, text), "doc_id long, score double", start)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read(spark, sf_dir, "labels")))
