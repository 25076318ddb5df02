"""Quality rules whose failures are pooled by host.

Each document is measured once; rule failures are summed by host (``source``), a combining aggregate. Per rule, the host
rates give an empirical beta prior by moments: its mean, and what is left of the spread of the rates when the chance of drawing so
few documents is taken out. Each host's rate is shrunk towards it, (failures + a) / (documents + a + b), so that a host of a
few documents needs more than their failures to stand out. A host is rejected when a shrunk rate, less ``DOUBT`` deviations of its
posterior, lies more than ``SPREADS`` spreads of the prior above its mean: it is surely worse than hosts of this corpus are. Where
hosts differ by chance only, none is rejected. Documents of other hosts are kept unless a base rule fails.

Null and empty texts have no words and fail. Rows without a host form one group. Rows that share a doc_id are each judged
and counted. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import per_task, read
from mapweave.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
SPREADS = 2.5
DOUBT = 2.0
SURE = 1e9  # weight of the prior where hosts do not differ


def rules() -> dict[str, Column]:
    """Failure conditions over the measures. The first two are the base rules."""
    return {
        "few_words": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], dtype=np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # keeps the product below within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, group, size = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = size[group] > 1
    inside = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def measure(body: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text."""
    words = body.split()
    spaces = len(body) - len(body.translate(None, SPACES))
    lines = [line for line in body.split(b"\n") if line.strip()]
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    return len(words), len(body.decode()) - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )

    def start():
        return lambda ids, hosts, bodies: [ids, hosts, *(list(map(list, zip(*map(measure, bodies), strict=True))) or [[]] * 6)]

    names = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    return per_task(rows, f"doc_id long, host string, {names}", start)


def host_rates(rows: DataFrame) -> DataFrame:
    """host, documents and failures of each rule."""
    failures = [F.sum(failed.cast("long")).alias(name) for name, failed in rules().items()]
    return rows.groupBy("host").agg(F.count("*").alias("documents"), *failures)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(mean, weight) of each rule's prior, a beta distribution with a = mean * weight and b = (1 - mean) * weight.

    Hosts of one document tell the mean but nothing of the spread. The expected square of a rate's distance from the mean is
    V (1 - 1 / n) + mean (1 - mean) / n for a host of n documents, which gives the spread V of the hosts themselves.
    """
    several = F.col("documents") > 1
    parts = [F.sum("documents").alias("documents"), F.avg(F.when(several, 1 / F.col("documents"))).alias("chance")]
    for name in rules():
        rate = F.when(several, F.col(name) / F.col("documents"))
        parts += [F.sum(name).alias(name), F.avg(rate).alias(f"{name}_mean"), F.var_samp(rate).alias(f"{name}_spread")]
    row = hosts.agg(*parts).first()
    priors = {}
    for name in rules():
        if row[f"{name}_spread"] is None:  # less than two hosts tell
            priors[name] = ((row[name] or 0) / max(1, row["documents"] or 0), SURE)
            continue
        mean, chance = row[f"{name}_mean"], row["chance"]
        most = mean * (1 - mean)
        spread = max(0.0, row[f"{name}_spread"] - most * chance) / (1 - chance)
        priors[name] = (mean, min(SURE, max(1e-3, most / spread - 1)) if spread > 0 else SURE)
    return priors


def host_verdicts(rows: DataFrame, spreads: float = SPREADS, doubt: float = DOUBT) -> DataFrame:
    """host, documents, shrunk rate of each rule, rejected."""
    hosts = host_rates(rows)
    shrunk, worse = [], F.lit(False)
    for name, (mean, weight) in beta_priors(hosts).items():
        rate = (F.col(name) + mean * weight) / (F.col("documents") + weight)
        shrunk.append(rate.alias(name))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("documents") + weight + 1))
        limit = mean + spreads * (mean * (1 - mean) / (weight + 1)) ** 0.5
        worse = worse | (rate - doubt * deviation > limit)
    return hosts.select("host", "documents", *shrunk, worse.alias("rejected"))


def quality_verdicts(
    docs: DataFrame, spreads: float = SPREADS, doubt: float = DOUBT, doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """doc_id, the measures, base_failed, host_rejected and kept of every row."""
    rows = cut_lineage(measured(docs, doc_id, text, host))
    bad = host_verdicts(rows, spreads, doubt).where("rejected").select(F.col("host").alias("_bad_host"), F.lit(True).alias("_bad"))
    failed = list(rules().values())
    base = failed[0] | failed[1]
    return (
        rows.join(bad, F.col("host").eqNullSafe(F.col("_bad_host")), "left")
        .withColumn("base_failed", base).withColumn("host_rejected", F.coalesce("_bad", F.lit(False)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected",
            (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
        )
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"))
