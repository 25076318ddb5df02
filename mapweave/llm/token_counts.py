"""Token counts of whole texts by a two-tier lookup on the map side.

A text's count is the sum over its pre-tokens, here the runs between ASCII white space: the vocabulary drops white space, so
no token, normalisation or special string reaches across it, and each run can be encoded alone by the library itself.
Tier one is a broadcast table of the corpus's frequent runs and their lengths, at most ``TABLE`` entries. Tier two is a
bounded cache in each worker, filled by encoding the misses of a batch together. Runs of more than ``LONGEST`` bytes are in
neither: they are encoded where they stand. No run is shuffled but the heavy hitters
of each partition, ``PER_TASK`` at most, from which the table is made; the table changes the speed, never a count.

Nulls and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are each reported; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapweave.llm.common import id_and_bytes, per_task, read

TABLE = 65_536
PER_TASK = 8_192
CACHE = 500_000
LONGEST = 64  # bytes of a run that a table or cache may hold, so both are bounded in bytes
_MODELS: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    """The library's tokenizer, loaded once per worker, without truncation or padding."""
    if name not in _MODELS:
        model = Tokenizer.from_file(public_tokenizers.path(name))
        model.no_truncation()
        model.no_padding()
        _MODELS[name] = model
    return _MODELS[name]


def lengths(name: str, runs: list[bytes]) -> list[int]:
    model = tokenizer(name)
    return [len(e) for e in model.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)]


def heavy_runs(bodies: DataFrame, table: int = TABLE, per_task_runs: int = PER_TASK) -> DataFrame:
    """(run, n): the most frequent runs of all texts. Each task keeps a bounded summary; the sums are partial beyond it."""

    def start():
        def work(bodies_of_batch):
            seen = Counter()
            for body in bodies_of_batch:
                seen.update(run for run in body.split() if len(run) <= LONGEST)
                if len(seen) > 16 * per_task_runs:
                    seen = Counter(dict(seen.most_common(8 * per_task_runs)))
            best = [(run, n) for run, n in seen.most_common(per_task_runs) if n > 1]
            return [[run for run, _ in best], [n for _, n in best]]

        return work

    found = per_task(bodies.select("body"), "run binary, n long", start)
    return found.groupBy("run").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "run").limit(table)


def token_counts(
    docs: DataFrame, model: str = "word_bpe_49k.json", limit: int = 2048, table: int = TABLE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row."""
    bodies = id_and_bytes(docs, doc_id, text)
    runs = [bytes(row.run) for row in heavy_runs(bodies, table).collect()]  # at most ``table`` short rows
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(runs, lengths(model, runs), strict=True)))

    def start():
        first, cache = frequent.value, {}

        def work(ids, texts):
            split = [body.split() for body in texts]
            missed = {run for runs in split for run in runs if run not in first and run not in cache}
            if len(cache) + len(missed) > CACHE:
                # The younger half goes: what is frequent came early.
                for run in list(cache)[CACHE // 2 :]:
                    del cache[run]
                missed = {run for runs in split for run in runs if run not in first and run not in cache}
            missed, long = list(missed), {}
            for at in range(0, len(missed), 4096):
                part = missed[at : at + 4096]
                for run, n in zip(part, lengths(model, part), strict=True):
                    (cache if len(run) <= LONGEST else long)[run] = n
            counts = []
            for runs in split:
                known = [first.get(run) or cache.get(run) or long.get(run, 0) for run in runs]
                counts.append(sum(known))
            return [ids, [len(body) for body in texts], counts]

        return work

    return per_task(bodies, "doc_id long, n_bytes long, n_tokens long", start).withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
