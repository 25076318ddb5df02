"""What the training-data operators share: reading, Arrow batches with per-task state, lookup of encoded words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body): UTF-8 bytes of every whole text, null as empty. Further columns are left behind, whatever their names."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, made from these."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def per_task(df: DataFrame, schema: str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """``start()`` runs once per task and gives a function from the columns of a batch (lists) to the output columns (lists)."""
    fields = [part.split() for part in schema.split(", ")]
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            columns = work(*(column.to_pylist() for column in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields))


class Lookup(dict):
    """A bounded cache of what ``make`` gives. Long keys are not kept; a full cache drops its younger half, as what is
    frequent comes early."""

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.shrink()
            self[key] = value
        return value

    def shrink(self):
        for key in list(self)[self.limit // 2 :]:
            del self[key]
