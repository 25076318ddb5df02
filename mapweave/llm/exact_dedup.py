"""Exact duplicates by progressive refinement, in DataFrame operations alone.

One scan turns each text into a narrow row: size (code points after white space is normalised), head (hash of the first
``HEAD`` characters and the size) and the full hash. Rows are then grouped by size; those that share it by head; those that
share that by the full hash. A row leaves as soon as it is alone, so the full hash is compared only in groups that
survive, and the text itself is never shuffled. Groups are counts and minima that combine before the shuffle; the joins
carry narrow rows, which AQE splits where one group holds a large part of the table.

Null and empty texts are one value, the empty text. Rows that share a doc_id are each reported. A null doc_id never is a
keep_id while its group has another. ``one_of_each`` keeps one row even of rows that agree in both. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import read, unused
from mapweave.session import cut_lineage

HEAD = 64
SPACES = r"[\x20\x09-\x0D]+"


def narrow_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, head, full): what the refinement needs of each whole text, without the text."""
    even = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ").alias("even")
    )
    return even.select(
        "doc_id", F.length("even").alias("size"), F.xxhash64(F.length("even"), F.substring("even", 1, HEAD)).alias("head"),
        F.unhex(F.sha2(F.col("even").cast("binary"), 256)).alias("full"),
    )


def shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs in more than one row."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), key, "left_semi")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id (smallest doc_id of the equal texts), group_size, kept, text_sha256 (of the normalised text)."""
    rows = cut_lineage(narrow_rows(docs, doc_id, text))
    # Each level has one key of its own: none reuses the layout of the level before, so AQE may split its large partitions.
    groups = (
        shared(shared(rows, "size"), "head").groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    keep = F.coalesce("keep_id", "doc_id")
    return rows.join(groups, "full", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("full")).alias("text_sha256"),
    )


class Copies:
    """``docs`` without later copies, and which rows several kept ones agree with.

    A row is judged by its id and its text: a null or shared doc_id says nothing about its other texts. The columns that carry
    both have names that ``docs`` does not use.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        judged = exact_duplicates(docs, doc_id, text).groupBy("doc_id", F.unhex("text_sha256").alias("full")).agg(
            F.first("kept").alias("kept"), F.count("*").alias("n")
        )
        self.key = unused(docs, "row_id", "row_full")
        of_id, of_full, kept = unused(docs, "copied_id", "copied_full", "copied_kept")
        judged = cut_lineage(judged.where("NOT kept OR n > 1").select(F.col("doc_id").alias(of_id), F.col("full").alias(of_full), F.col("kept").alias(kept)))
        even = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
        row_id, row_full = self.key
        rows = docs.withColumn(row_id, F.col(doc_id).cast("long")).withColumn(row_full, F.unhex(F.sha2(even.cast("binary"), 256)))
        self.same = F.col(row_id).eqNullSafe(F.col(of_id)) & (F.col(row_full) == F.col(of_full))
        self.rows, self.tied = rows.join(judged.where(~F.col(kept)), self.same, "left_anti"), judged.where(kept)


def first_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose equal text has a smaller doc_id. Equal ids and texts all stay."""
    found = Copies(docs, doc_id, text)
    return found.rows.drop(*found.key)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of ``docs``, all columns, of each group of equal texts: one with the smallest doc_id, null ids last."""
    found = Copies(docs, doc_id, text)
    rows = found.rows
    if not found.tied.isEmpty():
        one = rows.join(found.tied, found.same, "left_semi").dropDuplicates(found.key)
        rows = rows.join(found.tied, found.same, "left_anti").union(one)
    return rows.drop(*found.key)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH e AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS even FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
 sha256(even) AS text_sha256
FROM e WINDOW w AS (PARTITION BY even)
"""
