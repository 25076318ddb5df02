"""Fill-in-middle transformation of whole texts by a counted-quantifier regex, in column functions alone.

``regexp_count`` gives a text's number of units (lines). Two cut points, drawn from a digest of the document's id, make one
pattern per row: possessive groups of exactly ``a`` and ``b - a`` units and the rest. One match captures prefix, middle and
suffix, and its replacement is the output with the markers in place. Possessive counts are matched by a loop without
backtracking, so a text of any number of lines needs constant stack.

Order ``psm`` is prefix, suffix, middle behind their markers; ``spm`` is suffix, prefix, middle. A null or empty text, one
that holds a marker, or one that the rate leaves out stays as it is (``plain``, null lengths). No marker can arise where parts
meet, as each begins with the one ``<`` that it holds, so the original is rebuilt from output and form by one match too.

A null doc_id draws as an empty one. Rows that share a doc_id are each transformed, with the same draws; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import read

UNIT = r"(?:[^\n]*+\n|[^\n]++)"  # a line with its end, or a last line without one
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
ORDERS = {  # how a match of the parts is written, and how an output is matched to give them back
    "psm": (f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
    "spm": (f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2", rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1"),
}


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long") for at in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of every row; ``rate`` and ``spm`` in percent."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    one, two, chance, order = draws(F.col("doc_id"), seed)
    cuts = [F.pmod(draw, F.col("n") + 1) for draw in (one, two)]
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("body", F.lit(marker))
    plain = (F.col("body") == "") | marked | (F.pmod(chance, F.lit(100)) >= rate)
    rows = rows.withColumn("n", F.regexp_count("body", F.lit(UNIT)).cast("long")).withColumn(
        "form", F.when(plain, "plain").when(F.pmod(order, F.lit(100)) < spm, "spm").otherwise("psm")
    )
    first, second = F.least(*cuts), F.greatest(*cuts)
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\z", first, second - first)
    written = F.regexp_replace("body", pattern, F.when(F.col("form") == "psm", ORDERS["psm"][0]).otherwise(ORDERS["spm"][0]))
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("body")).otherwise(written))
    # The markers are where the parts begin: their places give the lengths.
    at = {marker: F.instr("output", marker) for marker in (PREFIX, SUFFIX, MIDDLE)}
    ends = F.when(F.col("form") == "psm", at[SUFFIX]).otherwise(at[MIDDLE])
    split = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form",
        F.when(split, ends - at[PREFIX] - len(PREFIX)).cast("long").alias("prefix_chars"),
        F.when(split, F.length("output") - at[MIDDLE] - len(MIDDLE) + 1).cast("long").alias("middle_chars"), "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The original text from an output and its form."""
    back = {name: F.regexp_replace(output, pattern, parts) for name, (_, pattern, parts) in ORDERS.items()}
    return F.when(form == "plain", output).when(form == "psm", back["psm"]).otherwise(back["spm"])


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(c.cast("binary"), 256).alias(name) for name, c in digest.items())
    )


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, string_split(body, chr(10)) AS parts,
 CASE WHEN body = '' THEN 0 ELSE len(string_split(body, chr(10))) - CAST(ends_with(body, chr(10)) AS INT) END AS n,
 [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS draw FROM d),
c AS (SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b,
 CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') THEN 'plain'
  WHEN draw[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
e AS (SELECT *, array_to_string(parts[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(parts) THEN chr(10) ELSE '' END AS prefix,
 array_to_string(parts[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(parts) THEN chr(10) ELSE '' END AS upto FROM c),
f AS (SELECT *, substr(upto, length(prefix) + 1) AS middle, substr(body, length(upto) + 1) AS suffix FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(CASE WHEN form = 'plain' THEN body ELSE prefix || middle || suffix END) AS restored_sha256
FROM f
"""
