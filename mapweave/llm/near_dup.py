"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on full shingle sets.

Each text becomes its set of word shingles and a signature of ``POSITIONS`` b-bit minima. Equal sets are one class. Two sets at
the Jaccard threshold, ``PERCENT`` or another, differ in about 100 less that percent of the positions; the distance of
``reach`` lies so far above that at most ``MISSED`` of such pairs exceed it (``DISTANCE`` at ``PERCENT``). The signature is cut
into so many pieces (``CHUNKS`` at ``PERCENT``) that, by the pigeonhole principle, a pair within the distance has a piece with at
most one error; every position of a piece is left out in turn, so each pair within the distance meets in a bucket for certain.

Buckets emit no pairs. Classes that meet, directly or over others, form a group, mostly a family of copies; a group is compared
once, where its buckets, which hold much the same members, would compare it dozens of times. (A long chain of small buckets is
compared by bucket instead, whenever that is less work.) A group is dealt into blocks of bounded size, and each pair of blocks is
one task's work: signatures are compared, and pairs within the distance and of fitting sizes are confirmed on their full sets,
whose intersections all come from products of incidence matrices. A pair of blocks emits no links but which members they
join: at most one row a member. Their components are the result, so no link between different texts is lost, however large a
group is, and what leaves a task does not grow with the pairs in it.

Null and empty texts, and texts of white space, have no set and link with nothing. Texts with fewer words than a shingle have
one. Documents are rows: those that share a doc_id, or have none, are linked by their texts. A component without any doc_id
has a null component_id, and its rows count as kept. An empty table gives an empty result; extra columns are ignored, or
passed through by ``first_of_groups``, which keeps one row of each component whatever the ids are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import Lookup, per_task, read, unused
from mapweave.session import cut_lineage

SHINGLE = 5
POSITIONS = 64
BITS = 16
PERCENT = 85
MISSED = 1.5e-5
BLOCK = 2_048  # members of a block
BLOCK_SHINGLES = 1 << 20  # and shingles of all of them, about
CELLS = 1 << 22  # of an incidence matrix at a time
MAX_ROWS = 500_000  # narrow rows that are broadcast
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20_240_501).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def reach(percent: int) -> tuple[int, int]:
    """(distance, chunks): the least distance that at most ``MISSED`` of the pairs at the threshold exceed; one error a chunk."""
    differ = 1 - percent / 100
    within, distance = (1 - differ) ** POSITIONS, 0
    while 1 - within > MISSED:
        distance += 1
        within += math.comb(POSITIONS, distance) * differ**distance * (1 - differ) ** (POSITIONS - distance)
    return distance, distance // 2 + 1


DISTANCE, CHUNKS = reach(PERCENT)


def word_hashes() -> Lookup:
    return Lookup(xxhash.xxh64_intdigest)


def shingle_set(body: bytes, words: Lookup, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z are lower-cased."""
    run = np.array([words[word] for word in body.lower().split()], dtype=np.uint64)
    if not len(run):
        return run
    width = min(size, len(run))
    with np.errstate(over="ignore"):
        mixed = np.full(len(run) - width + 1, width, dtype=np.uint64)
        for at in range(width):
            mixed = (mixed ^ run[at : len(run) - width + 1 + at]) * _MUL
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``POSITIONS`` minima of ``BITS`` bits."""
    least = np.full(POSITIONS, ~np.uint64(0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2_048):  # bounds memory for long texts
            part = hashes[at : at + 2_048, None] * _SEEDS
            part ^= part >> np.uint64(32)
            np.minimum(least, (part * _MUL).min(axis=0), out=least)
        return ((least * _MUL) >> np.uint64(64 - BITS)).astype("<u2")


def chunk_keys(signatures: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """Bucket keys of each signature (rows): for each chunk and each of its positions, a hash of the others."""
    columns = []
    with np.errstate(over="ignore"):
        for number, part in enumerate(np.array_split(np.arange(signatures.shape[1]), chunks)):
            for left_out in part:
                key = np.full(len(signatures), number * 1_000 + int(left_out) + 1, dtype=np.uint64)
                for at in part[part != left_out]:
                    key = (key ^ signatures[:, at].astype(np.uint64)) * _MUL
                    key ^= key >> np.uint64(31)
                columns.append(key)
    return np.stack(columns, axis=1).view(np.int64)


def unpacked(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype="<u2").reshape(-1, POSITIONS)


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, body): the id and hash that tell rows apart, and the UTF-8 bytes of every whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.cast("binary").alias("body"))


def sets(docs: DataFrame, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (128-bit hash of the set; null without one), signature."""

    def start():
        words = word_hashes()

        def work(ids, keys, bodies):
            found = [shingle_set(body, words, size) for body in bodies]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            return [ids, keys, list(map(len, found)), names, [signature(s).tobytes() if len(s) else None for s in found]]

        return work

    schema = "doc_id long, text_key long, n_shingles long, set_id binary, signature binary"
    return per_task(rows_of(docs, doc_id, text), schema, start)


def set_classes(rows: DataFrame) -> DataFrame:
    """One row per set: node (its number), set_id, n_shingles, signature, and the id and text key of one of its rows."""
    found = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
    )
    return cut_lineage(found.withColumn("node", F.monotonically_increasing_id()))  # numbers are fixed once they are written


def bucket_rows(classes: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """key, node: the rows of each class in its buckets."""

    def start():
        def work(nodes, signatures):
            if not nodes:
                return [[], []]
            keys = chunk_keys(unpacked(signatures), chunks)
            return [keys.ravel(), np.repeat(np.array(nodes, dtype=np.int64), keys.shape[1])]

        return work

    return per_task(classes.select("node", "signature"), "key long, node long", start)


def meetings(classes: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """key, node, low (least node of the bucket) of the buckets with several members."""
    every = bucket_rows(classes, chunks)
    shared = every.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    return cut_lineage(every.join(shared, "key"))


def units(met: DataFrame) -> DataFrame:
    """by_bucket, unit, node: who is compared with whom. A group is a unit, or each of its buckets where those are less work."""
    groups = cut_lineage(components(met.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()))
    buckets = met.groupBy("key", "low").agg(F.count("*").alias("m")).groupBy("low").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
    by_bucket = buckets.join(groups.toDF("low", "comp"), "low").groupBy("comp").agg(F.sum("work").alias("work"))
    whole = groups.groupBy("comp").agg(F.count("*").alias("n"))
    chosen = cut_lineage(whole.join(by_bucket, "comp").select("comp", (F.col("work") < F.col("n") * F.col("n")).alias("by_bucket")))
    named = groups.join(chosen, "comp")
    small = met.join(named.where("by_bucket").select("node"), "node").select(F.lit(True).alias("by_bucket"), F.col("key").alias("unit"), "node")
    return named.where("NOT by_bucket").select("by_bucket", F.col("comp").alias("unit"), "node").union(small)


def node_sets(bodies: DataFrame, wanted: DataFrame, size: int = SHINGLE, most: int = MAX_ROWS) -> DataFrame:
    """node, hashes: the full set of each wanted class (node, doc_id, text_key). Texts that nobody wants are not shuffled while
    there are at most ``most`` wanted ones."""
    wanted = cut_lineage(wanted.select("node", F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text")))
    found = bodies.join(
        F.broadcast(wanted) if wanted.count() <= most else wanted, F.col("text_key").eqNullSafe(F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    )

    def start():
        words, seen = word_hashes(), set()

        def work(nodes, texts):
            fresh = [(node, text) for node, text in dict(zip(nodes, texts, strict=True)).items() if node not in seen]  # repeated rows give one set
            seen.update(node for node, _ in fresh)
            return [[node for node, _ in fresh], [shingle_set(text, words, size).tobytes() for _, text in fresh]]

        return work

    return per_task(found.select("node", "body"), "node long, hashes binary", start)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, as products of 0-1 matrices over what both have."""
    parts = [(np.concatenate(some), np.repeat(np.arange(len(some)), list(map(len, some)))) for some in (left, right)]
    shared = np.intersect1d(*(np.unique(values) for values, _ in parts), assume_unique=True)
    places = []
    for values, row in parts:
        at = np.searchsorted(shared, values)
        inside = at < len(shared)
        inside[inside] = shared[at[inside]] == values[inside]
        order = np.argsort(at[inside], kind="stable")
        places.append((at[inside][order], row[inside][order]))
    counts = np.zeros((len(left), len(right)), dtype=np.float32)  # exact below 2 ** 24 shingles a product
    totals = np.zeros((len(left), len(right)), dtype=np.int64)
    wide = min(1 << 23, max(64, cells // (len(left) + len(right))))
    for begin in range(0, len(shared), wide):
        sides = []
        for (at, row), some in zip(places, (left, right), strict=True):
            low, high = np.searchsorted(at, (begin, begin + wide))
            side = np.zeros((len(some), min(wide, len(shared) - begin)), dtype=np.float32)
            side[row[low:high], at[low:high] - begin] = 1
            sides.append(side)
        np.matmul(sides[0], sides[1].T, out=counts)
        totals += counts.astype(np.int64)
    return totals


def joined(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each member that a link touches with the least member it is joined with. ``link``: left by right."""
    rows, columns = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    link, names = link[rows][:, columns], np.unique(np.concatenate([left[rows], right[columns]]))
    one, two = np.searchsorted(names, left[rows]), np.searchsorted(names, right[columns])
    label = np.arange(len(names))
    while len(names):
        before = label.copy()
        np.minimum.at(label, two, np.where(link, label[one][:, None], len(names)).min(axis=0))
        np.minimum.at(label, one, np.where(link, label[two][None, :], len(names)).min(axis=1))
        if (label == before).all():
            break
    apart = np.flatnonzero(label != np.arange(len(names)))
    return names[label[apart]], names[apart]


def links_of_blocks(members: DataFrame, percent: int = PERCENT, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) that join the members linked in each unit: rows (by_bucket, unit, node, n_shingles, signature, hashes)."""
    distance, _ = reach(percent)
    key = ["by_bucket", "unit"]
    parts = members.groupBy(*key).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / shingles)).alias("parts"))
    rows = members.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # A member of part p takes part in the pairs of blocks (p, q) for all q, once each.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    rows = rows.select(*key, low, high, "node", "n_shingles", "part", "signature", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        node, size, part = (table[c].to_numpy() for c in ("node", "n_shingles", "part"))
        signs, low, high = unpacked(table["signature"].to_pylist()), table["low"][0].as_py(), table["high"][0].as_py()
        one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
        able = np.zeros((len(one), len(two)), dtype=bool)
        for at, i in enumerate(one):
            fits = 100 * np.minimum(size[two], size[i]) >= percent * np.maximum(size[two], size[i])
            if low == high:
                fits &= node[two] > node[i]
            others = np.flatnonzero(fits)
            able[at, others] = (signs[two[others]] != signs[i]).sum(axis=1) <= distance
        rows, columns = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
        if not len(rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        one, two, able = one[rows], two[columns], able[rows][:, columns]
        found = [[np.frombuffer(table["hashes"][int(i)].as_buffer(), dtype=np.uint64) for i in some] for some in (one, two)]
        common = common_counts(*found)
        link = able & (100 * common >= percent * (size[one][:, None] + size[two][None, :] - common))
        a, b = joined(link, node[one], node[two])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy(*key, "low", "high").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) over undirected links (a, b), by minima of neighbours and jumps along labels."""
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    ways = cut_lineage(links.select(both.alias("way")).select("way.a", "way.b").distinct())
    labels = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp"))
    labels = cut_lineage(labels)
    while True:
        offered = ways.join(labels.toDF("b", "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("offer"))
        lower = labels.join(offered, "node").select("node", F.col("comp").alias("was"), F.least("comp", "offer").alias("comp"))
        jumped = lower.join(labels.toDF("comp", "next"), "comp", "left").select("node", "was", F.least("comp", "next").alias("comp"))
        jumped = cut_lineage(jumped)
        changed = jumped.where("comp <> was").limit(1).count()
        labels = jumped.select("node", "comp")
        if not changed:
            return labels


def judged_rows(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, comp (number of the component; null without a set), component_id of every row."""
    rows = cut_lineage(sets(docs, size, doc_id, text))
    classes = set_classes(rows)
    compared = cut_lineage(units(meetings(classes, reach(percent)[1])))
    wanted = classes.join(compared.select("node").distinct(), "node", "left_semi")
    found = node_sets(rows_of(docs, doc_id, text), wanted, size)
    members = cut_lineage(compared.join(wanted.select("node", "n_shingles", "signature"), "node").join(found, "node"))
    comps = components(links_of_blocks(members, percent))
    named = classes.join(comps, "node", "left").select("set_id", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    named = named.join(least, "comp").select("set_id", "comp", "least_id")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return rows.select("doc_id", "text_key", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id", "text_key", "n_shingles", "comp", component.alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept of every row."""
    rows = judged_rows(docs, percent, size, doc_id, text)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_groups(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component: one with its smallest doc_id; of several such, by the text's hash.

    Rows without a set all stay.
    """
    rows = judged_rows(docs, percent, doc_id=doc_id, text=text).where("comp IS NOT NULL")
    rows = cut_lineage(rows.groupBy("comp", "component_id", "doc_id", "text_key").agg(F.count("*").alias("n")))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = rows.where(first).groupBy("comp").agg(F.min("text_key").alias("stays"))
    gone = ~first | (F.col("text_key") != F.col("stays"))
    verdicts = cut_lineage(rows.join(stays, "comp").where(gone | (F.col("n") > 1)).select("doc_id", "text_key", gone.alias("gone")))
    of_id, of_text, key, number, verdict = unused(docs, "of_id", "of_text", "key", "number", "gone")
    keyed = docs.withColumn(key, F.col(doc_id).cast("long")).withColumn(number, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = F.col(key).eqNullSafe(F.col(of_id)) & (F.col(number) == F.col(of_text))
    named = verdicts.toDF(of_id, of_text, verdict)
    kept = keyed.join(named.where(F.col(verdict)), same, "left_anti")
    repeated = named.where(~F.col(verdict))
    if not repeated.isEmpty():  # rows that agree in id and text
        kept = kept.join(repeated, same, "left_anti").union(kept.join(repeated, same, "left_semi").dropDuplicates([key, number]))
    return kept.drop(key, number)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
