"""URL verdicts by exact membership in a cascade of Bloom filters.

``Cascade`` encodes which keys of a known universe are listed. Level 0 holds the listed keys; every further level holds the
keys of the other kind that the level before lets through by mistake, until none is left. As the universe is complete (all
keys of the corpus), a walk down the levels answers exactly and no join is needed. Levels are built by Spark: each task
turns its keys into words of bits, which are or-ed by word; the driver receives at most ``MAX_BITS`` bits a level. A list
that would need more is answered by a shuffled join instead, with equal results.

Keys of rules are host suffixes with path prefixes; keys of listed hosts are whole hosts. Without a rule that fits, a page is
blocked when its host is listed: by default, a host with more pages under block rules than under allow rules.

A null url, or one without ``://``, has an empty host and path and no rule, and is allowed unless the empty host is listed.
Rows that share a page_id are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import per_task, read
from mapweave.session import cut_lineage

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
HASHES = 7
BITS_PER_KEY = 10
MAX_BITS = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each key's 128-bit hash."""
    wide = b"".join(xxhash.xxh3_128_digest(key.encode()) for key in keys)
    return tuple(np.frombuffer(wide, dtype=">u8").astype(np.uint64).reshape(-1, 2).T)


def positions(first: np.ndarray, second: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions of each key at one level: rows of ``HASHES``."""
    number = np.arange(1, HASHES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = first[:, None] + number * (second[:, None] | np.uint64(1)) + np.uint64(level + 1) * _STEP
        mixed ^= mixed >> np.uint64(29)
        mixed *= _STEP
    return (mixed >> np.uint64(20)) % np.uint64(bits)


@dataclass
class Cascade:
    levels: list[np.ndarray] = field(default_factory=list)  # words of 64 bits

    def passes(self, first: np.ndarray, second: np.ndarray, level: int) -> np.ndarray:
        words = self.levels[level]
        at = positions(first, second, level, 64 * len(words))
        return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)

    def contains(self, keys: list[str]) -> np.ndarray:
        """Membership of keys of the universe."""
        first, second = hashed(keys) if keys else (np.zeros(0, np.uint64),) * 2
        answer, open_rows = np.zeros(len(keys), dtype=bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            passing = self.passes(first[open_rows], second[open_rows], level)
            answer[open_rows[~passing]] = level % 2 == 1
            open_rows = open_rows[passing]
        answer[open_rows] = len(self.levels) % 2 == 1
        return answer


def level_words(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The bits of ``keys``: tasks make words, Spark joins them with or."""

    def start():
        def work(column):
            at = np.unique(positions(*hashed(column), level, bits)) if column else np.zeros(0, np.uint64)
            word, begins = np.unique(at >> np.uint64(6), return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begins) if len(at) else at
            return [word.astype(np.int64), values.view(np.int64)]

        return work

    words = np.zeros(bits // 64, dtype=np.uint64)
    rows = per_task(keys.select("key"), "word long, value long", start).groupBy("word").agg(F.bit_or("value").alias("value")).collect()
    for row in rows:
        words[row.word] = np.int64(row.value).astype(np.uint64)
    return words


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """From (key, listed) over the distinct keys of the corpus; None where the list needs more than ``max_bits``."""
    cascade, sides, level = Cascade(), {True: universe.where("listed"), False: universe.where("NOT listed")}, 0
    rest = sides[True]
    while (left := rest.count()) > 0:
        bits = max(64, -(-left * BITS_PER_KEY // 64) * 64)
        if bits > max_bits:
            return None
        cascade.levels.append(level_words(rest, level, bits))
        # Keys of the other side that all levels so far let through: only those that reached this one are asked.
        other, levels = sides[level % 2 == 1], list(cascade.levels)

        def start(levels=levels):
            asked = Cascade(levels)

            def work(column):
                first, second = hashed(column) if column else (np.zeros(0, np.uint64),) * 2
                on = np.ones(len(column), dtype=bool)
                for number in range(len(levels)):
                    on[on] = asked.passes(first[on], second[on], number)
                return [[key for key, through in zip(column, on, strict=True) if through]]

            return work

        rest = per_task(other.select("key"), "key string", start)
        level += 1
    return cascade


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url column."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_keys(host: str, path: str, reach: list[int], depths: list[int]) -> list[str]:
    """Keys under which a rule for this address may stand, longest first: host suffixes of as many labels as rules have, with
    path prefixes of known lengths. They are few, however long the host is."""
    labels = host.split(".")
    suffixes = [".".join(labels[len(labels) - depth :]) for depth in depths if depth <= len(labels)]
    return sorted((s + path[:n] for s in suffixes for n in reach if len(path) >= n), key=len, reverse=True)


def longest_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` (page_id, host, path) with the longest rule that fits, found by a cascade over all candidate keys."""
    reach, depths = sorted({len(path) for _, path, _ in rules}), sorted({host.count(".") + 1 for host, _, _ in rules})
    listed = {host + path for host, path, _ in rules}

    def candidates():
        def work(hosts, paths):
            keys = sorted({key for h, p in zip(hosts, paths, strict=True) for key in rule_keys(h, p, reach, depths)})
            return [keys, [key in listed for key in keys]]

        return work

    universe = cut_lineage(per_task(pages.select("host", "path"), "key string, listed boolean", candidates).distinct())
    cascade = build_cascade(universe)  # the list is the rules, far below any bound

    def start():
        def work(ids, hosts, paths):
            keys = [rule_keys(h, p, reach, depths) for h, p in zip(hosts, paths, strict=True)]
            inside = iter(cascade.contains([key for some in keys for key in some]).tolist())
            rules_found = []
            for some in keys:
                fits = [key for key in some if next(inside)]
                rules_found.append(fits[0] if fits else None)
            return [ids, hosts, paths, rules_found]

        return work

    return per_task(pages.select("page_id", "host", "path"), "page_id long, host string, path string, rule string", start)


def host_majority(judged: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(key, listed) of every host: listed where block rules fit more of its pages than allow rules."""
    blocks = [host + path for host, path, verdict in rules if verdict == "block"]
    sign = F.when(F.col("rule").isin(blocks), 1).when(F.col("rule").isNotNull(), -1).otherwise(0)
    return judged.groupBy(F.col("host").alias("key")).agg((F.sum(sign) > 0).alias("listed"))


def url_verdicts(
    pages: DataFrame, rules: tuple = RULES, listed_hosts: DataFrame | None = None, max_bits: int = MAX_BITS, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict. ``listed_hosts``: (key) of hosts to block without a rule; default ``host_majority``."""
    address = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    judged = cut_lineage(longest_rules(address.select("page_id", host.alias("host"), path.alias("path")), rules))
    if listed_hosts is None:
        universe = host_majority(judged, rules)
    else:
        wanted = listed_hosts.select("key").distinct().withColumn("listed", F.lit(True))
        hosts = judged.select(F.col("host").alias("key")).distinct()
        universe = hosts.join(wanted, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    universe = cut_lineage(universe)
    cascade = build_cascade(universe, max_bits)
    if cascade is None:
        flagged = judged.join(universe.select(F.col("key").alias("host"), "listed"), "host", "left")
    else:

        def start():
            return lambda ids, hosts, paths, found: [ids, hosts, paths, found, cascade.contains(hosts)]

        flagged = per_task(judged, "page_id long, host string, path string, rule string, listed boolean", start)
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for rule_host, rule_path, ruling in rules:
        verdict = F.when(F.col("rule") == rule_host + rule_path, ruling).otherwise(verdict)
    return flagged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"))


_FITS = "\n  ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h + p}'"
    for h, p, _ in sorted(RULES, key=lambda rule: -len(rule[0] + rule[1]))
)
_BLOCKS = ", ".join(f"'{h + p}'" for h, p, v in RULES if v == "block")
SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE {_FITS} ELSE NULL END AS rule FROM b),
h AS (SELECT host, sum(CASE WHEN rule IN ({_BLOCKS}) THEN 1 WHEN rule IS NOT NULL THEN -1 ELSE 0 END) > 0 AS listed FROM r GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule,
 CASE WHEN r.rule IN ({_BLOCKS}) THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow' WHEN h.listed THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN h USING (host)
"""
