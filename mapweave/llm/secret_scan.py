"""Secret spans of whole texts: three base patterns, and windows of high entropy in candidate strings.

Candidates are the longest runs of token characters of at least ``WINDOW`` characters. A window of that size slides over
each; symbol counts and the entropy are updated by the character that leaves and the one that enters. Windows at or above
the threshold of the candidate's character class are united to a span. Segments with a placeholder or a counting sequence
are left out of a candidate, and the rest of it is scanned. The allow-list takes out what is long but harmless: short
numbers, path-like words and names of capitalised words, judged on stretches and on united spans. Of a span that meets base spans, only
what they leave is reported, as spans of its own.

Null and empty texts have no spans (the digest of the empty string). Rows that share a doc_id are scanned each; a null
doc_id stays null; an empty table gives an empty result; extra columns are ignored, or passed through by ``redacted``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import id_and_bytes, per_task, read

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the whole runs of 24 or more: a shorter run has no place to start
KINDS = ("assign", "access", "hex", "entropy")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
WINDOW = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_TOKEN_BYTES = bytes(c if chr(c).isalnum() and c < 128 or c in b"+/_=-" else 32 for c in range(256))
# Bits per character that a window of 20 must reach, each below what 20 characters of its class can have (3.32 for digits,
# 4 for hex, 4.32 for the others); random strings of a class lie above, words of a language below.
CLASSES = (
    (re.compile(r"[0-9]+"), 2.6), (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 3.0), (re.compile(r"[a-z]+|[A-Z]+"), 3.7),
    (re.compile(r"[A-Z0-9]+|[a-z0-9]+"), 3.5), (TOKEN, 3.7),
)
# A segment with one of these is left out, and what stands beside it is scanned by itself.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|your[-_]?(?:key|token|secret)|x{6}|0123456|abcdef", re.IGNORECASE | re.ASCII)
SEGMENT = re.compile(r"[^/=_-]+")
# Spans that are harmless as a whole.
ALLOWED = (
    re.compile(r"(?:[0-9]{0,19}[+/_=-])+[0-9]{0,19}"),  # short numbers, as in dates
    re.compile(r"(?>(?>[A-Z]?[a-z]{20,}|[A-Za-z]{0,19})[0-9]{0,4}[-_/=+])+(?>[A-Z]?[a-z]{20,}|[A-Za-z]{0,19})[0-9]{0,4}"),  # words and small numbers, as in paths and names
    re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{1,4}"),  # a word and a small number
)
LETTERS = re.compile(r"[A-Za-z]+[0-9]{0,4}")
MARK = "[SECRET]"


def high_windows(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of the windows whose Shannon entropy is ``least`` bits or more, by incremental counts."""
    weight = [0.0, *(n * math.log2(n) for n in range(1, window + 1))]
    counts, total, spans = Counter(), 0.0, []
    for end, symbol in enumerate(text, 1):
        total += weight[counts[symbol] + 1] - weight[counts[symbol]]
        counts[symbol] += 1
        if end > window:
            gone = text[end - window - 1]
            total += weight[counts[gone] - 1] - weight[counts[gone]]
            counts[gone] -= 1
        if end >= window and math.log2(window) - total / window >= least - 1e-9:
            if spans and spans[-1][1] >= end - window:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - window, end))
    return spans


def stretches(value: str) -> list[tuple[int, int]]:
    """What is left of a run without the segments that hold a placeholder."""
    if not (found := list(PLACEHOLDER.finditer(value))):
        return [(0, len(value))]
    parts, at, ends = [], 0, [f.end() for f in found]
    for segment in SEGMENT.finditer(value):
        after = bisect_right(ends, segment.start())
        if after < len(found) and found[after].start() < segment.end():
            parts.append((at, segment.start()))
            at = segment.end()
    return [*parts, (at, len(value))]


def harmless(value: str) -> bool:
    """Words, small numbers and names made of capitalised words: in these, one case has less than three letters of ten."""
    if any(allowed.fullmatch(value) for allowed in ALLOWED):
        return True
    upper, lower = sum(c.isupper() for c in value), sum(c.islower() for c in value)
    return bool(upper and lower and LETTERS.fullmatch(value)) and 10 * min(upper, lower) < 3 * (upper + lower)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for run in TOKEN.finditer(text):
        if run.end() - run.start() < WINDOW:
            continue
        for begin, end in stretches(run.group()):
            value = run.group()[begin:end].lstrip("/=_-")
            begin = end - len(value)
            value = value.rstrip("/=_-") if end < len(run.group()) else value
            if len(value) < WINDOW or harmless(value):
                continue
            least = next(bits for shape, bits in CLASSES if shape.fullmatch(value))
            spans = ((run.start() + begin + a, run.start() + begin + b) for a, b in high_windows(value, least))
            found += [(a, b) for a, b in spans if not harmless(text[a:b])]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    return sorted(found + [(m.start(), m.end(), 2) for m in HEX.finditer(text)], key=lambda s: (s[0], s[2]))


def remainders(spans: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What ``taken``, in order of start, leaves of ``spans``, which are in order and apart."""
    filled: list[tuple[int, int]] = []
    for start, stop, _ in taken:
        if filled and start <= filled[-1][1]:
            filled[-1] = (filled[-1][0], max(stop, filled[-1][1]))
        else:
            filled.append((start, stop))
    left, number = [], 0
    for at, end in spans:
        while number < len(filled) and filled[number][1] <= at:
            number += 1
        for start, stop in filled[number:]:
            if start >= end:
                break
            if start > at:
                left.append((at, start))
            at = max(at, stop)
        if at < end:
            left.append((at, end))
    return left


def beside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Entropy spans without what is in base spans; what stands between these is also judged by itself, as their own words
    (a placeholder in a key's name, say) tell nothing of it."""
    found = remainders(entropy_spans(text), base)
    if base:
        apart = list(text)
        for start, stop, _ in base:
            apart[start:stop] = " " * (stop - start)
        more = sorted([*found, *entropy_spans("".join(apart))])
        found = []
        for start, stop in more:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], max(stop, found[-1][1]))
            else:
                found.append((start, stop))
    return found


def spans_of(body: bytes) -> tuple[list, list]:
    """Base spans and all spans. Most texts have no keyword and no long run, and end at the first test."""
    low = body.lower()
    if not any(word in low for word in WORDS) and len(max(body.translate(_TOKEN_BYTES).split(), key=len, default=b"")) < WINDOW:
        return [], []
    text = body.decode()
    base = base_spans(text)
    more = [(a, b, 3) for a, b in beside(text, base)]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans (kind:start:end in code points)."""

    def start():
        def work(ids, bodies):
            both = [spans_of(body) for body in bodies]
            counts = [[sum(s[2] == kind for s in every) for _, every in both] for kind in range(4)]
            return [
                ids, *counts, [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both], [written(every) for _, every in both]
            ]

        return work

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return per_task(id_and_bytes(docs, doc_id, text), schema, start)


def without_secrets(text: str | None) -> str | None:
    """The text with every span replaced by ``MARK``; spans that meet become one."""
    spans = spans_of(text.encode())[1] if text else []
    if not spans:
        return text
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with secrets masked; ``length``, where there is such a column, follows the new text."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            clean = [without_secrets(value) for value in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, type=batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length not in docs.columns:
        return out
    kind = docs.schema[length].dataType
    return out.withColumn(length, F.when(F.col(length).isNotNull(), F.length(text)).cast(kind))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))
