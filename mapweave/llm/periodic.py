"""Periodic runs of words by block convolution at dyadic scales.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that cannot be
extended. At scale L (a power of two) the text is cut into blocks of L words. A run with a period from L to 2L - 1 holds a
whole block together with its copy one period further on, since words q apart are equal along at least 2q of its places; so
the block occurs, without a mismatch, in the window that follows it. The smallest scale takes all periods below 2L. The sum
of squared differences of a block against every place of its window comes from one convolution, an exact number-theoretic
transform modulo ``PRIME``; places where it is zero give distances, and distances seed extensions.

Seeds of one distance in neighbouring blocks form a chain. A chain too short for a run of its period is left out, so is one that
lies in a known run whose period divides the distance: it would find that run again. The others are extended by comparing
words on either side, which also tells a sum that is a multiple of the prime from zero. Stretches found with several distances
keep the smallest, which is the period.

Blocks of all texts of a batch are transformed together, so many per call; a text is never cut. Texts of up to 3 * 2 ** 26 words
are covered by the size of the prime, which is more than a string can hold.

Null and empty texts, and texts of white space, have no words and no runs. Rows that share a doc_id are each searched; a null
doc_id stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import id_and_bytes, per_task, read

LEAST = 24
TIMES = 3
FIRST = 8  # words of a block at the smallest scale
PRIME = 2_013_265_921  # 15 * 2 ** 27 + 1, so there are roots of unity of order 2 ** 27
GENERATOR = 31
CELLS = 1 << 17  # words in one call of the transform: several arrays of so many stay in the cache
_P = np.uint64(PRIME)


def reduced(values: np.ndarray) -> np.ndarray:
    """Values modulo the prime. Division by one constant is vectorised, the remainder is not."""
    return values - values // _P * _P


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0 to base ** (count - 1), by doubling."""
    out = np.ones(count, dtype=np.uint64)
    have = 1
    while have < count:
        more = min(have, count - have)
        out[have : have + more] = reduced(out[:more] * np.uint64(pow(base, have, PRIME)))
        have += more
    return out


def transform(values: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform along the first axis (a power of two); the second axis holds independent inputs.

    Each stage pairs the two halves and puts sums and turned differences side by side, so the order comes out natural.
    """
    size, inputs = values.shape
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    turns = powers(pow(root, -1, PRIME) if inverse else root, max(1, size // 2))
    now, rest, done = values, size, 1
    while rest > 1:
        half = rest // 2
        now = now.reshape(rest, done * inputs)
        out = np.empty((half, 2, done * inputs), dtype=np.uint64)
        total = now[:half] + now[half:]
        np.minimum(total, total - _P, out=out[:, 0])  # below zero wraps round to a large number
        out[:, 1] = reduced((now[:half] + (_P - now[half:])) * turns[::done, None])
        now, rest, done = out, half, done * 2
    now = now.reshape(size, inputs)
    return reduced(now * np.uint64(pow(size, -1, PRIME))) if inverse else now


def zero_places(segments: np.ndarray, first: int) -> np.ndarray:
    """Where blocks occur in what follows: entry [t, j] tells whether segment j equals the words from ``first * L + t`` words
    after its start. ``segments``: L x count, neighbours in a text side by side; the window ends with the second segment after."""
    length, count = segments.shape
    span = 3 - first  # segments in a window
    size = length * (4 if span == 3 else 2)
    wide = np.zeros((size, count), dtype=np.uint64)
    wide[:length] = segments
    spectrum = transform(wide)
    blocks = count - 2
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    window = spectrum[:, first : first + blocks]
    for turn in range(1, span):  # a shift by so many segments turns the spectrum
        turned = spectrum[:, first + turn : first + turn + blocks] * powers(pow(root, length * turn, PRIME), size)[:, None]
        window = window + reduced(turned)
    mirrored = spectrum[-np.arange(size) % size, :blocks]  # of the block read backwards: correlation, not convolution
    common = transform(reduced(reduced(window) * mirrored), inverse=True)
    lags = 2 * length if span == 3 else length
    squares = reduced(segments * segments)
    along = np.cumsum(np.concatenate([squares[:, first + turn : first + turn + blocks] for turn in range(span)]), axis=0)
    along = np.concatenate([np.zeros((1, blocks), dtype=np.uint64), along])
    whole = squares[:, :blocks].sum(axis=0)
    return reduced(whole + along[length : length + lags] - along[:lags]) == reduced(common[:lags] * np.uint64(2))


def seeds(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, block, distance) of every copy at one scale. Texts lie one behind the other in ``words``."""
    first = 0 if length == FIRST else 1
    shortest = max(1, first * length)
    blocks = np.maximum(0, (ends - begins - shortest) // length)  # a block and its nearest copy fit
    texts = np.flatnonzero(blocks)
    found = []
    per_call = max(1, CELLS // (length * (2 if first else 4)))
    # Neighbouring texts share a call until it is full; a long text takes several.
    pieces = [(t, at, min(per_call, blocks[t] - at)) for t in texts for at in range(0, int(blocks[t]), per_call)]
    call, held = [], 0
    for piece in [*pieces, None]:
        if call and (piece is None or held + piece[2] > per_call):
            found.append(seeds_of_call(words, begins, ends, length, first, call))
            call, held = [], 0
        if piece is not None:
            call.append(piece)
            held += piece[2]
    return tuple(np.concatenate([f[part] for f in found] or [np.zeros(0, np.int64)]) for part in range(3))


def seeds_of_call(words, begins, ends, length, first, call):
    counts = np.array([n + 2 for _, _, n in call])
    text = np.repeat([t for t, _, _ in call], counts)
    number = np.concatenate([np.arange(at, at + n + 2) for _, at, n in call])
    starts = begins[text] + number * length
    places = np.minimum(starts + np.arange(length)[:, None], len(words) - 1)  # what lies beyond a text's end is left out below
    equal = zero_places(words[places], first)
    last = np.cumsum(counts)
    real = np.ones(len(text), dtype=bool)
    real[np.concatenate([last - 1, last - 2])] = False
    lag, at = np.nonzero(equal & real[: equal.shape[1]])
    distance = lag + first * length
    fits = (distance > 0) & (starts[at] + distance + length <= ends[text[at]])
    return text[at[fits]], number[at[fits]], distance[fits]


def chains(text: np.ndarray, block: np.ndarray, distance: np.ndarray, length: int, least: int, times: int):
    """(text, first block, blocks, distance) of seeds side by side, by text and distance; only those long enough for a run."""
    order = np.lexsort((block, distance, text))
    text, block, distance = text[order], block[order], distance[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (distance[1:] != distance[:-1]) | (block[1:] != block[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(text)))
    # Words a distance apart are equal along so many places of a run; so many whole blocks are in them at least.
    places = np.maximum(least, times * distance[at]) - distance[at]
    enough = size >= np.maximum(1, (places - length + 1) // length)
    return text[at[enough]], block[at[enough]], size[enough], distance[at[enough]]


class Cover:
    """Runs of one text, by start, and the greatest end up to each: which of them cover a stretch."""

    def __init__(self, periods: dict[tuple[int, int], int]):
        self.runs = sorted((start, end, period) for (start, end), period in periods.items())
        self.starts = [start for start, _, _ in self.runs]
        self.reach = list(accumulate((end for _, end, _ in self.runs), max))

    def known(self, start: int, end: int, distance: int) -> bool:
        """Whether a run whose period divides the distance covers the stretch."""
        at = bisect_right(self.starts, start) - 1
        while at >= 0 and self.reach[at] >= end:
            if self.runs[at][1] >= end and distance % self.runs[at][2] == 0:
                return True
            at -= 1
        return False


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, given as word numbers, by start and period."""
    if times < 3 or least < 2 * FIRST + 7:
        raise ValueError("blocks are sure to lie in a run of three periods and 23 words")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    words = np.concatenate([*texts, np.zeros(1, np.int64)]).astype(np.uint64)
    periods: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)  # by text: the smallest distance of each stretch
    length = FIRST
    while len(long := np.flatnonzero(sizes >= max(least, times * length if length > FIRST else 0))):
        # Distances of one scale divide each other at the first one only; there, repeated finds are few.
        covers = {text: Cover(runs) for text, runs in periods.items()}
        found = chains(*seeds(words, begins[long], ends[long], length), length, least, times)
        for text, block, count, distance in zip(long[found[0]].tolist(), *(column.tolist() for column in found[1:]), strict=True):
            begin, end = block * length, (block + count) * length
            if text in covers and covers[text].known(begin, end + distance, distance):
                continue
            start, size = int(begins[text]), int(sizes[text])
            low, high = max(0, begin - length), min(size - distance, end + length)
            differ = np.flatnonzero(words[start + low : start + high] != words[start + low + distance : start + high + distance]) + low
            edges = np.concatenate([[low - 1], differ, [high]])
            for at in np.flatnonzero(np.diff(edges) > max(least, times * distance) - distance).tolist():
                stretch = int(edges[at]) + 1, int(edges[at + 1]) + distance
                periods[text][stretch] = min(distance, periods[text].get(stretch, distance))
        length *= 2
    runs = [[] for _ in texts]
    for text, some in periods.items():
        runs[text] = sorted(((start, end - start, period) for (start, end), period in some.items()), key=lambda run: (run[0], run[2]))
    return runs


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run is collapsed to its first period."""
    kept = np.ones(count, dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, starts, lengths, periods (arrays, one entry a run, by start and period) and the collapsed text of every row."""

    def start():
        def work(ids, bodies):
            # A few megabytes of text are searched at a time, whatever the batch holds.
            out, part, held = [[], [], [], []], [], 0
            for body in [*bodies, None]:
                if part and (body is None or held + len(body) > 1 << 22):
                    for column, values in zip(out, searched(part), strict=True):
                        column += values
                    part, held = [], 0
                if body is not None:
                    part.append(body)
                    held += len(body)
            return [ids, *out]

        def searched(bodies):
            number: dict[bytes, int] = {}
            split = [body.split() for body in bodies]
            numbers = [np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words)) for words in split]
            runs = runs_of(numbers, least, times)
            texts = []
            for words, some in zip(split, runs, strict=True):
                if some:
                    words = [word for word, stays in zip(words, kept_words(len(words), some).tolist(), strict=True) if stays]
                texts.append(b" ".join(words).decode())
            return [*([[run[at] for run in some] for some in runs] for at in range(3)), texts]

        return work

    schema = "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
    return per_task(id_and_bytes(docs, doc_id, text), schema, start)


def repeated_ends(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text), every tenth document by its id's hash with its end replaced by repeats of some of its words."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.crc32(F.col(doc_id).cast("string").cast("binary")).alias("h"),
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("a", F.expr("h DIV 10 % nullif(size(words), 0)"))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) DIV (3 + (h DIV 10) % 8)"))
    planted = F.expr("array_join(transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)])), ' ')")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def _digest(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(repeated_ends(read(spark, sf_dir, "documents")))
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.starts, r.lengths, r.periods)), '\n') || IF(size(runs) > 0, '\n', '')")
    # Exponents are compared as fractions; the array is in order of start and period, so that an earlier run stays in a tie.
    best = F.expr("""
        aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0],
         (best, r) -> IF(r.lengths * best.periods > best.lengths * r.periods, r, best))
    """)
    rows = rows.select("doc_id", F.arrays_zip("starts", "lengths", "periods").alias("runs"), "collapsed")
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.starts").alias("start"), F.col("best.lengths").alias("length"),
        F.col("best.periods").alias("period"), F.expr("best.lengths * 1000 DIV best.periods").alias("exponent_milli"),
        _digest(lines).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
