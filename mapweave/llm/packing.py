"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; the first piece takes the remainder). Full
pieces are sequences of their own and enter no group. The others are dealt evenly into groups of about ``GROUP`` pieces, each packed in a task
of its own: best-fit decreasing gives the incumbent; then, bin by bin, the largest piece left is completed by the undominated
fillings of its gap, least waste first, and a branch is left when its waste exceeds what a solution with one sequence fewer
may waste. A group ends at its lower bound, when nothing is left to try, or after ``NODES`` bins or ``STEPS`` times as many
steps inside fillings, and keeps the best solution.

Ids come from the rank file of the vocabulary, through the other public library that reads it: tests hold them against those
of ``tokenizers`` and the .json file, special strings included.

Null and empty texts are one piece, the separator alone. Rows that share a doc_id are packed each. An empty table gives an
empty result; extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.byte_bpe import model
from mapweave.llm.common import id_and_bytes, per_task, read
from mapweave.session import cut_lineage

CAPACITY = 2_048
SEPARATOR = 0
GROUP = 16_384
NODES = 40_000
STEPS = 200
END_OF_TEXT = {"<|endoftext|>": 50_256}  # fixed value of the vocabulary


def pieces(docs: DataFrame, capacity: int, name: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def start():
        bpe = model(name, END_OF_TEXT)
        separator = np.array([SEPARATOR], dtype="<u4").tobytes()

        def work(ids, bodies):
            rows = []
            for key, body in zip(ids, bodies, strict=True):
                tokens = bpe.flat(body) + separator
                total = len(tokens) // 4
                at, end = 0, total % capacity or capacity if total > capacity else total
                number = 0
                while at < total:
                    rows.append((key, number, at, end - at, zlib.crc32(tokens[4 * at : 4 * end])))
                    at, end, number = end, end + capacity, number + 1
            return list(map(list, zip(*rows, strict=True))) or [[]] * 5

        return work

    return per_task(id_and_bytes(docs, doc_id, text), "doc_id long, piece int, start long, length long, ids_crc32 long", start)


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over a histogram of sizes: each piece goes to the fullest sequence that has room."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = np.zeros(capacity + 1, dtype=np.int64)
    for size in range(capacity, 0, -1):
        for _ in range(int(counts[size])):
            fitting = np.flatnonzero(open_gaps[size:])
            if len(fitting):
                gap = size + int(fitting[0])
                index = by_gap[gap].pop()
                open_gaps[gap] -= 1
                bins[index].append(size)
            else:
                gap, index = capacity, len(bins)
                bins.append([size])
            by_gap[gap - size].append(index)
            open_gaps[gap - size] += 1
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bounds of pieces that exclude one another, over all thresholds."""
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(volume[-1]) // capacity)
    for small in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - small])  # share a sequence with nothing of size small or more
        half = int(number[capacity - small] - number[capacity // 2])
        half_volume = int(volume[capacity - small] - volume[capacity // 2])
        rest = int(volume[capacity // 2] - volume[small - 1])
        best = max(best, large + half + max(0, -(-(rest - (half * capacity - half_volume)) // capacity)))
    return best


def bits_of(sizes: np.ndarray) -> int:
    """A set of small numbers as the bits of one."""
    return int.from_bytes(np.packbits(sizes, bitorder="little").tobytes(), "little")


def narrow(numbers: np.ndarray) -> array:
    return array("i", numbers.astype(np.int32).tobytes())


def first_reach(there: array, counts: array, gap: int) -> np.ndarray:
    """For each sum up to ``gap``, how many of the sizes, smallest first, are needed to make it; more than there are if none can."""
    needed = np.full(gap + 1, len(there) + 1, dtype=np.int32)
    needed[0], sums, mask = 0, 1, (1 << (gap + 1)) - 1
    for number, (size, count) in enumerate(zip(there, counts, strict=True), 1):
        grown = sums
        for _ in range(min(count, gap // size)):
            more = (grown | grown << size) & mask
            if more == grown:
                break
            grown = more
        if new := grown ^ sums:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(gap // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
            needed[np.flatnonzero(bits)] = number
            sums = grown
        if sums == mask:
            break
    return needed


def smeared(sums: int, most: int) -> int:
    """The sums, each with all numbers up to ``most`` above it."""
    width = 0
    while width < most:
        step = min(width + 1, most - width)
        sums |= sums << step
        width += step
    return sums


def over(sums: int, most: int) -> int:
    """All numbers from one to ``most`` above a sum."""
    return smeared(sums << 1, most - 1)


def completions(counts: np.ndarray, gap: int, most: int, steps: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``gap`` from the histogram that waste at most ``most``, of any number of pieces, least waste first.

    A filling is dominated where pieces of it, or none, can give way to one piece outside that is at least as large and still
    fits: what was there fits where that piece was. One equal piece gains nothing in place of another. ``steps`` holds one
    number, what may still be tried; below zero the enumeration stops.
    """
    steps = [1 << 60] if steps is None else steps
    sizes = np.flatnonzero(counts[: gap + 1])
    if not len(sizes):
        if gap <= most:
            yield ()
        return
    largest = int(sizes[-1])
    there, many = narrow(sizes), narrow(counts[sizes])  # thousands of enumerations stand open at a time
    free = bits_of(counts[: gap + 1] > 0)
    steps[0] -= 1
    # Sums up to the largest piece are dominated by that piece alone.
    if gap > largest:
        steps[0] -= len(there)
        needed = narrow(first_reach(there, many, gap))

        def exactly(rest: int, below: int, waste: int, free: int, one: int, two: int, filling: tuple) -> Iterator[tuple[int, ...]]:
            """Fillings of exactly ``rest`` from the first ``below`` sizes. Bits: sizes with pieces left, sums of up to one and of more pieces."""
            for at in range(bisect_right(there, rest, 0, below) - 1, -1, -1):
                if needed[rest] > at + 1 or steps[0] < 0:
                    return
                size = there[at]
                for copies in range(min(many[at], rest // size), 0, -1):
                    if needed[rest - copies * size] > at:
                        continue
                    steps[0] -= 1
                    left = free ^ (1 << size) if copies == many[at] else free
                    ones, twos = one, two
                    for _ in range(copies):
                        twos |= (twos | ones & ~1) << size
                        ones |= 1 << size
                    # Larger sizes are decided: a sum of several pieces that one of them equals is dominated whatever follows.
                    if twos & left:
                        continue
                    if rest > copies * size:
                        yield from exactly(rest - copies * size, at, waste, left, ones, twos, (*filling, *[size] * copies))
                    elif not ((over(ones, waste) if waste else 0) | smeared(twos, waste)) & left:
                        yield (*filling, *[size] * copies)

        for waste in range(min(most, gap - largest - 1) + 1):
            if needed[gap - waste] <= len(there):
                yield from exactly(gap - waste, len(there), waste, free, 1, 0, ())
    alone = free ^ (1 << largest) if many[-1] == 1 else free
    if gap - largest <= most and not alone & ((1 << (gap - largest + 1)) - 2):
        yield (largest,)


def undo(left: np.ndarray, path: list[tuple[int, ...]], capacity: int) -> int:
    """Take back the filling of the last sequence; its largest piece stays out. Gives the waste it had."""
    last = path.pop()
    for size in last[1:]:
        left[size] += 1
    return capacity - sum(last)


def pack_sizes(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Sizes per sequence for a histogram of sizes up to ``capacity``."""
    incumbent = best_fit(counts, capacity)
    least = lower_bound(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    left, path, untried = counts.copy(), [], []
    allowed = (len(incumbent) - 1) * capacity - total  # waste of a better solution
    waste, top, down, steps = 0, capacity, True, [STEPS * nodes]
    while len(incumbent) > least and nodes > 0 and steps[0] >= 0:
        if down:
            while top and not left[top]:
                top -= 1
            if not top:
                incumbent = [list(b) for b in path]
                allowed = (len(incumbent) - 1) * capacity - total
                down = False
                waste -= undo(left, path, capacity)
                continue
            left[top] -= 1
            # Reads the histogram when it is first asked, just below; the fillings put in later are taken out before it is asked again.
            untried.append((top, completions(left, capacity - top, allowed - waste, steps)))
        largest, choices = untried[-1]
        filling = next(choices, None)
        if filling is not None and capacity - largest - sum(filling) <= allowed - waste:
            for size in filling:
                left[size] -= 1
            path.append((largest, *filling))
            waste += capacity - sum(path[-1])
            nodes, down, top = nodes - 1, True, largest
            continue
        untried.pop()
        left[largest] += 1
        top, down = largest, False
        if not path:
            break
        waste -= undo(left, path, capacity)
    return incumbent


def place(table: pa.Table, capacity: int, nodes: int = NODES) -> pa.Table:
    """Sequence and offset of each piece of one group; all are shorter than ``capacity``."""
    size = table["length"].to_numpy()
    order = np.argsort(size, kind="stable")
    counts = np.bincount(size, minlength=capacity + 1)
    next_of = np.cumsum(counts) - counts
    bins = pack_sizes(counts, capacity, nodes)
    sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    for number, content in enumerate(bins):
        at = 0
        for piece in content:
            row = order[next_of[piece]]
            next_of[piece] += 1
            sequence[row], offset[row] = number, at
            at += piece
    sequence += table["bucket"].to_numpy().astype(np.int64) << 40
    out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def packed(
    docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k.tiktoken", group: int = GROUP, nodes: int = NODES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = cut_lineage(pieces(docs, capacity, name, doc_id, text))
    full = cut.where(F.col("length") == capacity)
    # One bit above all that groups use.
    alone = full.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = cut.where(F.col("length") < capacity)
    groups = -(-short.count() // group) or 1
    dealt = short.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInArrow(lambda table: place(table, capacity, nodes), schema).union(alone)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
