"""Byte-level BPE over whole texts as a tree reduction of a monoid, and back.

An element is the token ids of a span of a text. ``encode`` halves the text down to leaves; ``join`` puts neighbours
together: a window around the seam grows until both of its ends are positions where a pre-token ends in every context, the
window is encoded anew, and the tokens outside it stay. Such a position lies between an ASCII character that is no white
space and an ASCII white space character: every alternative of the pattern has white space only as its first character or
in runs of nothing else, so no match crosses it, and no match that ends there looks at more than the white space after it.
A text without such a position is re-encoded as a whole, which stays correct. ``decode`` concatenates bytes up the tree.

Leaves are cut at certain positions too and looked up in a bounded cache of the worker.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.common import Lookup, id_and_bytes, per_task, read

LEAF = 4_096
WINDOW = 32
CERTAIN = re.compile(rb"[^\x20\x09-\x0d\x80-\xff](?=[\x20\x09-\x0d])")
RUNS = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SPACE_PAIRS = (b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ")
# White space beyond ASCII in UTF-8; fixed values of the Unicode property White_Space.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MODELS: dict[tuple, ByteBpe] = {}


class ByteBpe:
    """Ids of one vocabulary, as little-endian unsigned 32-bit integers. ``special``: strings with an id of their own."""

    def __init__(self, name: str, special: dict[str, int] | None = None):
        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})
        self.marks = os.path.commonprefix([mark.encode() for mark in special or {}])  # where it is absent, no special string is
        self.sizes = np.zeros(max([*ranks.values(), *(special or {}).values()]) + 1, dtype=np.int64)
        for word, rank in ranks.items():
            self.sizes[rank] = len(word)
        for mark, rank in (special or {}).items():
            self.sizes[rank] = len(mark.encode())
        self.alone = Lookup(self.by_library)
        self.after_space = Lookup(lambda run: self.by_library(b" " + run))

    def by_library(self, body: bytes) -> bytes:
        if self.marks and self.marks in body:
            ids = self.library.encode(body.decode(), allowed_special="all")
        else:
            ids = self.library.encode_ordinary(body.decode())
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def flat(self, body: bytes) -> bytes:
        """Ids of a whole span: certain positions cut it into runs, each of them looked up."""
        if not body.isascii() and WIDE_SPACE.search(body):
            return self.by_library(body)
        if any(pair in body for pair in SPACE_PAIRS):
            return b"".join(map(self.alone.__getitem__, RUNS.findall(body)))
        first, *rest = body.split(b" ")
        return b"".join([self.alone[first], *map(self.after_space.__getitem__, rest)])

    def encode(self, body: bytes, low: int = 0, high: int | None = None) -> np.ndarray:
        high = len(body) if high is None else high
        if high - low <= LEAF:
            return np.frombuffer(self.flat(body[low:high]), dtype="<u4")
        middle = (low + high) // 2
        while body[middle] & 0xC0 == 0x80:  # inside a character
            middle += 1
        return self.join(body, low, middle, high, self.encode(body, low, middle), self.encode(body, middle, high))

    def join(self, body: bytes, low: int, middle: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        start, end, reach = None, None, WINDOW
        while start is None or end is None:
            if start is None:
                edge = max(low, middle - reach)
                ends = [found.end() for found in CERTAIN.finditer(body, edge, middle)]
                start = ends[-1] if ends else low if edge == low else None
            if end is None:
                edge = min(high, middle + reach)
                found = CERTAIN.search(body, middle, edge)
                end = found.end() if found else high if edge == high else None
            reach *= 2
        window = np.frombuffer(self.flat(body[start:end]), dtype="<u4")
        drop_left = self.covering(left[::-1][: middle - start], middle - start)
        drop_right = self.covering(right[: end - middle], end - middle)
        return np.concatenate([left[: len(left) - drop_left], window, right[drop_right:]])

    def covering(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids cover ``size`` bytes exactly."""
        return int(np.searchsorted(np.cumsum(self.sizes[ids]), size)) + 1 if size else 0

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF:
            return self.library.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def model(name: str, special: dict[str, int] | None = None) -> ByteBpe:
    """One per worker and vocabulary."""
    key = (name, *sorted((special or {}).items()))
    if key not in _MODELS:
        _MODELS[key] = ByteBpe(name, special)
    return _MODELS[key]


def encoded(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary) of every row. Null and empty texts have no ids; a null doc_id stays null; extra columns are ignored."""

    def start():
        bpe = model(name)
        return lambda ids, bodies: [ids, [bpe.encode(body).tobytes() for body in bodies]]

    return per_task(id_and_bytes(docs, doc_id, text), "doc_id long, ids binary", start)


def decoded(rows: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, body (binary) from ``encoded`` rows; null ids give null."""

    def start():
        bpe = model(name)
        return lambda ids, packed: [ids, [None if p is None else bpe.decode(np.frombuffer(p, dtype="<u4")) for p in packed]]

    return per_task(rows.select("doc_id", "ids"), "doc_id long, body binary", start)


def round_trip(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, in one pass over the texts."""

    def start():
        bpe = model(name)

        def work(ids, bodies):
            tokens = [bpe.encode(body) for body in bodies]
            return [
                ids, [len(t) for t in tokens], [hashlib.sha256(t.tobytes()).hexdigest() for t in tokens],
                [hashlib.sha256(bpe.decode(t)).hexdigest() for t in tokens],
            ]

        return work

    return per_task(id_and_bytes(docs, doc_id, text), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
