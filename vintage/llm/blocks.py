"""Blocks: documents as streams of word numbers, for operators on word counts.

A block holds up to about ``BLOCK`` tokens of whole documents, with its own
numbering of its distinct words. What is counted moves once for each block and
distinct word or n-gram, never once for each occurrence, so a word that makes up
a third of a corpus is as many rows as there are blocks.

Arrays travel as compressed binary columns: ``pack`` cuts numbers into byte
planes, so that the leading zero bytes of small numbers or of differences cost
next to nothing.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from vintage.llm.common import materialize

#: Tokens after which a block is closed; a longer document is a block of its own.
BLOCK = 1 << 20
#: Spark's own setting: shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Numbers(dict):
    """word -> number, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def stream(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of whole numbers of 0 and more; ``rising`` ones as differences."""
    values = np.ascontiguousarray(values).astype(np.uint64)
    if rising and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    head = len(values).to_bytes(8, "little") + bytes([width, rising])
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The numbers that ``pack`` was given, as uint64."""
    n, width, rising = int.from_bytes(data[:8], "little"), data[8], data[9]
    out = np.zeros((n, 8), np.uint8)
    if width and n:
        raw = zstandard.ZstdDecompressor().decompress(data[10:], max_output_size=max(1, n * width))
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    values = out.reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for a frame that is used once: as its rows are in a
    table, its shuffle files are of no more use and need not wait for the driver's
    garbage collection."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(_CLEAN, before)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct codes, and for each code its place among them."""
    order = np.argsort(codes, kind="stable")
    first = np.ones(len(codes), bool)
    first[1:] = codes[order][1:] != codes[order][:-1]
    place = np.empty(len(codes), np.int64)
    place[order] = np.cumsum(first) - 1
    return codes[order][first], place
