"""What the training-data operators share: tables, words, hashes and scratch tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.session import scratch_path
from finfacts.sources.store import delete_path

#: The six separators of ``[^\x20\x09-\x0D]+``; everything else belongs to a word.
SPACES = "\t\n\x0b\x0c\r "
#: The same class for Spark's and DuckDB's regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; ``bytes.split`` cuts at exactly the six separators."""
    return text.encode().split() if text else []


def remainder(column: str, by: int) -> Column:
    """crc32 of a column's text, modulo ``by``; null stays null."""
    return F.crc32(F.col(column).cast("string")) % by


class HashCache(dict):
    """64-bit hashes of words (bytes); cleared when it holds ``room`` words, so memory stays bounded."""

    def __init__(self, room: int = 300_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mix(out)


def shared(spark: SparkSession, value, make: Callable[[Any], Any] = lambda value: value) -> Callable[[], Any]:
    """``make(value)`` for the tasks. The value is broadcast once, and by value, so that executors need not have this
    package. What is made of it stays with the broadcast in a worker process and serves its later tasks too."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((value, make)))

    def opened():
        if not hasattr(sent, "made"):
            value, make = pickle.loads(sent.value)
            sent.made = make(value)
        return sent.made

    return opened


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared scratch folder and read again: lineage ends here."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of ``stored`` frames. Only for frames that nothing unwritten still reads."""
    for frame in frames:
        delete_path(frame.sparkSession, frame.scratch)


def row_key(*columns: str) -> Column:
    """A key of a row's content that any two engines and any two runs agree on."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
