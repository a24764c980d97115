"""What several of the operators share: word hashes, tokenizers, inputs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: About 30 MB.
_CACHE_WORDS = 150_000
#: Texts that go to a Python worker at a time: 10,000, the default, can be hundreds of MB on either side.
_BATCH = "1000"


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, _BATCH)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64: equal in, equal out, and order becomes random."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of text, A-Z lower-cased.

    Fewer words than width: the whole sequence is one shingle. No words: empty.
    """
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        h = h * _BASE + w[k : len(w) - size + 1 + k]
    return np.unique(mixed(h))
