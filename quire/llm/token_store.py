"""Operator 1: token-ID files with Elias-Fano document boundaries.

Layout. A store is a folder of segments, one binary file each, in ascending
doc_id order. A segment holds the ids of consecutive documents, concatenated,
and two Elias-Fano sequences: where each document ends, and the doc_ids. A
sequence of n values up to u takes about n * (2 + log2(u / n)) bits; its select
structure is one position for every 256th value of the high bits, relative to
the segment and so 32 bits wide. No table of 64-bit offsets exists: a global
offset is the segment's base (the ids before it, from the segments' headers)
plus a select.

    magic "QEF1" | header length u32 | JSON header | low bits, high bits,
    samples of each sequence | ids (u16 where every id fits, else u32) | "\\n"

Spark's own writer puts the segments into any file system that it can reach, with
its commit protocol, one row a file; `binaryFile` reads them back. A segment is
closed at `segment_ids` ids (a longer document has one of its own), so no task
holds more than one segment and one batch.

Defined results. Null text: empty, only the end id. A null doc_id sorts first
and comes back null. Rows that share a doc_id are stored one after the other, in
the order of their text; equal rows each keep a place. An empty table gives an empty store and no rows. Other
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tokens import encode_batch
from quire.staging import new_path, stage

MAGIC = b"QEF1"
_SAMPLE = 256
_NULL_ID = -(1 << 63)


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with select in constant time."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        upper = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(upper[-1]) + 1 if n else 0, np.uint8)
        bits[upper] = 1
        lows = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
        return cls(n, width, np.packbits(lows.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), upper[::_SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The value at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // _SAMPLE
        first = int(self.samples[k])
        # Up to the next sample lie all the ones that can be meant.
        end = int(self.samples[k + 1]) // 8 + 1 if k + 1 < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[first // 8 : end], bitorder="little")
        place = first + int(np.flatnonzero(bits[first % 8 :])[i % _SAMPLE])
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return part >> (first % 8) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        upper = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return upper
        lows = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return upper | (lows << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    @classmethod
    def read(cls, n: int, low_bits: int, parts: list[memoryview]) -> EliasFano:
        low, high = (np.frombuffer(p, np.uint8) for p in parts[:2])
        return cls(n, low_bits, low, high, np.frombuffer(parts[2], "<u4"))


def pack_segment(doc_ids: list[int], ids: list[bytes], task: int, number: int) -> bytes:
    """One segment from the documents' ids (each little-endian u32, end id included)."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids]))
    base = min(doc_ids)
    names = EliasFano.of(np.asarray([x - base for x in doc_ids], np.uint64))
    narrow = not len(flat) or int(flat.max()) < 1 << 16
    parts = [*ends.parts(), *names.parts(), flat.astype("<u2" if narrow else "<u4").tobytes()]
    header = json.dumps({
        "task": task, "segment": number, "docs": len(doc_ids), "ids": len(flat), "first_doc": base,
        "end_bits": ends.low_bits, "doc_bits": names.low_bits, "width": 2 if narrow else 4, "parts": [len(p) for p in parts],
    }).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


class Segment:
    """A segment read back: document i of it is ids[ends.select(i - 1) : ends.select(i)]."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token segment")
        (size,) = struct.unpack("<I", data[4:8])
        self.header = h = json.loads(bytes(data[8 : 8 + size]))
        at, parts = 8 + size, []
        for length in h["parts"]:
            parts.append(data[at : at + length])
            at += length
        if at > len(data):
            raise ValueError("truncated token segment")
        self.ends = EliasFano.read(h["docs"], h["end_bits"], parts[:3])
        self.names = EliasFano.read(h["docs"], h["doc_bits"], parts[3:6])
        self.ids = np.frombuffer(parts[6], "<u2" if h["width"] == 2 else "<u4")

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int]:
        return [int(x) + self.header["first_doc"] for x in self.names.all()]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, segment_ids: int = 4_000_000) -> None:
    """Tokenize every text of docs(doc_id, text) and write the segments, in ascending doc_id order."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long").alias("doc_id"), "text")
    keys = [F.col("doc_id"), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, names, ids = TaskContext.get().partitionId(), 0, 0, [], []
        for b in batches:
            for doc_id, encoded in zip(b.column(0).to_pylist(), encode_batch(b.column(1), tokenizer, end_id)):
                if held and held + len(encoded) // 4 > segment_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_segment(names, ids, task, number)], pa.binary())], names=["data"])
                    number, held, names, ids = number + 1, 0, [], []
                names.append(doc_id)
                ids.append(encoded)
                held += len(encoded) // 4
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([pack_segment(names, ids, task, number)], pa.binary())], names=["data"])

    made = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text").mapInArrow(segments, "data binary")
    # The cast keeps the bytes as they are; the writer adds a line end after the last part.
    made.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/part-*").select("content")


#: A row a document, and one a segment whose n_tokens is null and whose local_start is all its ids.
_ROWS = "task int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each file is read once; every document is found by select in its segment's boundaries.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Segment(content.as_buffer())
                n, start = len(s), 0
                starts, sizes, crcs = [], [], []
                for i in range(n):
                    end = s.ends.select(i)
                    starts.append(start)
                    sizes.append(end - start)
                    crcs.append(zlib.crc32(s.ids[start:end].astype("<u4")))
                    start = end
                ids = [None if x == _NULL_ID else x for x in s.doc_ids()]
                columns = [[s.header["task"]] * (n + 1), [s.header["segment"]] * (n + 1), [*ids, None], [*starts, start], [*sizes, None], [*crcs, None]]
                types = (pa.int32(), pa.int32(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _ROWS.split(", ")])

    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = stage(read_segments(spark, path).mapInArrow(read, _ROWS), "documents")
    # One row a segment of millions of ids; a task's segments are summed first, and the tasks' sums are as many as the partitions.
    heads = rows.where("n_tokens is null").select("task", "segment", F.col("local_start").alias("ids"))
    tasks = sorted((r["task"], r["n"]) for r in heads.groupBy("task").agg(F.sum("ids").alias("n")).collect())
    bases, before = [], 0
    for task, n in tasks:
        bases.append((task, before))
        before += n
    base = spark.createDataFrame(bases, "task int, before long")
    within = F.sum("ids").over(_earlier())
    at = heads.join(F.broadcast(base), "task").select("task", "segment", (F.col("before") + F.coalesce(within, F.lit(0))).alias("base"))
    return rows.where("n_tokens is not null").join(at, ["task", "segment"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _earlier():
    from pyspark.sql import Window

    return Window.partitionBy("task").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1, segment_ids: int = 4_000_000) -> DataFrame:
    """Write docs to a new store in the shared folder and return the documents as read back from it."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer, end_id, segment_ids)
    return read_store(spark, path)
