"""Operator 5: packing by power-of-two decomposition.

A document of n tokens becomes floor(n / longest) pieces of `longest` tokens and
one piece for every set bit of the rest, longest first. Pieces of equal length
form a bucket, and each piece is a sequence of its own: no sequence crosses
documents, and none needs padding, since every length is a power of two.
Sequences are numbered bucket by bucket, longest first, in the order of doc_id
and start, so that a batch reader takes a run of equal lengths.

Defined results. Null text: empty, one piece with the end id. A null doc_id
sorts first and stays null. Rows that share a doc_id are packed each on its own.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import encode_batch
from quire.operators.ordering import global_index
from quire.staging import stage


def piece_lengths(n: int, longest: int) -> list[int]:
    """The binary decomposition of n tokens; longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text), with their ids as little-endian u32 if asked for."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode_batch(b.column(1), tokenizer, end_id)):
                view, start, n = memoryview(ids), 0, len(ids) // 4
                for length in piece_lengths(n, longest):
                    part = view[4 * start : 4 * (start + length)]
                    for column, x in zip(out, (doc_id, start, length, zlib.crc32(part), n, bytes(part) if with_ids else None)):
                        column.append(x)
                    start += length
            columns = [pa.array(x, pa.int64()) for x in out[:5]] + ([pa.array(out[5], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, _PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens (and ids), sequence_id, offset."""
    made = stage(cut(docs, tokenizer, longest, end_id, with_ids), "pieces")
    keys = [F.col("length").desc(), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    numbered = global_index(made, keys, "sequence_id")
    return numbered.withColumn("offset", F.lit(0).cast("long"))


def buckets(packed: DataFrame) -> DataFrame:
    """The buckets of a packing: length, first sequence_id and number of sequences."""
    return packed.groupBy("length").agg(F.min("sequence_id").alias("first_sequence"), F.count("*").alias("sequences"))


def as_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
