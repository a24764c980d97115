"""Operator 7: removal of every byte in a 200-byte string that also starts elsewhere.

The order of suffixes is needed only as far as 200 bytes, and only to tell which
suffixes have an equal there. So suffixes fall into buckets by content: the bucket
of a window is its anchor, the gram of least hash among those inside it, which
equal windows share at equal distance. The windows of one anchor in one text are a
run; runs are settled in blocks, from coarse to fine, each block by counting keys
with partial sums before any shuffle:

1. An anchor's gram met once: its windows are unique. Most buckets end here.
2. A run whose whole region (all bytes of its windows) is met again: all repeated.
3. What is left, with one run of each class of 2 for all of it, is sorted: a block of
   whole buckets at a time, in the order of bytes, ties beyond the first 32 resolved by
   the ranks of a difference cover's samples (difference_cover.py). A repeat has an
   equal neighbour in that order.
4. Buckets over BUCKET bytes aren't gathered in a task. They are counted instead, in
   ranges of 12 windows (unique if the bytes common to the range are; repeated if the
   region of the range is met again), then, at the edges of repeats, in single windows.

So a passage that a third of all documents share costs no more than others. Memory is
one text's or one block's (BLOCK bytes and one bucket more), whatever the input.
Steps 1, 2 and 4 hold 64-bit hashes equal where bytes are; step 3 compares bytes.

Defined results. Null text: empty. Shorter than 200 bytes: nothing removed. Rows
that share doc_id and text are separate documents, and so repeat each other.
Strings never cross documents and are judged on the input. `without_repeats` returns
text: bytes of a character that a removal has cut go with it. Extra columns are kept
by it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.byte_windows import Rolling, anchors
from quire.llm.common import text_batches, texts
from quire.llm.difference_cover import repeated
from quire.staging import stage

WINDOW = 200
GRAM = 64
RANGE = 12
#: Bytes that are sorted at a time, and the most that one bucket may bring.
BLOCK = 1 << 19
BUCKET = 1 << 17
#: Bytes that a worker hands over at a time.
BATCH = 8 << 20


def _sorted_block(rows: list[tuple[int, int, bytes]], window: int) -> pa.RecordBatch:
    """(key, run, bytes) of whole buckets -> (key, start, end) of their windows that are met again."""
    data = np.frombuffer(b"".join(x for _, _, x in rows), np.uint8)
    size = np.array([len(x) for _, _, x in rows])
    base = np.cumsum(size) - size
    windows = size - window + 1
    row = np.repeat(np.arange(len(rows)), windows)
    starts = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + base[row]
    again = np.sort(repeated(data, starts, window))
    of = np.searchsorted(base, again, "right") - 1
    key, run = (np.array([r[k] for r in rows], np.int64)[of] for k in (0, 1))
    first = (run >> 16) - (run >> 8 & 255) + again - base[of]
    # Neighbouring windows of a run are one span.
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (again[1:] != again[:-1] + 1)]) if len(of) else np.empty(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(of)) - 1 if len(at) else at
    return pa.RecordBatch.from_arrays([_long(key[at]), _long(first[at]), _long(first[last] + window)], names=["key", "start", "end"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row in `__key`, staged, so that the numbers stay."""
    text_batches(docs.sparkSession)
    return stage(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One hash of several columns."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    return h


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _runs(text: bytes, window: int, gram: int):
    data = np.frombuffer(text, np.uint8)
    if len(data) < window:
        return None
    r = Rolling(data)
    place, first, last, g = anchors(r, len(data), window, gram)
    return place, first, last, g, r.some(first, last + window)


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """From rows(__key, doc_id, text): (key, spans) of those with repeats, spans an array of (start, end) in bytes; and (key, doc_id, packed text) of all."""
    if gram >= window or window - gram > 255:
        raise ValueError("gram must be shorter than window, by at most 255 bytes")
    rows = rows.select(F.col("__key").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for t in texts(b) if (x := _runs(t, window, gram))]
            g, region = (np.concatenate([x[k] for x in got]) if got else np.empty(0, np.uint64) for k in (3, 4))
            order = np.argsort(g, kind="stable")
            g, region = g[order], region[order].view(np.int64)
            at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
            least, most = (f.reduceat(region, at) if len(at) else region for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([_long(g[at]), _long(np.diff(np.append(at, len(g)))), _long(least), _long(most)], names=["gram", "c", "least", "most"])

    met = rows.select("text").mapInArrow(grams, "gram long, c long, least long, most long").groupBy("gram").agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    again = stage(met.where("c > 1").select("gram", (F.col("least") != F.col("most")).alias("mixed")), "grams")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            for key, t in zip(keys, texts(b)):
                if x := _runs(t, window, gram):
                    place, first, last, g, region = x
                    run = place << 16 | (place - first) << 8 | (place - last)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), key), pa.int64()), _long(run), _long(g), _long(region)], names=["key", "run", "gram", "region"])

    runs = stage(rows.select("key", "text").mapInArrow(every, "key long, run long, gram long, region long").join(again, "gram"), "runs")
    classes = runs.where("mixed").groupBy("gram", "region").agg(F.count("*").alias("c"), F.min(F.struct("key", "run")).alias("one")).where("c > 1")
    whole = stage(classes.select("gram", "region", "one", F.lit(True).alias("whole")), "classes")
    mixed = stage(runs.where("mixed").join(whole.drop("one"), ["gram", "region"], "left").select("key", "run", "gram", F.coalesce("whole", F.lit(False)).alias("whole")), "mixed")

    place = F.shiftright("run", 16)
    first, last = place - F.shiftright("run", 8).bitwiseAND(F.lit(255)), place - F.col("run").bitwiseAND(F.lit(255))
    span = [first.alias("start"), (last + window).alias("end")]
    certain = runs.where("not mixed").select("key", *span).unionByName(mixed.where("whole").select("key", *span))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(t) for t in texts(b)], pa.binary())], names=["key", "doc_id", "packed"])

    packed = rows.mapInArrow(pack, "key long, doc_id long, packed binary")

    # Of the runs that are neither, and of one run of each class that is met again: the bytes around each.
    left = stage(mixed.where("not whole").select("key", "run", "gram").unionByName(whole.select("one.key", "one.run", "gram")), "left")
    length = F.shiftright("run", 8).bitwiseAND(F.lit(255)) - F.col("run").bitwiseAND(F.lit(255)) + window
    crowded = stage(left.groupBy("gram").agg(F.sum(length).alias("n")).where(F.col("n") > bucket).select("gram", F.lit(True).alias("crowded")), "crowded")
    unsettled = left.join(crowded, "gram", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    edges = unsettled.groupBy("key").agg(F.collect_set(F.struct("run", "gram", "crowded")).alias("runs"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        def made(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())], names=["key", "run", "gram", "crowded", "bytes"])

        out, size = [[], [], [], [], []], 0
        for b in batches:
            for key, data, runs_ in zip(*(b.column(k).to_pylist() for k in ("key", "packed", "runs"))):
                text = z.decompress(data)
                for r in runs_:
                    run = r["run"]
                    at = run >> 16
                    part = text[at - (run >> 8 & 255) : at - (run & 255) + window]
                    for column, x in zip(out, (key, run, r["gram"], r["crowded"], part)):
                        column.append(x)
                    size += len(part)
                    if size >= BATCH:
                        yield made(out)
                        out, size = [[], [], [], [], []], 0
        yield made(out)

    around_all = stage(packed.join(edges, "key").select("key", "packed", "runs").mapInArrow(around, "key long, run long, gram long, crowded boolean, bytes binary"), "edges")

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, size, gram_ = [], 0, None
        for b in batches:
            for key, run, g, data in zip(*(c.to_pylist() for c in b.columns)):
                if g != gram_ and size >= BLOCK:
                    yield _sorted_block(rows_, window)
                    rows_, size = [], 0
                rows_.append((key, run, data))
                size, gram_ = size + len(data), g
        if rows_:
            yield _sorted_block(rows_, window)

    buckets = around_all.where("not crowded").select("key", "run", "gram", "bytes").repartition("gram").sortWithinPartitions("gram")
    by_order = buckets.mapInArrow(sort_buckets, "key long, start long, end long")
    certain = certain.unionByName(by_order.select("key", F.col("start").cast(certain.schema["start"].dataType).alias("start"), F.col("end").cast(certain.schema["end"].dataType).alias("end")))
    if not crowded.isEmpty():
        certain = certain.unionByName(_counted(around_all.where("crowded").select("key", "run", "gram", "bytes"), window))
    spans = certain.groupBy("key").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans"))
    return spans, packed


def _counted(near: DataFrame, window: int) -> DataFrame:
    """(key, start, end) of the repeats in crowded buckets, by counts alone: nothing of a bucket is gathered."""
    place = F.shiftright("run", 16)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for key, run, g, data in zip(*(c.to_pylist() for c in b.columns)):
                far, close = run >> 8 & 255, run & 255
                q = np.arange(close // RANGE, far // RANGE + 1)
                # Windows are counted by their distance before the anchor: q covers [q * RANGE, (q + 1) * RANGE).
                a, z = np.minimum(far, q * RANGE + RANGE - 1), np.maximum(close, q * RANGE)
                core_from, core_to = far - q * RANGE, far - (q * RANGE + RANGE - 1) + window
                r = Rolling(np.frombuffer(data, np.uint8))
                # The bytes common to the range, as far as they lie in every one of its windows.
                lo, hi = np.maximum(0, core_from), np.minimum(len(data), core_to)
                cut = (lo != core_from) | (hi != core_to)
                core = np.where(cut, np.uint64(0), r.some(np.where(cut, 0, lo), np.where(cut, 0, hi)))
                full = (a == q * RANGE + RANGE - 1) & (z == q * RANGE)
                region = np.where(full, r.some(far - a, far - z + window), np.uint64(0))
                gram_ = np.full(len(q), g, np.int64).view(np.uint64)
                out[0].append(np.full(len(q), key))
                out[1].append(np.full(len(q), run))
                out[2].append(q)
                out[3].append(_mix(gram_, q, core))
                out[4].append(np.where(full, _mix(gram_, q, region, core), np.uint64(0)))
            columns = [_long(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "run", "q", "core", "region"])

    level = stage(near.mapInArrow(ranges, "key long, run long, q long, core long, region long"), "ranges")
    cores = level.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
    regions = stage(level.where("region <> 0").groupBy("region").agg(F.count("*").alias("c"), F.min(F.struct("key", "run", "q")).alias("one")).where("c > 1").select("region", "one", F.lit(True).alias("same")), "regions")
    open_ = stage(level.join(cores, "core").join(regions.drop("one"), "region", "left"), "open")
    by_range = open_.where("same").select("key", (place - F.col("q") * RANGE - (RANGE - 1)).alias("start"), (place - F.col("q") * RANGE + window).alias("end"))

    # One range of each class that is met again stands for it among the single windows.
    left = open_.where("same is null").select("key", "run", "q").unionByName(regions.select("one.*")).groupBy("key", "run").agg(F.collect_set("q").alias("qs"))

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for key, run, g, data, qs in zip(*(b.column(k).to_pylist() for k in ("key", "run", "gram", "bytes", "qs"))):
                far, close = run >> 8 & 255, run & 255
                d = (np.asarray(sorted(qs))[:, None] * RANGE + np.arange(RANGE)).ravel()
                d = d[(d >= close) & (d <= far)]
                r = Rolling(np.frombuffer(data, np.uint8))
                out[0].append(np.full(len(d), key))
                out[1].append((run >> 16) - d)
                out[2].append(_mix(np.full(len(d), g, np.int64).view(np.uint64), d, r.some(far - d, far - d + window)))
            columns = [_long(np.concatenate(x)) if x else pa.array([], pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "hash"])

    one = stage(near.join(left, ["key", "run"]).mapInArrow(singles, "key long, start long, hash long"), "singles")
    twice = one.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    by_window = one.join(twice, "hash").select("key", "start", (F.col("start") + window).alias("end"))

    return by_range.unionByName(by_window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, z in spans:
        parts.append(text[at:a])
        at = z
    return b"".join([*parts, text[at:]])


def _resolved(rows: DataFrame, row: Callable[[bytes, list], tuple], types: list[tuple[str, pa.DataType, str]], window: int, gram: int, bucket: int) -> DataFrame:
    spans, packed = repeated_spans(rows, window, gram, bucket)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for b in batches:
            got = [row(z.decompress(t), merged([(x["start"], x["end"]) for x in s or ()])) for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            columns = zip(*got) if got else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, (_, t, _) in zip(columns, types))], names=["key", "doc_id", *(n for n, *_ in types)])

    joined = packed.join(spans, "key", "left").select("key", "doc_id", "packed", "spans")
    return joined.mapInArrow(finish, "key long, doc_id long, " + ", ".join(f"{n} {sql}" for n, _, sql in types))


def dedup_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def row(text: bytes, spans: list) -> tuple:
        return len(text), sum(z - a for a, z in spans), len(spans), hashlib.sha256(_rest(text, spans)).hexdigest()

    return _resolved(keyed(docs.select("doc_id", "text")), row, [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")], window, gram, bucket).drop("key")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """docs with what is left of each text; a null text stays null. Columns and their order are those of docs."""
    rows = keyed(docs)
    left = _resolved(rows, lambda t, s: (_rest(t, s).decode(errors="ignore") if s else t.decode(),), [("__rest", pa.string(), "string")], window, gram, bucket)
    left = left.select(F.col("key").alias("__key"), "__rest")
    others = rows.select(*[c for c in docs.columns if c != "text"], F.col("text").isNull().alias("__null"), "__key")
    return others.join(left, "__key").withColumn("text", F.when(~F.col("__null"), F.col("__rest"))).select(*docs.columns)
