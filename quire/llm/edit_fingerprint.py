"""Operator 8: document fingerprints by a randomised edit embedding.

A walk reads a text and writes a longer string: at step j it writes the present
character c and then, by a shared random bit r(j, c), stays or moves on. Two
texts walk together as long as they agree, and drift back together after an
edit, so edit distance becomes Hamming distance between what is written. The
bits repeat with a period of 256 steps; a character met at step j then leaves
after a wait that is looked up, and so does a run of three: each distinct run's
waits for all 256 phases are computed once a worker, and a text is walked three
characters at a time.

A fingerprint keeps the characters written at sampled steps. The steps are those
with the smallest hashes below three times the length, so texts of like length
sample mostly the same steps. It reads "<code points>:<a byte a step, in hex>",
steps ascending. Likeness is the share of equal bytes over the steps that the
longer walk would sample; steps beyond a text's end are unequal.

Near pairs: bands of sampled steps are taken at the text's start and from walks
that start anew at places chosen by content over the whole text, the grams with
the least hashes; so an edit anywhere leaves the bands elsewhere as they are, at
any length. Short texts are keyed by all their grams, as long as a near pair must
share one. Bands hold within a length class; a text is banded in its own and in
those of a shorter partner. Texts that share a band are compared by their edit
distance, whatever the number of texts in it: those that more than `crowd` texts
share are dealt in cells, where a bound on the edit distance from counts of grams,
which no near pair fails, rules pairs out before they become rows.

Defined results. Null text: empty; its fingerprint is "0:" and its likeness to
another empty one 1, to any other 0. Ties in doc_id are ordered by text. A single
document is its own next one. Repeated rows have equal fingerprints. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import mixed
from quire.staging import stage

PERIOD = 256
SAMPLES = 128
_CACHE = 200_000
_RUNS = re.compile(".{1,3}", re.S)


@lru_cache(maxsize=None)
def _waits() -> np.ndarray:
    """waits[c, j]: steps that a character of class c, met at phase j, is written. From the bits r(j, c)."""
    bits = np.random.default_rng(20_011).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1  # no character waits for ever
    out = np.zeros((256, 2 * PERIOD), np.uint16)
    wait = np.full(256, PERIOD, np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        wait = np.where(bits[:, j % PERIOD] == 1, 1, wait + 1)
        out[:, j] = wait
    return np.ascontiguousarray(out[:, :PERIOD])


def _classes(text: str) -> np.ndarray:
    """Each code point's class, 0 to 255: ASCII as it is, others folded."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, c, 128 + (c * np.uint32(2654435761) >> np.uint32(25))).astype(np.int64)


def _run_steps(classes: list[int]) -> bytes:
    """For each phase: the steps that a run of three takes; a wait is far below 85."""
    waits, at = _waits(), np.arange(PERIOD)
    for c in classes:
        at = at + waits[c][at % PERIOD]
    return bytes((at - np.arange(PERIOD)).tolist())


@lru_cache(maxsize=1)
def _wait_rows() -> list[list[int]]:
    return _waits().tolist()


@lru_cache(maxsize=None)
def _ranked(level: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps from 2**(level - 1) to 2**level (level 0: step 0) that can be sampled, by ascending hash: hashes and steps."""
    first, last = (1 << level) >> 1, 1 << level
    step = np.arange(first, last, dtype=np.uint64)
    h = (step + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    best = np.argpartition(h, SAMPLES - 1)[:SAMPLES] if len(h) > SAMPLES else np.arange(len(h))
    best = best[np.argsort(h[best])]
    return h[best], step[best].astype(np.int64)


@lru_cache(maxsize=50_000)
def steps_of(n: int) -> np.ndarray:
    """The steps sampled for a text of n code points, ascending: those of least hash below 3 n.

    The last level is cut at 3 n, where its kept steps can fall short; then all its steps are hashed.
    """
    end = 3 * n
    if end <= SAMPLES:
        return np.arange(end)
    top = (end - 1).bit_length()
    hs, ss = zip(*(_ranked(k) for k in range(top)))
    step = np.arange((1 << top) >> 1, end, dtype=np.uint64)
    h = (step + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h, s = np.concatenate([*hs, h]), np.concatenate([*ss, step.astype(np.int64)])
    return np.sort(s[np.argpartition(h, SAMPLES - 1)[:SAMPLES]])


class Walker:
    """Fingerprints of texts; the runs that are kept are bounded."""

    def __init__(self):
        self._steps: dict[str, bytes] = {}
        self._classes: dict[str, list[int]] = {}

    def _learn(self, run: str) -> bytes:
        if len(self._steps) >= _CACHE:
            self._steps.clear()
            self._classes.clear()
        self._classes[run] = c = _classes(run).tolist()
        self._steps[run] = got = _run_steps(c)
        return got

    def written(self, text: str, steps: np.ndarray) -> np.ndarray:
        """The classes written at the given steps, ascending; 255 after the end."""
        runs = _RUNS.findall(text)
        known, ends, at = self._steps, [], 0
        for r in runs:
            got = known.get(r)
            if got is None:
                got = self._learn(r)
            at += got[at & 255]
            ends.append(at)
        out, waits = bytearray(b"\xff" * len(steps)), _wait_rows()
        where = np.searchsorted(np.asarray(ends, np.int64), steps, side="right").tolist()
        for k, (w, step) in enumerate(zip(where, steps.tolist())):
            if w >= len(runs):
                break
            codes = self._classes.get(runs[w]) or _classes(runs[w]).tolist()
            i, leaves = 0, ends[w - 1] if w else 0
            while True:
                leaves += waits[codes[i]][leaves & 255]
                if leaves > step:
                    break
                i += 1
            out[k] = codes[i]
        return np.frombuffer(bytes(out), np.uint8)

    def fingerprint(self, text: str) -> str:
        return f"{len(text)}:{self.written(text, steps_of(len(text))).tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Share of equal bytes over the steps sampled by both, of those that either text's walk must cover: 0 to 1."""
    if a == b:
        return 1.0
    (n, x), (m, y) = ((int(n), np.frombuffer(bytes.fromhex(x), np.uint8)) for n, x in (a.split(":"), b.split(":")))
    if not n or not m:
        return 0.0
    if n < m:
        n, m, x, y = m, n, y, x
    # Of the longer one's steps below 3 m, the shorter one has all: its bound takes in no larger hashes.
    long, short = steps_of(n), steps_of(m)
    both, at, to = np.intersect1d(long, short, assume_unique=True, return_indices=True)
    return float(((x[at] == y[to]) & (x[at] != 255)).sum() / max(1, (x != 255).sum(), (y[to] != 255).sum()))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NULL_ID = -(1 << 63)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and likeness to that and to the next document.

    The next document is the one before it in doc_id; the first one's next is the last.
    Each partition of the sorted rows also hands out its first and its last text, one row
    each, so that neighbours across partitions meet.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id").desc(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(w: Walker, doc_id: int, text: str, fp: str, following: str, fp_next: str) -> tuple:
        changed = edited(text, following)
        fp_changed = fp if changed == text else w.fingerprint(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp, fp_changed, likeness(fp, fp_changed), likeness(fp, fp_next)

    def batch_of(found: list[tuple]) -> list[pa.Array]:
        columns = list(zip(*found)) if found else [()] * 7
        types = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
        return [pa.array(c, t) for c, t in zip(columns, types)]

    names = [x.split()[0] for x in _OUT.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, w, last, first = TaskContext.get().partitionId(), Walker(), None, None

        def rows_of(found, edge):
            n = len(found)
            return pa.RecordBatch.from_arrays([*batch_of(found), pa.array([part] * n, pa.int32()), pa.array([None] * n if not edge else edge[0], pa.string()), pa.array([None] * n if not edge else edge[1], pa.string())], names=[*names, "part", "first_text", "last_text"])

        for b in batches:
            found = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fp = w.fingerprint(text)
                if last is None:
                    first = text
                else:
                    found.append(compare(w, *last, text, fp))
                last = (doc_id, text, fp)
            if found:
                yield rows_of(found, None)
        if last is not None:
            yield rows_of([(last[0], len(last[1]), None, last[2], None, None, None)], ([first], [last[1]]))

    raw = stage(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text").mapInArrow(walk, f"{_OUT}, part int, first_text string, last_text string"), "walks")
    edges = raw.where("last_text is not null").select("doc_id", "fingerprint", "part", "first_text", "last_text")
    # Two texts a partition: as many rows as partitions. Each meets the next partition that has rows.
    order = edges.select("part").distinct().collect()
    ids = sorted(r["part"] for r in order)
    follows = spark.createDataFrame([(p, ids[(i + 1) % len(ids)]) for i, p in enumerate(ids)], "part int, following int")
    heads = edges.select(F.col("part").alias("following"), F.col("first_text").alias("head"))
    met = edges.join(F.broadcast(follows), "part").join(heads, "following").select("doc_id", "last_text", "fingerprint", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Walker()
        for b in batches:
            found = [compare(w, d, t, fp, head, w.fingerprint(head)) for d, t, fp, head in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays(batch_of(found), names=names)

    out = raw.where("last_text is null").select(*names).unionByName(met.mapInArrow(finish, _OUT))
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL_ID)))


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance if it is at most `most`, else most + 1; one diagonal band of numpy steps a distance (furthest-reaching)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))

    def slide(i: int, k: int) -> int:
        j, size = i - k, 64
        while i < len(x) and j < len(y):
            p, q = x[i : i + size], y[j : j + size]
            n = min(len(p), len(q))
            diff = np.flatnonzero(p[:n] != q[:n])
            if len(diff):
                return i + int(diff[0])
            i, j, size = i + n, j + n, min(size * 4, 1 << 16)
        return i

    goal = len(x) - len(y)
    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(goal, -1) >= len(x):
            return d
        nxt = {}
        for k in range(-d - 1, d + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            if i >= 0 and i - k >= 0:
                nxt[k] = slide(min(i, len(x), len(y) + k), k)
        reach = nxt
    return most + 1


_GRAM, _WINDOW, _SHORT = 6, 32, 128
_COUNTED, _BINS, _ROWS = 4, 4096, 512


@lru_cache(maxsize=1)
def _class_starts() -> list[int]:
    """Least length of each class: each integer at first, then steps of a fifth."""
    out = [1, 2, 3, 4, 5]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 6 // 5)
    return out


def classes_of(n: int, share: float) -> list[int]:
    """The length classes in which a text of n code points is banded: its own and those of a shorter near partner.

    A partner has n (1 - share) code points or more, so two near texts are both banded in the shorter one's class.
    """
    own = bisect_right(_class_starts(), n) - 1
    low = own
    while low and n * (1 - share) < _class_starts()[low]:
        low -= 1
    return list(range(low, own + 1))


def places_of(text: str, n: int) -> list[int]:
    """n places in the text, each that of the gram with the least of one of n hashes: equal grams, equal choice."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = min(_GRAM, len(c))
    h = np.zeros(len(c) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - size + 1 + k]
    salts = np.random.default_rng(20_012).integers(0, 1 << 64, n, dtype=np.uint64)
    return [int(mixed(h ^ x).argmin()) for x in salts]


def bands_of(w: Walker, text: str, bands: int, width: int) -> list[np.ndarray]:
    """The bytes of 2 * bands bands: at the start of the text, then from `bands` places over all of it."""
    anchors = steps_of(64)[:: max(1, len(steps_of(64)) // (bands * width))][: bands * width]
    steps = np.arange(width) * max(_WINDOW, width) // width
    start = w.written(text, anchors)
    return [*(start[k * width : (k + 1) * width] for k in range(bands)), *(w.written(text[p : p + max(_WINDOW, width)], steps) for p in places_of(text, bands))]


@lru_cache(maxsize=None)
def unedited(c: int, share: float) -> int:
    """The longest run that any near pair of class c has in common at least: d edits leave d + 1 runs; 0 if no pair can be near."""
    starts = _class_starts()
    ns = range(starts[c], int((starts[c + 1] - 1) / (1 - share)) + 2)
    return min((-((d - n) // (d + 1)) for n in ns if (d := int(share * n))), default=0)


def keys_of(w: Walker, text: str, share: float, bands: int, width: int) -> list[str]:
    """What a text is found by."""
    out, got = [], None
    for c in classes_of(len(text), share):
        if _class_starts()[c] < _SHORT:
            if size := unedited(c, share):
                out += [f"{c}::{g}" for g in {text[i : i + size] for i in range(len(text) - size + 1)}]
            continue
        got = got or [x.tobytes().hex() for x in bands_of(w, text, bands, width)]
        out += [f"{c}:{k}:{x}" for k, x in enumerate(got)]
    return out


def grams(text: str) -> np.ndarray:
    """A hash of each gram of four code points, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < _COUNTED:
        return np.empty(0, np.uint64)
    h = np.zeros(len(c) - _COUNTED + 1, np.uint64)
    for k in range(_COUNTED):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : len(c) - _COUNTED + 1 + k]
    return mixed(h)


def counted(text: str) -> np.ndarray:
    """Grams of the text by bin, at most 255 a bin; an edit changes at most 2 * _COUNTED of the counts by one."""
    return np.minimum(np.bincount((grams(text) % np.uint64(_BINS)).astype(np.int64), minlength=_BINS), 255).astype(np.uint8)


def apart(x: str, y: str, most: int) -> bool:
    """True only if the texts' counts of grams differ by more than `most` edits can make."""
    both, at = np.unique(np.concatenate([g := grams(x), h := grams(y)]), return_inverse=True)
    return int(np.abs(np.bincount(at, np.repeat([1, -1], [len(g), len(h)]), len(both))).sum()) > 2 * _COUNTED * most


def close_in_cell(rows: list[tuple], share: float) -> list[tuple[int, int]]:
    """Pairs of a cell's rows (doc_id, text, level, salt) that are its own and that lengths and counts don't rule out.

    Own: the lower level of the two is the cell's, and their salts are its two.
    """
    cell, rows = rows[0][4:], [r[:4] for r in rows]
    ids, level, salt = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3))
    n = np.array([len(r[1]) for r in rows], np.int64)
    counts = np.stack([counted(r[1]) for r in rows])
    low, i, j = cell
    out = []
    for k in range(len(rows)):
        most = (share * np.maximum(n[k], n)).astype(np.int64)
        ok = (np.minimum(level[k], level) == low) & (ids[k] < ids) & (np.abs(n[k] - n) <= most)
        ok &= (np.minimum(salt[k], salt) == i) & (np.maximum(salt[k], salt) == j)
        at = np.flatnonzero(ok)
        for s in range(0, len(at), _ROWS):
            part = at[s : s + _ROWS]
            gap = np.abs(counts[part].astype(np.int16) - counts[k]).sum(1, dtype=np.int64)
            out += [(int(ids[k]), int(d)) for d in ids[part[gap <= 2 * _COUNTED * most[part]]]]
    return out


def near_pairs(docs: DataFrame, share: float = 0.1, bands: int = 16, width: int = 4, crowd: int = 1000) -> DataFrame:
    """Pairs of distinct texts within `share` edits of the longer one's length: (a, b, distance), a < b by doc_id.

    A pair is compared if it shares one of 2 * `bands` bands of `width` steps: half lie at the texts'
    starts, half at places chosen by content over the whole texts. That is a drawing, so a pair can be
    missed, with edits all over it most likely (README has measured shares); pairs of texts below 128
    code points share a gram and none is missed. `share` is below 1. Equal texts are one class,
    represented by the least doc_id. `crowd` sets how a band's texts are compared, not which: up to it
    by a join, beyond it in cells of about so many texts by length and salt. A cell costs its pairs in
    vector operations, so a crowded band's work still grows with the square of the texts of like length.
    """
    classes = docs.where(F.length("text") > 0).groupBy("text").agg(F.min("doc_id").alias("doc_id"))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Walker()
        for b in batches:
            ids, keys = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                found = keys_of(w, text, share, bands, width)
                ids += [doc_id] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["doc_id", "band"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found = []
            for band, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (band, *row[4:]) != key:
                    found += close_in_cell(rows, share) if rows else []
                    key, rows = (band, *row[4:]), []
                rows.append(tuple(row))
            yield pairs_of(found)
        yield pairs_of(close_in_cell(rows, share) if rows else [])

    def pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [(), ()])], names=["a", "b"])

    keyed = stage(classes.select("doc_id", "text").mapInArrow(banded, "doc_id long, band string"), "bands")
    sizes = stage(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    few, many = keyed.join(sizes.where(F.col("n") <= crowd), "band"), keyed.join(sizes.where(F.col("n") > crowd), "band")
    a, b = few.select(F.col("doc_id").alias("a"), "band"), few.select(F.col("doc_id").alias("b"), "band")
    # Near texts lie in the same level of lengths or in the next; the levels are a little wider than that asks for.
    level = F.floor(F.log(F.length("text")) / F.lit(math.log(1.01 / (1 - share))))
    placed = many.join(classes, "doc_id").select("band", "doc_id", "text", level.alias("level"), F.ceil(F.col("n") / crowd).alias("salts"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    cells = placed.withColumn("low", F.explode(F.array(F.col("level") - 1, F.col("level")))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    cells = cells.select("band", "doc_id", "text", "level", "salt", "low", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "band", "low", "i", "j").sortWithinPartitions("band", "low", "i", "j")
    pairs = a.join(b, "band").where("a < b").select("a", "b").unionByName(cells.mapInArrow(compare, "a long, b long")).distinct()
    t = classes.select("doc_id", "text")
    both = pairs.join(t.toDF("a", "x"), "a").join(t.toDF("b", "y"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, q, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "x", "y"))):
                most = int(share * max(len(x), len(y)))
                if not apart(x, y, most) and (d := edit_distance(x, y, most)) <= most:
                    found.append((p, q, d))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [(), (), ()])], names=["a", "b", "distance"])

    return both.mapInArrow(verify, "a long, b long, distance long")
