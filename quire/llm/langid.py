"""Operator 3: hierarchical language identification.

Languages are grouped into families by the likeness of their letter n-gram
profiles (average linkage, learned from the sample). A family is predicted
first; within it, one linear support vector machine for each pair of languages
votes. A text's score under a linear machine is the sum over its words, so each
distinct word is scored once a worker and looked up afterwards.

The machines are fitted on the driver on at most `per_language` documents of each
language (default 1500, chosen by a hash of doc_id and text among all labelled rows
that are given, equal rows once): 4 * 1500 vectors of 4096 floats are 100 MB. Prediction reads every
whole text and nothing but the text.

Defined results. A text that is null or has no letter: `und`, score 0. No
labelled row to learn from: `und` for all. A single language: that one. Repeated
rows get the same answer. Extra columns pass through `identify` untouched; those named
like its own are renamed in_<name>.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = 4096
MOST_LANGUAGES = 400
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE = 700_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-letter runs of words, ends marked: which word each belongs to, and its feature number."""
    w = np.frombuffer("".join(f"\x02{x}\x03" for x in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.cumsum(w == 2) - 1
    letter = np.flatnonzero((w != 2) & (w != 3))
    where, hashes = [of[letter]], [w[letter] * np.uint64(2654435761)]
    for n in (2, 3):
        if len(w) >= n:
            h = np.full(len(w) - n + 1, np.uint64(n))
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + w[k : len(w) - n + 1 + k]
            inside = of[: len(h)] == of[n - 1 :]
            where.append(of[: len(h)][inside])
            hashes.append(h[inside] * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(where), ((np.concatenate(hashes) >> np.uint64(17)) % np.uint64(FEATURES)).astype(np.int64)


def vector(text: str) -> np.ndarray:
    """The relative frequencies of a text's features."""
    words = _LETTERS.findall(text.lower())
    out = np.bincount(features(words)[1], minlength=FEATURES).astype(np.float32) if words else np.zeros(FEATURES, np.float32)
    return out / max(1.0, float(out.sum()))


def _machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge), fitted by accelerated gradient descent. y: +1 or -1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, pw, pb = np.zeros(x.shape[1], np.float32), np.float32(0), np.zeros(x.shape[1], np.float32), np.float32(0)
    step = np.float32(1.0 / (2 * float(np.einsum("i,ij,ij->", weight, x, x)) + 2.0 + penalty))
    for k in range(rounds):
        m = np.float32(k / (k + 3))
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb))
        g = -2 * weight * slack * y
        pw, pb = w, b
        w, b = vw - step * (g @ x + np.float32(penalty) * vw), vb - step * g.sum()
    return w, float(b)


@dataclass
class Model:
    families: list[list[str]]
    #: For each machine: the two sides (families' numbers, or languages), and its row in weights.
    between: list[tuple[int, int, int]]
    within: list[tuple[str, str, int]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, total: np.ndarray) -> tuple[str, float]:
        """Language and score from the machines' outputs for a text."""
        sides = 1 / (1 + np.exp(-2 * np.clip(total, -15, 15)))

        def vote(names, machines):
            got = {n: 0.0 for n in names}
            for a, b, k in machines:
                got[a] += sides[k]
                got[b] += 1 - sides[k]
            best = max(names, key=lambda n: (got[n], -names.index(n)))
            return best, got[best] / max(1, len(names) - 1) if len(names) > 1 else 1.0

        family, p = vote(list(range(len(self.families))), self.between)
        names = self.families[family]
        lang, q = vote(names, [m for m in self.within if m[0] in names])
        return lang, float(min(1.0, max(0.0, p * q)))


def group_families(centres: dict[str, np.ndarray]) -> list[list[str]]:
    """Average-linkage grouping of languages into about the square root of their number."""
    groups = [[k] for k in sorted(centres)]
    unit = {k: np.sqrt(v) / max(1e-9, float(np.linalg.norm(np.sqrt(v)))) for k, v in centres.items()}
    while len(groups) > max(1, round(len(centres) ** 0.5)):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: np.mean([unit[a] @ unit[b] for a in groups[p[0]] for b in groups[p[1]]]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """The families and machines for the rows of x."""
    if not langs:
        return None
    names = np.asarray(langs)
    families = group_families({k: x[names == k].mean(axis=0) for k in sorted(set(langs))})
    scale = np.float32(len(langs) ** 0.5 / max(1e-9, float(np.linalg.norm(x))))
    of = {k: i for i, f in enumerate(families) for k in f}
    place = np.asarray([of[k] for k in langs])
    between, within, weights, bias = [], [], [], []

    def add(at, a, b, kept, positive):
        w, c = _machine(x[kept] * scale, np.where(positive, 1, -1).astype(np.float32)[kept])
        at.append((a, b, len(weights)))
        weights.append(w * scale)
        bias.append(c)

    for a, b in combinations(range(len(families)), 2):
        add(between, a, b, (place == a) | (place == b), place == a)
    for f in families:
        for a, b in combinations(f, 2):
            add(within, a, b, (names == a) | (names == b), names == a)
    return Model(families, between, within, np.asarray(weights, np.float32).reshape(len(weights), x.shape[1]), np.asarray(bias, np.float32))


def train(labelled: DataFrame, per_language: int = 1500) -> Model | None:
    """Fit on rows(doc_id, text, lang) with lang not null: of each language those with the smallest hashes, about per_language at most."""
    # The languages are a few names, never rows: codes of the world's languages bound them.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} languages: the fit is bounded to {MOST_LANGUAGES}")
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    # A share first, then exactly per_language at most of what it leaves, by the same hash: rows that are copies count once.
    h = F.xxhash64("doc_id", "text")
    some = labelled.where(F.pmod(h, F.lit(1_000_000)) < F.least(F.lit(1.0), share * 2) * 1_000_000).select("lang", "text", h.alias("h"))
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    drawn = once.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= per_language).select("lang", "text", "h")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [vector(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "h", "v"])

    rows = drawn.mapInArrow(vectors, "lang string, h long, v binary").toArrow()
    # In one order whatever the partitions were; each vector is copied once, and the table goes before the fit.
    langs, v = np.asarray(rows.column("lang").to_pylist(), object), rows.column("v")
    order = np.lexsort((rows.column("h").to_numpy(), langs.astype(str)))
    x = np.empty((len(langs), FEATURES), np.float32)
    for i, k in enumerate(order.tolist()):
        x[i] = np.frombuffer(v[k].as_buffer(), np.float32)
    del rows, v
    return fit(x, langs[order].tolist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs plus lang_pred and score, from the text alone."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.withColumnsRenamed({c: f"in_{c}" for c in ("lang_pred", "score") if c in docs.columns})
    names, at = docs.columns, docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        width = len(model.bias) if model else 0
        table = np.zeros((0, width + 1), np.float32)

        def learn(words: set[str]) -> None:
            """Rows of machine outputs for words not met before."""
            nonlocal table
            if len(numbers) >= _CACHE:
                numbers.clear()
                table = table[:0]
            new = [w for w in words if w not in numbers]
            if not new:
                return
            where, f = features(new)
            rows = np.empty((len(new), width + 1), np.float32)
            for m in range(width):
                rows[:, m] = np.bincount(where, model.weights[m][f], len(new))
            rows[:, width] = np.bincount(where, minlength=len(new))
            numbers.update(zip(new, range(len(table), len(table) + len(new))))
            table = np.concatenate([table, rows])

        def one(words: list[str]) -> tuple[str, float]:
            if not words or model is None:
                return "und", 0.0
            total = table[np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            return model.decide(total[:-1] / total[-1] + model.bias)

        for b in batches:
            got = []
            texts = b.column(at).to_pylist()
            for k in range(0, len(texts), 500):
                found = [_LETTERS.findall(t.lower()) if t else [] for t in texts[k : k + 500]]
                if model is not None:
                    learn(set().union(*found))
                got += map(one, found)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def evaluate(docs: DataFrame, per_language: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the labelled rows that are not held out, applied to all."""
    model = train(docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), per_language)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
