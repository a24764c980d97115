"""Operator 6: SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the places of a text. A place is reached by the pieces that
end there, so only the last `longest` places can still be left by a piece: that
window is all that is kept. Each place holds one backpointer; when the paths of
all places of the window run through one boundary, what lies before it is final,
its ids are given out and it is forgotten: `stream` takes characters one at a time and
keeps the window, whatever the length of what it reads.

What makes a path best depends on the model. Unigram: the largest sum of scores.
BPE, the kind of the public model: the path on which every two neighbours are what
merging by rank makes of the two together; exactly one such path ends at each place,
and it is the model's own segmentation.

Between two characters that stand side by side in no piece, all paths converge, and so
they do before a space where no piece holds one after another character. Such places cut
a text into segments, mostly words; `encode`, which has the whole text in its row anyway,
streams each segment that it hasn't met and looks up the others.

Defined results. Null or empty text: no ids, decoded as empty. A character outside the
vocabulary: its UTF-8 bytes, if the model has byte pieces, else the unknown id. Text
that holds the escape character U+2581 itself comes back with spaces, as in the library.
Repeated rows give equal ids. Extra columns pass through `encode` and `decode`; one named
like the result is renamed in_<name>. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
_CACHE = 500_000
_PAIRS = 1_000_000
_KEPT = 48


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """A SentencePiece model file, and its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[str] = []
        self.unknown, self.kind, self.dummy, self.squeeze, self.charsmap = 0, 1, True, True, b""
        byte_of = {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, type_ = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        (score,) = struct.unpack("<f", v)
                    elif k == 3:
                        type_ = v
                i = len(self.text)
                self.text.append(piece if type_ in (1, 4) else "")
                if type_ == 1:
                    self.score[piece], self.id[piece] = score, i
                elif type_ == 2:
                    self.unknown = i
                elif type_ == 6:
                    self.byte_id[int(piece[3:5], 16)] = i
                    byte_of[i] = int(piece[3:5], 16)
            elif number == 2:
                self.kind = next((v for k, v in _fields(value) if k == 3), 1)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy, self.squeeze, self.charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if self.kind not in (1, 2):
            raise ValueError("a unigram or a BPE model is needed")
        if self.charsmap or self.squeeze:
            raise ValueError("only models that leave the text as it is are read")
        self.longest = max(map(len, self.score), default=1)
        #: Every end of a piece: a text that ends in none of them ends in no piece either.
        self._ends = {p[k:] for p in self.score for k in range(len(p))}
        self._beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self._by_word = not any(p[1] == SPACE != p[0] for p in self._beside)
        self._least = min(self.score.values(), default=0.0) - 10
        self._byte_of = byte_of
        self._pair: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by rank: the neighbours whose union scores best are joined, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging the two together leaves just the two; left may be empty."""
        got = self._pair.get((left, right))
        if got is None:
            if len(self._pair) >= _PAIRS:
                self._pair.clear()
            got = self._pair[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def stream(self, chars) -> Iterator[str]:
        """The best path's pieces for an iterable of characters, given out as soon as they are final."""
        window, first = "", 0  # characters from place `first` on
        back, best = {0: 0}, {0: 0.0}
        last = {0: ""}
        place = 0
        scores, ends = self.score, self._ends
        for c in chars:
            window += c
            place += 1
            chosen = None
            for start in range(place - 1, max(first, place - self.longest) - 1, -1):
                piece = window[start - first :]
                score = scores.get(piece)
                if score is None:
                    if place - start > 1:
                        if piece not in ends:
                            break
                        continue
                    score = self._least
                if self.kind == 1:
                    # Of equal sums the one with the longest last piece.
                    if chosen is None or best[start] + score >= best[place]:
                        chosen, best[place] = start, best[start] + score
                elif self._fits(last[start], piece):
                    chosen = start
                    break
                if piece not in ends:
                    break
            back[place], last[place] = chosen, window[chosen - first :]
            if place - first >= 2 * self.longest:
                done = self._common(back, first, place)
                if done > first:
                    yield from self._path(back, last, first, done)
                    window = window[done - first :]
                    for table in (back, best, last):
                        for k in [k for k in table if k < done]:
                            del table[k]
                    if self.kind == 1:
                        base = best[done]
                        for k in best:
                            best[k] -= base
                    first = done
        yield from self._path(back, last, first, place)

    def _common(self, back: dict[int, int], first: int, place: int) -> int:
        """The last boundary that the paths of all places of the window run through."""
        live = {p for p in range(place - self.longest + 1, place + 1)}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top])
            if min(live) <= first:
                return first
        return live.pop()

    @staticmethod
    def _path(back: dict[int, int], last: dict[int, str], first: int, place: int) -> list[str]:
        out = []
        while place > first:
            out.append(last[place])
            place = back[place]
        return out[::-1]

    def _ids_of(self, pieces) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return np.asarray(out, "<u4").tobytes()

    def _segment(self, text: str) -> bytes:
        out = self._new.get(text)
        if out is None:
            out = self._old.get(text)
            if out is None:
                beside = self._beside
                cut = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in beside]
                if cut:
                    return b"".join(self._segment(text[a:z]) for a, z in zip([0, *cut], [*cut, len(text)]))
                out = self._ids_of(self.stream(text))
            if len(text) <= _KEPT:
                if len(self._new) >= _CACHE:
                    self._old, self._new = self._new, {}
                self._new[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian u32."""
        if not text:
            return b""
        if self._by_word and self.dummy and SPACE not in text:
            # Each word with the space before it; where spaces stand in a row they belong together.
            words = text.split(" ")
            if "" not in words:
                found = list(map(self._words.get, words))
                if None in found:
                    found = [self._word(w) if x is None else x for w, x in zip(words, found)]
                return b"".join(found)
        escaped = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        return b"".join(map(self._segment, _WORDS.findall(escaped) if self._by_word else [escaped]))

    def _word(self, word: str) -> bytes:
        out = self._segment(SPACE + word)
        if len(word) < _KEPT:
            if len(self._words) >= _CACHE // 2:
                self._words.clear()
            self._words[word] = out
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        texts, byte_of = self.text, self._byte_of
        if byte_of and not byte_of.keys().isdisjoint(numbers):
            out = bytearray()
            for i in numbers:
                b = byte_of.get(i)
                if b is None:
                    out += texts[i].encode()
                else:
                    out.append(b)
            text = out.decode(errors="replace")
        else:
            text = "".join(map(texts.__getitem__, numbers))
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_loaded: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs plus the ids of a text column, as little-endian u32 bytes."""
    from pyspark.sql.types import BinaryType, StructType

    docs = docs.withColumnsRenamed({out: f"in_{out}"} if out in docs.columns else {})
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.encode(t or "") for t in b.column(at).to_pylist()], pa.binary())], names=[*names, out])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(out, BinaryType()))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows plus the text of a column of ids; null ids give empty text."""
    from pyspark.sql.types import StringType, StructType

    rows = rows.withColumnsRenamed({out: f"in_{out}"} if out in rows.columns else {})
    names, at = rows.columns, rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.decode(x or b"") for x in b.column(at).to_pylist()], pa.string())], names=[*names, out])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add(out, StringType()))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: doc_id, n_ids, ids_crc32, n_chars decoded, and whether the decoded text is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(1).to_pylist():
                ids = m.encode(t or "")
                back = m.decode(ids)
                for column, x in zip(out, (len(ids) // 4, zlib.crc32(ids), len(back), back == (t or ""))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_ids", "ids_crc32", "n_chars", "same"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, same boolean")
