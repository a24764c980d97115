"""Records from tolerant markup: a scanner that never raises, and the field chains over it.

Documents can be malformed, so the markup is scanned, not parsed: one walk over the
window lists its tags, and every field is read from that list. The limits are in bytes
of UTF-8. Missing values are NULL here; `published` writes the marker for them.

Defined results. Null path or text: empty, every field NULL but the sigla of the path.
Malformed markup: the fields that can be found. Empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import MISSING

WINDOW, HEADER, LANG_SPAN, CTH_SPAN, YEAR_SPAN = 16 * 1024, 8 * 1024, 12 * 1024, 4096, 2048
NO_NUMBER = (1 << 32) - 1

#: Elements that credit a person, best first. Fixed values.
ROLES = ("uebern", "trlst", "transliteration", "editor", "resp", "name", "kor1kf", "kor", "kor2", "annot", "author", "val", "format", "kolon", "cth")
_RANK = {r: i for i, r in enumerate(ROLES)}
#: Language codes folded into one, and those that are none. Fixed values.
FOLDED = {"Hitt": "Hit", "Hurr": "Hur", "Akkd": "Akk", "Hattian": "Hat"}
NO_LANGUAGE = ("ign", "5f_", "w")
AUTOMATIC = ("auto", "system", "hfr")

#: Elements whose date attribute stands in for a missing year, in any order. Fixed values.
DATED = ("creation-date", "aoxml-creation", "kor2", "kor1", "date")

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|\?.*?(?:\?>|\Z)|![^>]*(?:>|\Z)|(/)?([A-Za-z0-9:\-_.]*))", re.S)
_SPACE = " \t\n\x0c\r"
_ATTR = re.compile(r"[ \t\n\x0c\r]*([A-Za-z0-9:\-_.]*)[ \t\n\x0c\r=]*(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\n\x0c\r>]*))")
_STRIP = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<[^>]*>|<.*\Z", re.S)
_YEAR = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
_CTH = re.compile(r"cth[ \t\n\x0c\r]*([0-9][0-9.]*)", re.I | re.A)
#: The value is looked at, not stepped over: another code can stand inside it.
_LG = re.compile(r"(?<![\w\-:.])lg=(?=\"([^\"]*)\"|'([^']*)')")


def cut(text: str, most: int) -> str:
    """The first `most` bytes of text, without a character cut in two."""
    data = text.encode("utf-8", "replace")
    return text if len(data) <= most else data[:most].decode("utf-8", "ignore")


class Tag(NamedTuple):
    """A start or end tag. content: where its element's text begins, or -1 if the tag is never closed by >."""

    closing: bool
    local: str
    attributes: str
    at: int
    content: int


def tags(text: str) -> list[Tag]:
    """The tags outside comments, CDATA, instructions and declarations, in order; names in lower case without prefix.

    A tag without > still counts by its name. What stands between < and > is looked at again, as a
    broken tag can hold the next one.
    """
    out = []
    for m in _TAG.finditer(text):
        name = m[2]
        if name is None:
            continue
        local = name.partition(":")[2].lower() if ":" in name else name.lower()
        if m[1]:
            out.append(Tag(True, local, "", m.start(), -1))
        else:
            end = text.find(">", m.end())
            out.append(Tag(False, local, text[m.end() : end].lstrip(_SPACE) if end >= 0 else "", m.start(), end + 1 if end >= 0 else -1))
    return out


def start_tags(found: list[Tag]) -> Iterator[Tag]:
    """Start tags one after the other; those inside another's attributes are passed over, an unclosed one ends the walk."""
    upto = 0
    for t in found:
        if t.closing or t.at < upto:
            continue
        if t.content < 0:
            return
        upto = t.content
        yield t


def attribute(attrs: str, name: str) -> str | None:
    """The quoted value of an attribute, any case; unquoted values are passed over, as is a missing =."""
    at = 0
    while at < len(attrs):
        m = _ATTR.match(attrs, at)
        if m is None or m.end() == at:
            return None
        if m[4] is None and m[1].lower() == name.lower():
            return m[2] if m[2] is not None else m[3]
        if m[4] is not None and not m[1] and not m[4]:
            return None
        at = m.end()
    return None


def stripped(markup: str) -> str:
    return _STRIP.sub(lambda m: m[1] or "", markup)


def plain(markup: str) -> str | None:
    """Text without tags, its white space collapsed; None if nothing is left."""
    return " ".join(stripped(markup).split()) or None


class Part:
    """A text with its tags, listed once; elements are looked up by name."""

    def __init__(self, text: str, found: list[Tag] | None = None):
        self.text = text
        self.tags = tags(text) if found is None else found
        self._opens: dict[str, int] = {}
        self._closes: dict[str, list[int]] = {}
        for t in self.tags:
            if t.closing:
                self._closes.setdefault(t.local, []).append(t.at)
            elif t.content >= 0:
                self._opens.setdefault(t.local, t.content)

    def span(self, name: str) -> tuple[int, int | None] | None:
        """Where the first element of that name has its text, and the end, None if it isn't closed."""
        start = self._opens.get(name.lower())
        if start is None:
            return None
        closes = self._closes.get(name.lower(), [])
        k = bisect_left(closes, start)
        return start, closes[k] if k < len(closes) else None

    def raw(self, name: str) -> str | None:
        span = self.span(name)
        return self.text[span[0] : span[1]] if span and span[1] is not None else None

    def text_of(self, name: str) -> str | None:
        got = self.raw(name)
        return plain(got) if got is not None else None

    def within(self, start: int, end: int) -> Part:
        """The part from start to end, both between tags, with the tags that this one has there."""
        inside = [t._replace(at=t.at - start, content=t.content - start if 0 <= t.content <= end else -1) for t in self.tags if start <= t.at < end]
        return Part(self.text[start:end], inside)


def header_of(window: Part) -> Part:
    """The header element, or what stands in for it."""
    for name in ("aoheader", "teiheader"):
        if span := window.span(name):
            start, end = span
            return window.within(start, end) if end is not None else Part(cut(window.text[start:], HEADER))
    return Part(cut(window.text, HEADER))


def year_of_date(value: str | None) -> str | None:
    v = (value or "").strip()[:4]
    return v if re.fullmatch("[0-9]{4}", v) and 1900 <= int(v) <= 2100 else None


def year_in(text: str | None) -> str | None:
    m = _YEAR.search(text or "")
    return m[0] if m else None


def cth_number(text: str | None) -> str | None:
    m = _CTH.search(text or "")
    return f"CTH {m[1].rstrip('.')}" if m else None


def sigla(header: Part, window: Part, path: str) -> str | None:
    t = header.text_of("docID") or window.text_of("docID")
    if t and "€" not in t:
        return t
    t = header.text_of("TxtPubl") or window.text_of("TxtPubl")
    if t:
        t = " ".join(t.split("{", 1)[0].split())
        if t and "€" not in t:
            return t
    stem = path.rpartition("/")[2]
    return header.text_of("title") or (stem.rpartition(".")[0] or stem) or None


def group(header: Part, window: Part, path: str) -> str | None:
    if c := cth_number(path):
        return c
    for t in start_tags(header.tags):
        if t.local == "cth":
            for v in (attribute(t.attributes, name) for name in ("neu", "alt", "n")):
                if c := cth_number(v):
                    return c
                if v and v[0] in "0123456789":
                    return f"CTH {v}"
    return cth_number(header.text) or cth_number(cut(window.text, CTH_SPAN))


def credit(header: Part) -> tuple[str | None, str | None]:
    """Editor and year: the text of a naming element, else the best-ranked credited attribute."""
    for name in ("name", "persName", "author"):
        t = header.text_of(name)
        if t and t.lower() not in AUTOMATIC:
            return t, year_in(header.text)
    best = None
    for at, t in enumerate(start_tags(header.tags)):
        who = next((v for n in ("editor", "author") if (v := attribute(t.attributes, n)) is not None), None)
        who = " ".join((who or "").split())
        if who and who.lower() not in AUTOMATIC:
            year = year_of_date(attribute(t.attributes, "date"))
            key = (_RANK.get(t.local, len(ROLES)), year is None, at)
            if best is None or key < best[0]:
                best = (key, who, year)
    return (best[1], best[2]) if best else (None, None)


def fallback_year(header: Part, window: Part) -> str | None:
    for t in start_tags(header.tags):
        if t.local in DATED and (y := year_of_date(attribute(t.attributes, "date"))):
            return y
    text = stripped(header.raw("date") or "").strip()
    return year_of_date(text) or year_in(text) or year_in(header.text) or year_in(cut(window.text, YEAR_SPAN))


def inventory(header: Part, window: Part) -> str | None:
    for part in (header, window):
        for name in ("InvNr", "inv"):
            if t := part.text_of(name):
                return t
    return None


def languages(window: str) -> list[str]:
    """Codes by falling count, then by name. The text is scanned as it stands, comments included."""
    n: Counter[str] = Counter()
    for m in _LG.finditer(cut(window, LANG_SPAN)):
        code = m[1] if m[1] is not None else m[2]
        if 1 <= len(code.encode("utf-8", "replace")) <= 8 and code not in NO_LANGUAGE and code != MISSING:
            n[FOLDED.get(code, code)] += 1
    return [c for c, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))]


def corpus(path: str) -> str | None:
    for m in re.finditer(r"_xml_([^/\\]*)", path, re.I):
        if m[1].strip():
            return m[1].strip()
    return None


def record(path: str, text: str) -> dict:
    """One document's fields; NULL where missing."""
    window = Part(cut(text or "", WINDOW))
    header = header_of(window)
    name, label = sigla(header, window, path or ""), group(header, window, path or "")
    editor, year = credit(header)
    digits = re.search("[0-9]+", label or "")
    number = int(digits[0]) if digits and int(digits[0]) <= NO_NUMBER else NO_NUMBER
    return {
        "title": " · ".join(x for x in (name, label) if x) or None, "sigla": name, "cth": label, "cth_num": number, "authorship": editor,
        "year": year or fallback_year(header, window), "lang": ", ".join(languages(window.text)) or None, "inv": inventory(header, window), "corpus": corpus(path or ""),
    }


SCHEMA = "title string, sigla string, cth string, cth_num long, authorship string, year string, lang string, inv string, corpus string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def published(records: DataFrame) -> DataFrame:
    """records as they are shown: the marker for every field that is missing."""
    return records.withColumns({n: F.coalesce(n, F.lit(MISSING)) for n in _NAMES if n != "cth_num"})


def extract(documents: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key plus a record for each document, one pass a batch."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [record(p, t) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[n] for g in got], pa.int64() if n == "cth_num" else pa.string()) for n in _NAMES)], names=[key, *_NAMES])

    return documents.select(key, path, text).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def scan(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, closing, local, attributes of every tag of the whole texts, in order; start tags inside another's attributes are not met."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                found = tags(b.column(1)[k].as_py() or "")
                starts = {t.at for t in start_tags(found)}
                kept = [t for t in found if t.closing or t.at in starts]
                columns = [pa.array([x] * len(kept), b.column(0).type) for x in (b.column(0)[k].as_py(),)]
                columns += [pa.array([t.at for t in kept], pa.int64()), pa.array([t.closing for t in kept], pa.bool_()), pa.array([t.local for t in kept], pa.string()), pa.array([t.attributes for t in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "at", "closing", "local", "attributes"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, at long, closing boolean, local string, attributes string")


def element_text(documents: DataFrame, key: str, text: str, name: str, attribute_name: str | None = None) -> DataFrame:
    """key and value: the text of the first element of that name, or the value of an attribute in the first start tag of it that has it."""
    kind = dict(documents.dtypes)[key]

    def one(x: str) -> str | None:
        part = Part(x)
        if attribute_name is None:
            return part.text_of(name)
        return next((v for t in start_tags(part.tags) if t.local == name.lower() and (v := attribute(t.attributes, attribute_name)) is not None), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x or "") for x in b.column(1).to_pylist()], pa.string())], names=[key, "value"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, value string")
