"""Archives and release notes from elsewhere, fetched by the driver: bounded, checked, tried again.

A transfer is refused before it begins if it announces too much, cut off beyond the bound,
and checked in one order: too long, too short, wrong digest. `opener` is urllib's or a test's.
"""

from __future__ import annotations

import errno
import hashlib
import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from quire.sources.files import scratch_sibling

MAX_DOWNLOAD, MAX_TEXT = 1 << 30, 4 << 20
MAX_RETRY_AFTER, ATTEMPTS = 30.0, 4
MAX_DEPTH = 1000
_CHUNK = 1 << 18
#: Answers and failures that another attempt may mend. Fixed values.
RETRYABLE_STATUS = frozenset({408, 425, 429, 500, 502, 503, 504})
RETRYABLE_IO = frozenset({errno.EINTR, errno.ETIMEDOUT, errno.ECONNRESET, errno.ECONNABORTED, errno.EPIPE})


class TransferError(Exception):
    """A transfer that failed; again: whether another attempt may help."""

    again = False


class Truncated(TransferError):
    again = True


class Oversized(TransferError):
    pass


class WrongDigest(TransferError):
    pass


class HttpError(TransferError):
    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after, self.again = status, retry_after, status in RETRYABLE_STATUS


class RedirectLoop(TransferError):
    pass


def retryable(error: Exception) -> bool:
    if isinstance(error, TransferError):
        return error.again
    if isinstance(error, (TimeoutError, ConnectionError, EOFError, InterruptedError)):
        return True
    return isinstance(error, OSError) and error.errno in RETRYABLE_IO


def retry_delay(attempt: int, error: Exception, spread: Callable[[], float] = random.random) -> float:
    """Seconds to wait: what the server asked for, at most half a minute; else 2 ** attempt and up to a quarter more."""
    asked = getattr(error, "retry_after", None)
    if asked is not None:
        return min(float(asked), MAX_RETRY_AFTER)
    return 2.0**attempt * (1 + 0.25 * spread())


@dataclass
class Answer:
    """What an opener gives: the length announced, if any, and read(n)."""

    length: int | None
    read: Callable[[int], bytes]


def open_url(url: str, timeout: float = 30.0) -> Answer:
    import urllib.error
    import urllib.request

    try:
        r = urllib.request.urlopen(url, timeout=timeout)
    except urllib.error.HTTPError as e:
        if "redirect" in str(e.reason).lower() and "infinite" in str(e.reason).lower():
            raise RedirectLoop(url) from e
        after = e.headers.get("Retry-After")
        raise HttpError(e.code, float(after) if after and after.isdigit() else None) from e
    length = r.headers.get("Content-Length")
    return Answer(int(length) if length else None, r.read)


def fetch_text(url: str, deadline: float = 10.0, most: int = MAX_TEXT, opener=open_url, clock=time.monotonic) -> str:
    """A short text, bounded in bytes and in time."""
    answer, end, parts, size = opener(url), clock() + deadline, [], 0
    while part := answer.read(_CHUNK):
        parts.append(part)
        size += len(part)
        if size > most:
            raise Oversized(f"{url}: more than {most} bytes")
        if clock() > end:
            raise TimeoutError(url)
    return b"".join(parts).decode()


def _transfer(answer: Answer, scratch: Path, md5: str, most: int) -> None:
    if answer.length is not None and answer.length > most:
        raise Oversized(f"announces {answer.length} bytes, the bound is {most}")
    digest, size = hashlib.md5(), 0
    with scratch.open("wb") as f:
        while size <= most and (part := answer.read(min(_CHUNK, most + 1 - size))):
            f.write(part)
            digest.update(part)
            size += len(part)
    if size > most:
        raise Oversized(f"more than {most} bytes")
    if answer.length is not None and size < answer.length:
        raise Truncated(f"{size} of {answer.length} bytes")
    if digest.hexdigest() != md5.lower():
        raise WrongDigest(f"{digest.hexdigest()}, expected {md5}")


def download(url: str, target: Path, md5: str, most: int = MAX_DOWNLOAD, opener=open_url, wait=time.sleep) -> Path:
    """Fetch url to target, checked; what isn't whole never stands under that name."""
    target.parent.mkdir(parents=True, exist_ok=True)
    scratch = scratch_sibling(target)
    try:
        for attempt in range(ATTEMPTS):
            try:
                _transfer(opener(url), scratch, md5, most)
                return scratch.replace(target)
            except Exception as e:
                if attempt + 1 == ATTEMPTS or not retryable(e):
                    raise
                wait(retry_delay(attempt, e))
        raise AssertionError
    finally:
        scratch.unlink(missing_ok=True)


def obtain(url: str, md5: str, folder: Path | None, temporary: Path, opener=open_url, wait=time.sleep) -> Path:
    """The archive: cached and still whole, or fetched into the cache, or without a usable cache for this run alone."""
    from quire.sources import files

    if folder is None or not files.usable(folder):
        return download(url, temporary / files.archive_name(url, md5), md5, opener=opener, wait=wait)
    files.sweep(folder)
    found = files.lookup(folder, url, md5) or download(url, folder / files.archive_name(url, md5), md5, opener=opener, wait=wait)
    files.prune(folder, found)
    return found


# ---- strict JSON and what is read from it ---------------------------------------------------------

def _number(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError(text)
    return x


def parse_json(text: str) -> Any | None:
    """The value of a whole JSON text, or None: trailing content, other constants and nesting beyond 1000 are refused."""

    def refuse(name: str):
        raise ValueError(name)

    depth = most = 0
    for c in re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S):
        depth += (c in "[{") - (c in "]}")
        most = max(most, depth)
    if most > MAX_DEPTH:
        return None
    try:
        return json.loads(text, parse_constant=refuse, parse_float=_number)
    except (ValueError, RecursionError):
        return None


def member(value: Any, *path: str | int) -> Any | None:
    """The value at a path of names and places, or None."""
    for step in path:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and 0 <= step < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


def as_text(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def as_count(value: Any) -> int | None:
    """An integral, non-negative number."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return int(value) if value >= 0 and value == int(value) else None


def members(rows, key: str, text: str, texts: dict[str, tuple], counts: dict[str, tuple]):
    """key and members of a column of JSON texts: strings, and integral non-negative numbers, by path; null where the text
    isn't strict JSON, the member is missing or of another kind. What Spark's own parser takes with content after it is refused."""
    import pyarrow as pa

    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            values = [parse_json(x) if x is not None else None for x in b.column(1).to_pylist()]
            found = [pa.array([as_text(member(v, *p)) for v in values], pa.string()) for p in texts.values()]
            found += [pa.array([as_count(member(v, *p)) for v in values], pa.int64()) for p in counts.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], names=[key, *texts, *counts])

    return rows.select(key, text).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{n} string" for n in texts), *(f"{n} long" for n in counts)]))


@dataclass
class Release:
    record_id: int
    file: str
    md5: str | None
    published: str | None


def parse_release(body: str) -> Release | None:
    """The release that a repository's record describes."""
    record = parse_json(body)
    number, name = as_count(member(record, "id")), as_text(member(record, "files", 0, "key"))
    if number is None or name is None:
        return None
    checksum = as_text(member(record, "files", 0, "checksum")) or ""
    return Release(number, name, checksum[4:] if checksum.startswith("md5:") else None, as_text(member(record, "metadata", "publication_date")))


def latest_release(url: str, opener=open_url) -> Release:
    found = parse_release(fetch_text(url, opener=opener))
    if found is None:
        raise TransferError(f"{url}: not a record")
    return found


def advice(pinned: int, md5: str, latest: Release) -> str | None:
    """What to tell of a release that isn't the pinned one, or whose digest differs; None if all is well."""
    if latest.record_id != pinned:
        return f"Record {latest.record_id} ({latest.published or 'date unknown'}), file {latest.file}, is newer than {pinned}, which stays in use."
    if latest.md5 is None or latest.md5.lower() == md5.lower():
        return None
    return f"Record {pinned} is published with MD5 {latest.md5}, expected {md5}: the download will be refused."
