import hashlib
import io

import pytest

from quire.sources import fetch as X

DATA = b"x" * 1000
MD5 = hashlib.md5(DATA).hexdigest()


def answers(*made):
    """An opener that gives one answer, or raises one error, a call."""
    left = list(made)

    def opener(url):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        body, length = x
        return X.Answer(length, io.BytesIO(body).read)

    return opener


def test_download(tmp_path):
    waits = []
    opener = answers(X.HttpError(503, 99), (DATA[:10], 1000), (DATA, 1000))
    got = X.download("u", tmp_path / "d" / "a.zip", MD5.upper(), opener=opener, wait=waits.append)
    assert got.read_bytes() == DATA and waits[0] == 30 and 2 <= waits[1] <= 2.5
    assert [p.name for p in got.parent.iterdir()] == ["a.zip"]


@pytest.mark.parametrize("made, error", [((DATA, 10**12), X.Oversized), ((DATA, None), X.WrongDigest), (X.HttpError(404), X.HttpError), (X.RedirectLoop("u"), X.RedirectLoop)])
def test_refused_at_once(tmp_path, made, error):
    with pytest.raises(error):
        X.download("u", tmp_path / "a.zip", "0" * 32, opener=answers(made), wait=lambda s: pytest.fail("tried again"))
    assert not list(tmp_path.iterdir())


def test_bounds(tmp_path):
    with pytest.raises(X.Oversized):
        X.download("u", tmp_path / "a", MD5, most=999, opener=answers((DATA, None)), wait=None)
    assert X.fetch_text("u", opener=answers((b"hi", None))) == "hi"
    with pytest.raises(X.Oversized):
        X.fetch_text("u", most=10, opener=answers((DATA, None)))
    ticks = iter([0, 100])
    with pytest.raises(TimeoutError):
        X.fetch_text("u", opener=answers((DATA, None)), clock=lambda: next(ticks))


def test_retryable():
    assert all(map(X.retryable, [X.Truncated("x"), X.HttpError(429), TimeoutError(), ConnectionResetError(), EOFError()]))
    assert not any(map(X.retryable, [X.Oversized("x"), X.WrongDigest("x"), X.HttpError(403), PermissionError(13, "x"), ValueError()]))
    assert X.retry_delay(3, X.Truncated("x"), lambda: 0.0) == 8 and X.retry_delay(0, X.HttpError(429, 5)) == 5


def test_obtain(tmp_path):
    cache, temporary = tmp_path / "cache", tmp_path / "t"
    first = X.obtain("h/a.zip", MD5, cache, temporary, answers((DATA, None)))
    assert X.obtain("h/a.zip", MD5, cache, temporary, answers()) == first
    (tmp_path / "file").write_text("x")
    assert X.obtain("h/a.zip", MD5, tmp_path / "file", temporary, answers((DATA, None))).parent == temporary


def test_strict_json():
    assert X.parse_json(' {"a": [1, "é\\n", null, true, -2.5e1]} ') == {"a": [1, "é\n", None, True, -25.0]}
    for bad in ('{"a":1} x', "", "NaN", "[1,]", '{"a":01}', "1e999", "[" * 1001 + "]" * 1001, '"\t"', "{'a':1}"):
        assert X.parse_json(bad) is None, bad
    assert X.parse_json("[" * 900 + "]" * 900) is not None and X.parse_json('"' + "[" * 2000 + '"') is not None
    v = X.parse_json('{"a":[{"b":"x"},7,1.5,-1,true]}')
    assert X.member(v, "a", 0, "b") == "x" and X.member(v, "a", 9) is None and X.member(v, "a", "b") is None
    assert [X.as_count(X.member(v, "a", k)) for k in range(1, 5)] == [7, None, None, None] and X.as_text(7) is None


def test_release():
    body = '{"id": 7, "files": [{"key": "a.zip", "checksum": "md5:AB"}], "metadata": {"publication_date": "2024-01-02"}}'
    r = X.parse_release(body)
    assert (r.record_id, r.file, r.md5, r.published) == (7, "a.zip", "AB", "2024-01-02")
    assert X.parse_release('{"id": 7, "files": []}') is None and X.parse_release("<html>") is None
    assert X.advice(7, "ab", r) is None and "expected cd" in X.advice(7, "cd", r) and "2024-01-02" in X.advice(6, "ab", r)
    assert X.latest_release("u", answers((body.encode(), None))).record_id == 7
    with pytest.raises(X.TransferError):
        X.latest_release("u", answers((b"[]", None)))
