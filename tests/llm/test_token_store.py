import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quire.llm.token_store import EliasFano, Segment, pack_segment, token_store


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (3000, 10**12), (700, 2**63)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = EliasFano.of(v)
        assert np.array_equal(e.all(), v)
        assert [e.select(i) for i in range(n)] == v.tolist()


def test_segment_reads_back():
    docs = [np.asarray(x, "<u4") for x in ([5, 1], [1], [70000, 2, 1])]
    s = Segment(pack_segment([-7, 3, 3], [d.tobytes() for d in docs], 0, 0) + b"\n")
    assert s.doc_ids() == [-7, 3, 3]
    assert all(np.array_equal(s.document(i), d) for i, d in enumerate(docs))


def brute(rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_store_against_brute_force(spark):
    rows = [(9, "One two, three."), (2, None), (5, ""), (7, "Ünï — 漢字 " * 50), (1, "One two, three."), (None, "x"), (40, "word " * 30000), (3, "a\nb\n")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, start string")
    got = token_store(df, P.path("word_bpe_49k.json"), segment_ids=20).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_store(df, P.path("word_bpe_49k.json")).count() == 0


def test_ties_and_repeated_rows(spark):
    rows = [(7, "b b b"), (7, "a"), (7, "a"), (7, None), (7, "b b b"), (3, "same"), (3, "same"), (None, "n"), (None, "n")]
    got = token_store(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"), segment_ids=4).collect()
    want = brute(rows)
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in want] and sorted((r[0] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
