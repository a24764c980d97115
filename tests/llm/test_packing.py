import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quire.llm.packing import buckets, pack, piece_lengths


def test_lengths():
    for n in [*range(1, 70), 5000]:
        got = piece_lengths(n, 16)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 16 for x in got) and len([x for x in got if x < 16]) == bin(n % 16).count("1")


def test_pack_against_brute_force(spark):
    rows = [(4, "One two three four five. " * 300), (2, None), (9, ""), (9, "ties"), (None, "a b"), (7, "é" * 100)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    packed = pack(df, P.path("byte_bpe_50k.json"), 64, with_ids=True)
    got = packed.collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((d is not None, d or 0, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.offset == 0
    back = sorted((d is not None, d or 0, np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(x, key=lambda r: r.start)]).tolist()) for (d, _), x in by.items())
    assert back == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    ends = sorted((r.first_sequence, r.sequences, r.length) for r in buckets(packed).collect())
    assert [a + n for a, n, _ in ends] == [a for a, _, _ in ends[1:]] + [len(got)] and [x[2] for x in ends] == sorted({r.length for r in got}, reverse=True)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0


def test_very_long_text_at_the_default(spark):
    text = "one two three, " * 40_000
    got = pack(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    long = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    n = len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) + 1
    assert [a for a, _ in long] == np.cumsum([0, *(s for _, s in long[:-1])]).tolist() and sum(s for _, s in long) == n
    assert [s for _, s in long] == piece_lengths(n, 2048) and max(r.length for r in got) == 2048
