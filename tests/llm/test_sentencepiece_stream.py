import random
import tempfile

import numpy as np
import public_tokenizers as P
import sentencepiece
import pytest

from quire.llm.common import documents
from quire.llm.sentencepiece_stream import Model, decode, encode, round_trip

PATH = P.path("piece_bpe_32k.model")


def as_unigram():
    """The same pieces and scores as a unigram model: trainer_spec.model_type becomes 1."""
    data = open(PATH, "rb").read()
    at = data.rindex(b"\x18\x02 \x80\xfa\x01")
    f = tempfile.NamedTemporaryFile(suffix=".model", delete=False)
    f.write(data[:at] + b"\x18\x01" + data[at + 2 :])
    f.close()
    return f.name


@pytest.mark.parametrize("path", [PATH, "unigram"])
def test_against_library(path, spark):
    path = as_unigram() if path == "unigram" else path
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), Model(path)
    assert m.kind == (2 if path == PATH else 1)
    rng = random.Random(1)
    texts = ["", " ", "a", "  Hello   wörld ﬁ \n x\t ", "漢字 😀 \x00é", "aaaaaaaaa" * 30, "▁a", "a" + " " * 40 + "b", "x" * 700]
    texts += ["".join(rng.choice("theraion sTé,.\n") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += [r.text for r in documents(spark, "/root/testdata/sf0.001").limit(60).collect()]
    for t in texts:
        ids = np.frombuffer(m.encode(t), "<u4").tolist()
        if m.kind == 2:
            assert ids == sp.encode(t), repr(t)
        else:  # equal sums can be split in several ways, and the library's 32-bit sums of a long text are coarse
            total = lambda x: sum(sp.get_score(i) if i > 258 else 0 for i in x)
            ours, theirs = total(ids), total(sp.encode(t))
            assert ours >= theirs - 1 and abs(ours - theirs) <= 1 + 1e-3 * abs(theirs), repr(t)
        assert m.decode(m.encode(t)) == sp.decode(ids)


def test_window_is_bounded():
    m = Model(PATH)
    given = 0

    def chars():
        for i in range(20000):
            assert i - given < 40 * m.longest
            yield "theraion"[i * 7 % 8]

    for p in m.stream(chars()):
        given += len(p)
    assert given == 20000


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "héllo wörld"), (3, "héllo wörld"), (None, "word " * 30000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_ids int")
    got = {(r.doc_id, r.same, r.n_chars) for r in round_trip(df, PATH).collect()}
    assert got == {(1, True, 0), (2, True, 0), (3, True, 11), (None, True, 150000)}
    back = decode(encode(df, PATH), PATH, out="again")
    assert all(r.again == (r.text or "") for r in back.collect())
    assert round_trip(df.where("false"), PATH).count() == 0
