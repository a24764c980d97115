import re
from collections import Counter

from quire.llm.quality import judge, keep

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


ROWS = [
    (1, "the cat sat on the mat and it was a good cat for the day"),
    (2, None), (3, ""), (4, " \n\t\x0b "), (5, "a b c d e"), (6, "a b c d e a b c d e"), (7, "x " * 4000),
    (8, "the a b c d e f the a b c d e g h i\nthe a b c d\n\nthe a b c d\r\nthe a b c d"),
    (9, "w*** the x*** y### z%%% of a b c d e f g"), (10, "é ü the 漢字 of to in a is on at it as"), (1, "ties"), (None, "the of and to a in is that it for was on"),
]


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n_words int")
    got = sorted(judge(df).collect(), key=lambda r: (r[0] or 0, r[1]))
    want = sorted(((d, *brute(t)) for d, t in ROWS), key=lambda r: (r[0] or 0, r[1]))
    assert [tuple(r)[:6] for r in got] == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} == {1, 10, None}
    kept = keep(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 10, None}


def test_empty(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
