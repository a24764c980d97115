import zlib

import numpy as np

from quire.llm.common import documents
from quire.llm.langid import evaluate, fit, group_families, identify, train, vector


def test_held_out_accuracy(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    got = evaluate(df, 200).join(df.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    test = [r for r in got if r.held_out and len(r.text.split()) >= 10]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97


def test_families_join_the_alike():
    v = {k: np.asarray(x, np.float32) for k, x in {"a": [1, 1, 0, 0], "b": [1, 0.8, 0, 0], "c": [0, 0, 1, 1], "d": [0, 0, 1, 0.7]}.items()}
    assert sorted(group_families(v)) == [["a", "b"], ["c", "d"]]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "123 !!", "x"), (4, "hello there", "x"), (4, "hello there", "x"), (None, "hola " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = train(df.where("lang is not null"))
    got = {(r.doc_id, r.lang_pred) for r in identify(df, one).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "x"), (None, "x")}
    assert {r.lang_pred for r in identify(df, train(df.where("false"))).collect()} == {"und"}
    assert evaluate(df.where("false")).count() == 0


def test_fit_separates():
    x = np.stack([vector(t) for t in ("the of and", "of the that", "der die und", "und das der")])
    m = fit(x, ["en", "en", "de", "de"])
    assert [m.decide(m.weights @ v + m.bias)[0] for v in x] == ["en", "en", "de", "de"]


def test_draw_is_by_text_and_bounded(spark):
    """Rows that share a doc_id are drawn each by its text, copies once, per_language at most."""
    rows = [(7, f"the word number {i} of these", "en") for i in range(300)] + [(i, f"das wort nummer {i} von denen", "de") for i in range(300)] + [(9, "le même texte toujours", "fr")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, 100)
    got = {(r.lang, r.lang_pred) for r in identify(df, model).collect()}
    assert got == {("en", "en"), ("de", "de"), ("fr", "fr")}


def plain_features(text):
    """Feature counts of a text, a gram at a time in plain integers."""
    import re

    mask, out = (1 << 64) - 1, np.zeros(4096)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        marked = [2, *map(ord, word), 3]
        grams = [c * 2654435761 & mask for c in marked[1:-1]]
        for n in (2, 3):
            for k in range(len(marked) - n + 1):
                h = n
                for c in marked[k : k + n]:
                    h = (h * 0x100000001B3 + c) & mask
                grams.append(h * 0x9E3779B97F4A7C15 & mask)
        for h in grams:
            out[(h >> 17) % 4096] += 1
    return out


def test_predictions_recomputed(spark):
    """Every prediction again from the machines: the family first, then its languages, by votes."""
    df = documents(spark, "/root/testdata/sf0.001")
    model = train(df.where("lang is not null").select("doc_id", "text", "lang"), 50)
    for r in identify(df, model).collect():
        x = plain_features(r.text or "")
        if not x.sum():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        side = 1 / (1 + np.exp(-2 * np.clip(model.weights.astype(float) @ (x / x.sum()) + model.bias, -15, 15)))

        def votes(names, machines):
            return {n: sum(side[k] if n == a else 1 - side[k] for a, b, k in machines if n in (a, b)) for n in names}

        families = votes(range(len(model.families)), model.between)
        family = max(families, key=lambda n: (families[n], -n))
        names = model.families[family]
        inside = votes(names, [m for m in model.within if m[0] in names])
        best = max(inside, key=lambda n: (inside[n], -names.index(n)))
        share = lambda v, n: v / max(1, n - 1) if n > 1 else 1.0
        assert r.lang_pred == best and abs(r.score - share(families[family], len(families)) * share(inside[best], len(names))) < 1e-3
