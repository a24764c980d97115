"""The pipeline against the stages' brute forces, one after the other."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import test_neardup
import test_pii
import test_quality
import test_suffix_dedup
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.queries import PII_KEY
from quire.llm.quality import PUNCTUATION, STOP_CHARS, STOP_WORDS, STOP_WORDS_FROM


def good(text):
    """The quality table, written out."""
    n, chars, symbols, dup, repeats = test_quality.brute(text)
    if n < 10 or 100 * repeats > 20 * n or not 1.5 <= chars / n <= 30 or symbols / n > 0.1:
        return False
    words, lines = test_quality.W.findall(text), [x for x in text.split("\n") if test_quality.W.search(x)]
    stops = sum(len(w) <= STOP_CHARS and w.translate({ord(c): None for c in PUNCTUATION}).lower() in STOP_WORDS for w in words)
    return (n < STOP_WORDS_FROM or stops / n >= 0.01) and dup / len(lines) <= 0.5


def packed(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = []
    for d, text in rows:
        ids, start = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        n = len(ids)
        while start < n:
            left = n - start
            size = 2048 if left >= 2048 else 1 << (left.bit_length() - 1)
            out.append((d, start, size, zlib.crc32(np.asarray(ids[start : start + size], "<u4").tobytes()), n))
            start += size
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 7)))
    prose = lambda n: [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.2 else word() for _ in range(n)]
    texts = [" ".join(prose(rng.choice([3, 12, 60, 300]))) for _ in range(40)]
    passage = " ".join(prose(60))
    texts += [" ".join(prose(30)) + " " + passage + " " + " ".join(prose(30)) for _ in range(6)]
    for size in (80, 200):
        base = prose(size)
        for _ in range(8):
            x = list(base)
            x[rng.randrange(size)] = word()
            texts.append(" ".join(x))
    texts += [" ".join(prose(20)) + f" write to {word()}.{i}@mail.example.com or call +1 (017) 555-77{i:02}. Mr. John Smith said so, and Smith left" for i in range(8)]
    texts += ["line of the text and more words here\n" * 12, "# * $ % " * 20, " ".join(word() for _ in range(80)), texts[0], texts[1], "  ", "é" * 5000]
    texts += [" ".join(prose(12_000))]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return rows + [(7000, None), (7001, ""), rows[5], rows[5]]


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    # Extra columns, some named like what the stages make for themselves, and nulls in all of them.
    wide = [(d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", i, i, None if i % 3 else "x", None) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars int, digest long, kept string, key string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "repeated_passages", "private_data", "pack_sequences"]

    def step(name):
        nonlocal docs
        docs = stages[name](spark, docs, str(tmp_path)).cache()
        return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)

    rows = [(d, t) for d, t in rows if good(t)]
    assert len(rows) < len(wide) and step("quality_rules") == sorted(rows, key=str)
    kept = {d for d, _, _, k in test_neardup.brute(rows, 80) if k}
    rows = [(d, t) for d, t in rows if d in kept]
    assert step("near_dedup") == sorted(rows, key=str)
    rows = [(d, bytes(x for x, h in zip(b, hit) if not h).decode(errors="ignore")) for (d, _), (b, hit) in zip(rows, test_suffix_dedup.marks(rows, 200))]
    assert step("repeated_passages") == sorted(rows, key=str) and {r.doc_id: r.n_chars for r in docs.collect()} == {d: len(t) for d, t in rows}
    monkeypatch.setattr(test_pii, "KEY", PII_KEY)
    got = step("private_data")
    assert [d for d, _ in got] == [d for d, _ in sorted(rows, key=str)] and docs.columns == df.columns
    for (d, t), (_, made) in zip(sorted(rows, key=str), got):
        if "Smith" in t:
            assert "Smith" not in made and "John" not in made and t.split("@")[0].split()[-1] not in made and "555-77" not in made
        else:
            assert made == test_pii.brute(t)[0]
    pieces = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in stages["pack_sequences"](spark, docs, str(tmp_path)).collect()), key=str)
    assert pieces == packed(got)


def test_run_and_empty_table(spark, tmp_path):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert corpus_pipeline.ORACLE_SQL is None
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
