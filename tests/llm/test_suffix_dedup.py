import hashlib
import random
from collections import Counter

from quire.llm.common import documents
from quire.llm.suffix_dedup import BUCKET, dedup_report, without_repeats


def marks(rows, window):
    data = [(t or "").encode() for _, t in rows]
    n = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        yield b, hit


def brute(rows, window):
    out = []
    for (d, _), (b, hit) in zip(rows, marks(rows, window)):
        rest = bytes(x for x, h in zip(b, hit) if not h)
        out.append((d, len(b), sum(hit), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, line = prose(150), prose(60)
    rows = [prose(rng.choice([0, 10, 39, 40, 41, 100, 400])) for _ in range(40)]
    for _ in range(60):
        a, z = sorted((rng.randint(0, 150), rng.randint(0, 150)))
        rows.append(prose(rng.randint(0, 50)) + passage[a:z] + prose(rng.randint(0, 50)))
    rows += [line * rng.randint(1, 4) + prose(5) for _ in range(30)] + ["ab" * 200, "x" * 500, "x" * 41, "y" * 40, "y" * 40]
    base = prose(300)
    for _ in range(30):
        x = list(base)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(300)] = rng.choice("XYZé")
        rows.append("".join(x))
    return [(i if i % 17 else 5, t) for i, t in enumerate([*rows, rows[3], None])] + [(None, passage)]


def test_against_brute_force(spark):
    """Every bucket sorted, every bucket counted, and some of each."""
    for seed, bucket in ((1, BUCKET), (2, 0), (3, 300)):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
        assert sorted(map(tuple, dedup_report(df, 40, 16, bucket).collect()), key=str) == brute(rows, 40)
        left = without_repeats(df, 40, 16, bucket)
        assert left.columns == df.columns
        want = Counter((d, None if t is None else bytes(x for x, h in zip(b, hit) if not h).decode(errors="ignore")) for (d, t), (b, hit) in zip(rows, marks(rows, 40)))
        assert Counter((r.doc_id, r.text) for r in left.collect()) == want


def test_production_window(spark):
    df = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, dedup_report(df).collect()), key=str) == brute(rows, 200)


def test_empty(spark):
    assert dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
