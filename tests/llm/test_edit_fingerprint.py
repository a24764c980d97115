import hashlib
import random

import numpy as np

from quire.llm.edit_fingerprint import PERIOD, SAMPLES, Walker, _classes, _waits, apart, counted, edit_distance, edited, likeness, near_pairs, steps_of, with_neighbours


def slow_walk(text):
    """What the walk writes, a step at a time."""
    out, j = [], 0
    for c in _classes(text):
        n = int(_waits()[c, j % PERIOD])
        out += [c] * n
        j += n
    return out


def test_written_against_plain_walk():
    rng = random.Random(3)
    w = Walker()
    for text in ["", "a", " ", "one two  three\n", "é漢 x" * 40, "z" * 500, *("".join(rng.choice("ab \n") for _ in range(rng.randint(1, 300))) for _ in range(30))]:
        full = slow_walk(text)
        steps = steps_of(len(text))
        assert w.written(text, steps).tolist() == [full[s] if s < len(full) else 255 for s in steps]


def test_steps_are_nested():
    for n in (1, 40, 43, 100, 1000, 1001, 5000):
        a, b = steps_of(n), steps_of(2 * n)
        assert len(a) == min(3 * n, SAMPLES) and set(b[b < 3 * n]) <= set(a)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(n))


def brute(rows):
    order = sorted(((-(1 << 63) if d is None else d, t or "") for d, t in rows), key=lambda r: -r[0])
    w, out = Walker(), []
    for i, (d, t) in enumerate(order):
        n = order[(i + 1) % len(order)][1]
        e = edited(t, n)
        a, b, c = w.fingerprint(t), w.fingerprint(e), w.fingerprint(n)
        out.append((None if d == -(1 << 63) else d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def test_neighbours_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(60)] + [(100, None), (101, ""), (None, "last one"), (70, "long " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    got = with_neighbours(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    long = [r for r in got if r.n_chars > 150]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.3 > np.mean([r.near_next for r in long])
    one = with_neighbours(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert with_neighbours(df.where("false")).count() == 0


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(7)
    for _ in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        for most in (2, 12):
            assert edit_distance(a, b, most) == min(slow_distance(a, b), most + 1)


def test_near_pairs(spark):
    rng = random.Random(9)
    base = prose(rng, 80)
    near = base[:200] + "Q" + base[200:]
    rows = [(1, base), (2, near), (3, base), (4, prose(rng, 80)), (5, None), (6, "")]
    got = near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]


def changed(rng, text, n, lo, hi):
    """text after n edits between the shares lo and hi of its length."""
    t = list(text)
    for _ in range(n):
        i = rng.randrange(int(len(t) * lo), int(len(t) * hi))
        t[i : i + 1] = rng.choice(([], [rng.choice("etaoinshrd ")], [t[i], rng.choice("etaoinshrd ")]))
    return "".join(t)


def brute_pairs(rows, share):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            most = int(share * max(len(x), len(y)))
            if x != y and (d := edit_distance(x, y, most)) <= most:
                out.add((a, b, d))
    return out


def test_near_pairs_wherever_the_edits_lie(spark):
    rng = random.Random(13)
    texts = []
    for words in (2, 3, 6, 15, 40, 100, 400, 2000):
        base = prose(rng, words)
        n = max(1, len(base) // 100)
        texts += [base, *(changed(rng, base, n, lo, hi) for lo, hi in ((0, 0.02 + 1 / len(base)), (0.45, 0.55), (0.9, 1)))]
    texts += ["header " * 20 + prose(rng, 40) for _ in range(2)]
    rows = list(enumerate(dict.fromkeys(texts)))
    want = brute_pairs(rows, 0.1)
    assert len(want) > 35
    assert {tuple(r) for r in near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_crowded_bands_lose_no_pairs(spark):
    rng = random.Random(17)
    base = prose(rng, 80)
    texts = [changed(rng, base, len(base) // 20, 0, 1) for _ in range(40)] + [base[:150] + prose(rng, 50) for _ in range(12)] + [f"short text number {i}" for i in range(40)]
    rows = list(enumerate(dict.fromkeys(texts)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_pairs(rows, 0.1)
    assert len(want) > 800
    for crowd in (2, 7, 1000):
        assert {tuple(r) for r in near_pairs(df, crowd=crowd).collect()} == want, crowd


def test_counts_never_rule_out_a_near_pair():
    rng = random.Random(19)
    for _ in range(300):
        x = prose(rng, rng.randint(4, 60))
        y = changed(rng, x, rng.randint(1, 8), 0, 1) if rng.random() < 0.9 else prose(rng, 20)
        d = edit_distance(x, y, 1000)
        assert not apart(x, y, d) and np.abs(counted(x).astype(int) - counted(y)).sum() <= 8 * d
    assert apart(prose(rng, 60), prose(rng, 60), 10)


def test_recall_on_documents(spark):
    """Pairs found among the short documents of the small table, against all pairs; the drawing may miss some, none may be wrong."""
    from quire.llm.common import documents

    df = documents(spark, "/root/testdata/sf0.001").where("length(text) < 3000")
    rows = {}
    for r in df.orderBy("doc_id").collect():
        rows.setdefault(r.text, r.doc_id)
    rows = [(d, t) for t, d in rows.items() if t]
    # Counts of grams, which the test above shows to rule out no near pair, spare the distances of most.
    want = set()
    for i, (a, x) in enumerate(sorted(rows)):
        for b, y in sorted(rows)[i + 1 :]:
            most = int(0.1 * max(len(x), len(y)))
            if abs(len(x) - len(y)) <= most and not apart(x, y, most) and (d := edit_distance(x, y, most)) <= most:
                want.add((a, b, d))
    got = {tuple(r) for r in near_pairs(df).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
