import random
import re

from quire.llm.neardup import components, keep_one, near_duplicates

W = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = W.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    low = lambda d: float("-inf") if d is None else d
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if r not in least or low(d) < low(least[r]):
            least[r] = d
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, copies=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    prose = lambda n: [word() for _ in range(n)]
    out = [prose(rng.choice([1, 3, 5, 9, 40, 120, 300])) for _ in range(60)]
    passage = prose(60)
    out += [prose(rng.randint(5, 80)) + passage + prose(rng.randint(5, 80)) for _ in range(60)]
    for size in (40, 70, 150, 260):
        base = prose(size)
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(len(x))] = word()
            out.append(x)
    chain = prose(100)
    for _ in range(15):
        chain = chain[2:] + prose(2)
        out.append(chain)
    rows = [" ".join(x) for x in out]
    rows += rows[:10] + [rows[0].upper(), None, "", " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (200, 201), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 70: 50, 100: 50, 200: 200, 201: 200}


def test_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n long")
    for percent in (85, 80):
        got = near_duplicates(df, percent / 100).drop("digest").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, percent)


def test_edges(spark):
    rows = [(3, "one two three"), (3, "one two three"), (3, "other"), (None, "One two THREE"), (9, None), (8, "x " * 50000), (10, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).drop("digest").collect()), key=str) == brute(rows, 80)
    kept = keep_one(df.withColumn("digest", df.doc_id))
    assert kept.columns == ["doc_id", "text", "digest"] and sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "One t"), (3, "other"), (8, "x x x"), (9, ""), (10, "x")]
    assert near_duplicates(df.where("false")).count() == 0
