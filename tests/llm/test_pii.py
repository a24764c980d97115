import hashlib

import regex
from pyspark.sql import functions as F

from quire.llm.common import documents
from quire.llm.pii import CLASSES, FEMALE, KINDS, MALE, _left, _name, _spelled, collisions, mapping, surrogates

KEY = "k"
#: Letters without case, written out here apart from the operator's own table.
BLOCKS = [(0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def draw(kind, *parts):
    return int(hashlib.sha256("\x1f".join((KEY, kind, *parts)).encode()).hexdigest()[:8], 16)


def spelled(x, kind, classes=CLASSES):
    out, moved = "", False
    for i, c in enumerate(x):
        for letters in classes:
            if (at := letters.find(c.lower())) >= 0:
                d, n = draw(kind, str(len(x)), x[:i].lower()), len(letters)
                new = letters[(at + (d % n if moved else d % (n - 1) + 1)) % n]
                c, moved = new if c == c.lower() else new.upper(), True
                break
        else:
            for a, z in BLOCKS if classes is CLASSES else ():
                if a <= ord(c) <= z:
                    d, n = draw(kind, str(len(x)), x[:i].lower()), z - a + 1
                    c, moved = chr(a + (ord(c) - a + (d % n if moved else d % (n - 1) + 1)) % n), True
                    break
        out += c
    return out


def one(kind, e):
    if kind == "email":
        a, b = e.rsplit(".", 1)
        return spelled(a, "email") + "." + b
    if kind == "phone":
        m = regex.match(r"(\+\d{1,3}(?=[ .\-(])|)(.*)", e)
        return m[1] + spelled(m[2], "phone")
    if kind == "ip":
        o = e.split(".")
        ds = [draw("ip", ".".join(o[:i])) for i in range(4)]
        return ".".join(str((int(x) + (d % 255 + 1 if not i else d)) % 256) for i, (x, d) in enumerate(zip(o, ds)))
    if kind == "person":
        def word(w):
            for t in (FEMALE, MALE):
                if w in t:
                    return t[(t.index(w) + draw("given", t[0]) % (len(t) - 1) + 1) % len(t)]
            return spelled(w[:-1], "person") + w[-1]
        return " ".join(map(word, e.split(" ")))
    if kind == "secret" and regex.fullmatch("[0-9A-Fa-f]+", e):
        return spelled(e, "secret", (CLASSES[0], "abcdef"))
    return spelled(e, "number")


P = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))


def brute(text):
    if text is None:
        return None, 0
    return P.subn(lambda m: one(m.lastgroup, m[0]), text)


ROWS = [
    (1, "Write to und.34@mail7.example.com, or UND.34@MAIL7.EXAMPLE.COM!! now"), (2, None), (3, ""), (4, "call +1 (017) 555-7713%%% or 212-555-0199; not 1234"),
    (5, "from 233.254.104.120 and 64.147.79.24."), (6, 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! api_key: "hello-world-42"'), (7, "card 4000123412341234 or 4000 1234 1234 1234, id 123-45-6789"),
    (8, "Mr. John Smith met Frau Ursula Müller, Sra. Lopez and Mrs Anna Ivanova"), (9, "élan.7@été.example.fr and Version 2.0. 1.2.3.4.5 256.1.1.1"), (10, "x" * 20000 + " a@b.co " + "9" * 3000), (1, "Write to und.34@mail7.example.com"),
    (11, "γιώργος.5@mail.gr иван@почта.рф"), (12, "用户@例子.中国 ひらカナ@한글.한국 שלום@דואר.קום مرحبا@بريد.مصر नमसत@डाक.भारत"),
    (13, 'password = "用户密码安全保护你"'), (None, "@@ +1 () ... \"\" Mr. x"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, n int")
    got = surrogates(df, KEY, "n_entities").collect()
    assert [(r.doc_id, r.text, r.n_entities) for r in got] == [(d, *brute(t)) for d, t in ROWS]
    a, b = got[0].text.split(" or ")[0].split("to ")[1].rstrip(","), got[0].text.split(" or ")[1].split("!!")[0]
    assert a.upper() == b and next(r for r in got[1:] if r.doc_id == 1).text == f"Write to {a}"
    assert "John" not in got[7].text and got[7].text.split()[1] in MALE and collisions(df, KEY).count() == 0
    assert surrogates(df.where("false"), KEY).columns == df.columns and surrogates(df.where("false"), KEY).count() == 0


def test_on_documents(spark):
    df = documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: (r.text, r.n) for r in surrogates(df, KEY, "n").collect()}
    for r in df.collect():
        assert got[r.doc_id] == brute(r.text)
    assert sum(n for _, n in got.values()) > 50 and collisions(df, KEY).count() == 0


def test_secrets_are_their_own_kind(spark):
    secrets = ["p@ssword1", "hunter@2022", "me@home.example", "4000123412341234", "192.168.100.200"]
    rows = [(i, f'password = "{x}"') for i, x in enumerate(secrets)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.entity: r for r in mapping(df, KEY).collect()}
    assert set(got) == set(secrets) and {r.kind for r in got.values()} == {"secret"}
    assert len({r.surrogate for r in got.values()}) == len(secrets) and all(len(r.surrogate) == len(e) and r.surrogate != e for e, r in got.items())
    assert not got["me@home.example"].surrogate.endswith("example") and collisions(df, KEY).count() == 0


def test_the_two_maps_of_a_kind_do_not_meet(spark):
    names = [x + y + z + "l" for x in "BCDFGHJKLMNPQRSTVWXYZ" for y in "aeiou" for z in "bcdfghjklmnpqrstvwxyz"]
    names = list(dict.fromkeys(names + FEMALE + MALE))
    made = spark.createDataFrame([(x,) for x in names], "w string").select(F.transform(F.array("w"), lambda w: _name(w, KEY))[0].alias("s"))
    assert len({r.s for r in made.collect()}) == len(names)
    step = lambda x: (x + 3) % 10
    out = spark.range(4, 10).select(_left(F.col("id"), step, lambda x: x < 4).alias("y")).collect()
    assert sorted(r.y for r in out) == [4, 5, 6, 7, 8, 9]
    nearly = [c + "abcdef0" for c in "bcdfghjklmnpqrstvwxyz"]
    df = spark.createDataFrame([(i, f'token = "{x}"') for i, x in enumerate(nearly)], "doc_id long, text string")
    got = {r.entity: r.surrogate for r in mapping(df, KEY).collect()}
    hexed = [x for x in nearly if x[0] in "bcdf"]
    assert len(set(got.values())) == len(nearly) and all(bool(regex.fullmatch("[0-9a-f]+", got[x])) == (x in hexed) for x in nearly)


def test_bare_mentions_and_wider_shapes(spark):
    rows = [
        (1, "Mr. John Smith came. John Smith left. Smith paid; Smithson, Johnny did not."), (2, "Mr. McDonald, Mrs Smith-Jones and Dr. O'Neil; O'Neil's and McDonald's"),
        (3, "call +33 1 23 45 67 89 or 020 7946 0958, (030) 1234 5678"), (4, "password=hunter2022 and 'api_key': 'abc12345'"), (5, "Smith was here. Herr von Goethe"),
        (6, "at 01.02.2003, card 0123 4567 8901 2345 and 012-34-5678; the key: nothing; +1 2 3"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in surrogates(df, KEY, "n").collect()}
    text, n = got[1]
    first = text.split(" came")[0].removeprefix("Mr. ")
    assert text == f"Mr. {first} came. {first} left. {first.split()[1]} paid; Smithson, Johnny did not." and n == 4 and "John Smith" not in text
    assert not any(x in got[2][0] for x in ("McDonald", "Donald", "Jones", "Neil")) and got[2][1] == 5
    assert got[3][1] == 3 and not any(x in got[3][0] for x in ("23 45 67 89", "7946", "1234 5678")) and got[3][0].startswith("call +33 ")
    assert got[4][1] == 2 and not any(x in got[4][0] for x in ("hunter2022", "abc12345"))
    assert got[5][0].startswith("Smith was here. Herr ") and "Goethe" not in got[5][0]
    assert got[6][1] == 2 and got[6][0].startswith("at 01.02.2003, card ") and got[6][0].endswith("the key: nothing; +1 2 3")
    assert collisions(df, KEY).count() == 0


def test_letters_of_all_scripts_move_one_to_one(spark):
    df = spark.createDataFrame([(i, f"{chr(a + i % (z - a + 1))}{i}@ab.cd") for a, z in BLOCKS for i in range(60)], "doc_id long, text string")
    assert collisions(df, KEY).count() == 0
    for r in surrogates(df, KEY).collect():
        block = next((a, z) for a, z in BLOCKS if a <= ord(r.text[0]) <= z)
        assert block


def test_the_expression_stays_small(spark):
    """The driver holds the plan of the stage in several versions and copies; with a branch a class it had 528,081 characters."""
    from corpus_pipeline import private_data

    docs = documents(spark, "/root/testdata/sf0.001")
    plan = private_data(spark, docs, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 100_000


def test_letters_of_every_class_move_as_stated(spark):
    """Each letter and each end of a block, first and later in an entity, against the restatement."""
    ends = "".join(chr(a) + chr(z) for a, z in BLOCKS)
    words = [x + y for letters in (*CLASSES, ends, "ÉÑΩЯ§") for x in letters for y in ("", "q7", "é")]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", _spelled(F.col("w"), KEY, "number").alias("s")).collect()}
    assert got == {w: spelled(w, "number") for w in got}
