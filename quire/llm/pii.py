"""Operator 4: personal data replaced by surrogates, in built-in expressions alone.

One pattern finds the entities; each is rewritten character by character inside its
row. A character stays in its class (digit, vowel, consonant, accented, Greek,
Cyrillic, upper or lower case), so script and format hold; it moves by a shift that
a keyed SHA-256 draws from the entity's kind, length and the characters before it,
folded to lower case; a letter of another script moves inside its block of letters. Given the characters before, a shift is a permutation of the
class, so that map is one-to-one. Where a kind has two maps, the one for the names of
the tables or for hexadecimal secrets stays in its own set, and the other is applied
again until it has left that set, which is one-to-one on the rest. So distinct
entities of a kind stay distinct and the same entity gets the same surrogate
everywhere, with no table of them and no shuffle. The kind is that of the alternative
that matched. The first character that can move does; an entity with none stays.
`collisions` checks that on a table.

By kind: e-mail keeps its top-level domain; a telephone number its country code; an
IPv4 address moves octet by octet modulo 256; a quoted secret keeps hexadecimal digits
hexadecimal; card and identity numbers keep their grouping; a name after a title keeps
the title. The words of such a name become the same wherever else they stand in the
row, with a title or without. A given name from the tables becomes another of the same gender, by a keyed
rotation of its table; other names keep their last letter, which marks gender in
Romance languages.

Defined results. Null text: null, no entities. Empty text: empty. Repeated rows get
the same text. Extra columns pass through `surrogates` untouched; one named like the count is
renamed in_<name>. An empty table gives
no rows. Very long texts are one row's work like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Given names by gender, rotated within their table. Fixed values.
FEMALE = "Alice Anna Barbara Carmen Clara Claire Elena Emma Eva Greta Helen Ingrid Isabel Jane Julia Karin Laura Lucia Maria Marie Nina Olga Paula Petra Rosa Sarah Sofia Susan Teresa Ursula".split()
MALE = "Adam Albert Antonio Bernard Carlos David Diego Edward Felix Frank Georg Hans Henri Ivan James Jean John Jorge Karl Louis Manuel Michael Otto Paul Peter Pierre Robert Stefan Thomas Victor".split()

#: Classes of characters that a surrogate doesn't leave.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñ",
    "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)
_HEX_LETTERS = "abcdef"
#: First and last code point of letters of other scripts, each a class of its own; all are assigned, and no case tells them apart.
SCRIPTS = (
    (0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
_SCRIPT_LETTERS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in SCRIPTS) + "]"
#: Times that a map is applied at most to leave the other map's set: more than there are names in the tables.
_ROUNDS = 64

_WORD = r"\p{L}\p{M}\p{N}._%+\-"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_KEY = r"""(?i:token|key|secret|password|passwd)["']?\s{0,3}[=:]\s{0,3}"""
_NAME = r"\p{Lu}(?:['’]\p{Lu}|\p{L})\p{L}{0,30}(?:['’\-]\p{Lu}\p{L}{0,30}){0,3}"
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|zu)"
#: Kind and pattern, the first that matches wins.
KINDS = (
    ("secret", rf'(?<={_KEY}")[^"\s]{{8,256}}(?=")|(?<={_KEY}["\']?)(?=[^\s"\',;]{{0,255}}\d)[^\s"\',;]{{8,256}}'),
    ("email", rf"(?<![{_WORD}])[{_WORD}]{{1,64}}+@[\p{{L}}\p{{M}}\p{{N}}\-]{{1,63}}(?:\.[\p{{L}}\p{{M}}\p{{N}}\-]{{1,63}}){{0,8}}\.[\p{{L}}\p{{M}}]{{2,24}}(?![\p{{L}}\p{{N}}])"),
    ("phone", r"(?<![\p{L}\p{N}])(?=\+(?:[ .\-()]{0,2}\d){8})\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"
              r"|(?<![\d.,/\-+])(?=\(?0(?:[ .\-/()]{0,2}\d){8})(?!(?:\d{4}[ \-]){3}\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?![\d\-])|\d{2}[.\-/]\d{2}[.\-/]\d{4}(?!\d))(?:\(0\d{1,4}\) ?|0\d{1,4}[ .\-/])\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"),
    ("identity", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("card", r"(?<![\d])(?:(?:\d{4}[ \-]){3}\d{4}|\d{13,19})(?!\d)"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("person", rf"(?<=\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? )(?:{_PARTICLE} ){{0,2}}{_NAME}(?: (?:{_PARTICLE} ){{0,2}}{_NAME}){{0,2}}(?!\p{{L}})"),
)
#: The one capturing group is a secret's, as its own characters don't tell it from others.
PATTERN = "|".join(f"({p})" if k == "secret" else f"(?:{p})" for k, p in KINDS)
#: What every text with an entity holds; others are passed by.
HINT = r"[0-9@\"]|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\b"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(key: str, kind: str, *parts: Column) -> Column:
    """A keyed number below 2**32."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), *parts), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _letter(code_point: Column) -> Column:
    """The character of a code point from U+0080 to U+FFFF, from its bytes in UTF-8."""
    low = F.lit(0x80) + code_point.bitwiseAND(F.lit(63))
    two = (F.lit(0xC0) + F.shiftright(code_point, 6)) * 256 + low
    three = ((F.lit(0xE0) + F.shiftright(code_point, 12)) * 256 + F.lit(0x80) + F.shiftright(code_point, 6).bitwiseAND(F.lit(63))) * 256 + low
    return F.unhex(F.hex(F.when(code_point < 0x800, two).otherwise(three))).cast("string")


def _moved(c: Column, draw: Column, must: Column, classes) -> Column:
    """c moved inside its class by the number drawn; where `must`, never by nothing.

    The class is looked up, not tried in a branch of its own: with a branch each, the expression filled the driver's memory.
    """
    def shifted(at: Column, size: Column) -> Column:
        shift = F.when(must, F.pmod(draw, size - 1) + 1).otherwise(F.pmod(draw, size))
        return F.pmod(at + shift, size)

    letters = "".join(classes)
    # For each of the letters, the place where its class begins, from 1, and the size of that class, as characters.
    begins = "".join(chr(1 + sum(map(len, classes[:k]))) * len(x) for k, x in enumerate(classes))
    sizes = "".join(chr(len(x)) * len(x) for x in classes)

    def lettered(at: Column) -> Column:
        begin = F.ascii(F.substr(F.lit(begins), at, F.lit(1)))
        size = F.ascii(F.substr(F.lit(sizes), at, F.lit(1))).cast("long")
        new = F.substr(F.lit(letters), (shifted(at - begin, size) + begin).cast("int"), F.lit(1))
        return F.when(c == F.lower(c), new).otherwise(F.upper(new))

    def scripted(point: Column) -> Column:
        block = F.lit(0)
        for a, z in SCRIPTS:
            block = F.when(point.between(a, z), F.lit(a << 16 | z - a + 1)).otherwise(block)
        new = lambda a, n: _let(shifted(point - a, n) + a, _letter)
        return _let(block.cast("long"), lambda b: F.when(b > 0, new(F.shiftright(b, 16), b.bitwiseAND(F.lit(65535)))).otherwise(c))

    rest = _let(F.ascii(c).cast("long"), scripted) if classes is CLASSES else c
    return _let(F.position(F.lower(c), F.lit(letters)), lambda at: F.when(at > 0, lettered(at)).otherwise(rest))


def _spelled(text: Column, key: str, kind: str, classes=CLASSES) -> Column:
    """Every character of text moved within its class; the rest of the characters stay."""
    movable = "".join(classes)
    marked = F.translate(F.lower(text), movable, "\x01" * len(movable))
    first = F.instr(F.regexp_replace(marked, _SCRIPT_LETTERS, "\x01") if classes is CLASSES else marked, "\x01")

    def one(c: Column, i: Column) -> Column:
        draw = _draw(key, kind, F.length(text).cast("string"), F.lower(F.substr(text, F.lit(1), i)))
        return _let(draw, lambda d: _moved(c, d, i + 1 == first, classes))

    return F.array_join(F.transform(F.split(text, "(?!^)(?!$)"), one), "")


def _left(value: Column, body, taken) -> Column:
    """body applied to value, and again while the result is `taken`: one-to-one on values that aren't, if body is on all."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS)), value, lambda x, i: F.when((i == 0) | taken(x), body(x)).otherwise(x))


def _octets(ip: Column, key: str) -> Column:
    def one(o: Column, i: Column) -> Column:
        before = F.array_join(F.slice(F.split(ip, r"\."), F.lit(1), i), ".")
        d = _draw(key, "ip", before)
        return F.pmod(o.cast("long") + F.when(i == 0, F.pmod(d, F.lit(255)) + 1).otherwise(d), F.lit(256)).cast("string")

    return F.array_join(F.transform(F.split(ip, r"\."), one), ".")


def _name(word: Column, key: str) -> Column:
    """One word of a name."""
    def spelled(w: Column) -> Column:
        return F.concat(_spelled(F.substr(w, F.lit(1), F.length(w) - 1), key, "person"), F.substr(w, F.length(w), F.lit(1)))

    out = _left(word, spelled, lambda w: w.isin(*FEMALE, *MALE))
    for table in (FEMALE, MALE):
        names = F.array(*[F.lit(x) for x in table])
        turn = F.pmod(_draw(key, "given", F.lit(table[0])), F.lit(len(table) - 1)) + 1
        at = F.array_position(names, word)
        out = F.when(at > 0, F.element_at(names, (F.pmod(at - 1 + turn, F.lit(len(table))) + 1).cast("int"))).otherwise(out)
    return out


def kind_of(found: Column) -> Column:
    """The kind of a found entity: secrets by the group that matched, the others from their own characters."""
    entity = found["entity"]
    return (
        F.when(found["secret"], "secret")
        .when(F.contains(entity, F.lit("@")), "email")
        .when(entity.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "identity")
        .when(entity.rlike(r"^(?:(?:\d{4}[ \-]){3}\d{4}|\d{13,19})$"), "card")
        .when(entity.rlike(r"^\p{L}"), "person")
        .otherwise("phone")
    )


def surrogate(found: Column, key: str) -> Column:
    """The surrogate of one entity."""
    entity = found["entity"]
    keep = lambda pattern: F.regexp_extract(entity, pattern, 1)
    rest = lambda pattern: F.regexp_extract(entity, pattern, 2)
    mail, dial = r"^(.*)(\.[^.]+)$", r"^(\+\d{1,3}(?=[ .\-(])|)(.*)$"
    hexed = (CLASSES[0], _HEX_LETTERS)
    is_hex = lambda x: x.rlike("^[0-9A-Fa-f]+$")
    return _let(kind_of(found), lambda kind: (
        F.when(kind == "email", F.concat(_spelled(keep(mail), key, "email"), rest(mail)))
        .when(kind == "phone", F.concat(keep(dial), _spelled(rest(dial), key, "phone")))
        .when(kind == "ip", _octets(entity, key))
        .when(kind == "person", F.array_join(F.transform(F.split(entity, " "), lambda w: _name(w, key)), " "))
        .when((kind == "secret") & is_hex(entity), _spelled(entity, key, "secret", hexed))
        .when(kind == "secret", _left(entity, lambda x: _spelled(x, key, "number"), is_hex))
        .otherwise(_spelled(entity, key, "number"))
    ))


_FOUND = "array<struct<entity: string, secret: boolean>>"


def entities(text: Column) -> Column:
    """The entities of a text in their order, and whether each is a secret."""
    none = F.array().cast(_FOUND)
    every, secrets = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))
    found = _let(every, lambda e: F.when(F.size(e) == 0, none).otherwise(F.zip_with(e, secrets, lambda x, y: F.struct(x.alias("entity"), (F.length(y) > 0).alias("secret")))))
    return F.when(text.rlike(HINT), found).otherwise(none)


def _names(found: Column) -> Column:
    """The words of the persons found, without particles."""
    persons = F.filter(found, lambda e: kind_of(e) == "person")
    words = F.flatten(F.transform(persons, lambda e: F.split(e["entity"], " ")))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))


def _mentions(names: Column) -> Column:
    """A pattern for whole words that are one of the names; longer names first, so that none hides another."""
    longest = F.array_sort(names, lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).otherwise(0))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:\Q"), F.array_join(longest, r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{N}])"))


def _woven(parts: Column, between: Column) -> Column:
    """The parts with what stands between them, one less."""
    return F.array_join(F.zip_with(parts, F.concat(between, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")


def surrogates(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with surrogates in text, and the number of entities in a column `count` if it is named; bare mentions count."""
    t = F.col("text")

    def renamed(part: Column, pattern: Column) -> Column:
        bare = F.regexp_extract_all(part, pattern, F.lit(0))
        return F.struct(_woven(F.split(part, pattern, -1), F.transform(bare, lambda w: _name(w, key))).alias("text"), F.size(bare).alias("n"))

    def apart(parts: Column, names: Column) -> Column:
        kept = F.transform(parts, lambda p: F.struct(p.alias("text"), F.lit(0).alias("n")))
        return F.when(F.size(names) == 0, kept).otherwise(_let(_mentions(names), lambda m: F.transform(parts, lambda p: renamed(p, m))))

    def rebuilt(found: Column) -> Column:
        def joined(parts: Column) -> Column:
            text = _woven(F.transform(parts, lambda p: p["text"]), F.transform(found, lambda e: surrogate(e, key)))
            return F.struct(text.alias("text"), (F.size(found) + F.aggregate(parts, F.lit(0), lambda n, p: n + p["n"])).cast("long").alias("n"))

        split = _let(_names(found), lambda names: apart(F.split(t, PATTERN, -1), names))
        return F.when(F.size(found) == 0, F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(_let(split, joined))

    made = _let(F.coalesce(entities(t), F.array().cast(_FOUND)), rebuilt)
    columns = [F.col("__made.text").alias("text") if c == "text" else F.col(c).alias(f"in_{c}") if c == count else F.col(c) for c in docs.columns]
    return docs.withColumn("__made", made).select(*columns, *([F.col("__made.n").alias(count)] if count else []))


def mapping(docs: DataFrame, key: str) -> DataFrame:
    """Each distinct entity: kind, entity, surrogate, mentions."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("found")).groupBy("found").agg(F.count("*").alias("mentions"))
    return found.select(kind_of(F.col("found")).alias("kind"), "found.entity", surrogate(F.col("found"), key).alias("surrogate"), "mentions")


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Surrogates of a kind that stand for several entities, or for themselves: none, if the map is one-to-one."""
    m = mapping(docs, key)
    return m.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("same")).where("n > 1 or same = 1")
