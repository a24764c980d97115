"""Operator 9: quality rules compiled into one Spark projection.

A threshold table lists measures with the bounds that keep a document; it is
compiled into columns of built-in functions, so that a document is measured and
judged in a single pass, with no shuffle and no user function.

Windows found twice are counted from hashes of words: one pass over the windows' hashes
tells whether any repeats, and only then are they sorted in the row, n log n in the
length of the text whatever the number of repeats. Stop words count without the
punctuation on them, and their share is judged from STOP_WORDS_FROM words on.

Defined results. Null or empty text, or white space alone: no words, all counts
zero, ratios null, base_failed true, kept false. Repeated rows are judged each on
its own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish. Fixed values.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la que el en y los se del las un por con no su una para es al lo"
).split()

#: Measure, least and most that is kept (None: no bound).
THRESHOLDS = (
    ("n_words", 10, None),
    ("mean_word_chars", 1.5, 30.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.2),
)

_WINDOW = 5
#: Words from which the share of stop words can be judged; a shorter text passes that rule.
STOP_WORDS_FROM = 50
#: A longer word isn't looked up.
STOP_CHARS = 8
#: Characters that don't belong to a word where stop words are looked up.
PUNCTUATION = ".,;:!?()[]\"«»„“”…"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable isn't evaluated again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that are found twice or more in the array `words`, the first included."""
    n = F.size(words)

    def counted(h: Column) -> Column:
        """From the windows' hashes: most texts repeat none, which one pass over them tells."""
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: _let(places(s), covered)))

    def places(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k + d)["h"] == F.get(s, k)["h"], F.lit(False))
        flags = F.transform(s, lambda x, k: F.when(same(k, -1) | same(k, 1), x["i"]))
        return F.sort_array(F.filter(flags, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - _WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(_WINDOW)]))

    found = _let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: _let(windows(w), counted))
    return F.when(n > _WINDOW, found).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """The counts of a text, a struct."""
    t = F.coalesce(text, F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, spaces, "") != "")
    stop = list(dict.fromkeys(STOP_WORDS))

    def by_word(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeats"),
            F.size(F.filter(w, lambda x: (F.length(x) <= STOP_CHARS) & F.lower(F.translate(x, PUNCTUATION, "")).isin(*stop))).cast("long").alias("stops"),
        )

    def by_line(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    def flat(q: Column) -> Column:
        named = {
            "n_words": q["w"]["n"], "word_chars": q["word_chars"], "n_symbols": q["n_symbols"], "n_dup_lines": q["l"]["dup"],
            "n_repeat_words": q["w"]["repeats"], "n_lines": q["l"]["n"], "n_stop_words": q["w"]["stops"],
        }
        return F.struct(*[v.alias(k) for k, v in named.items()])

    raw = F.struct(
        _let(words, by_word).alias("w"), _let(lines, by_line).alias("l"), F.length(F.translate(t, spaces, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    return _let(raw, flat)


def ratios(q: Column) -> dict[str, Column]:
    """What the threshold table may name, over the counts q."""
    n = q["n_words"]
    over = lambda x, y: F.when(y > 0, x / y)
    return {
        "n_words": n,
        "mean_word_chars": over(q["word_chars"], n),
        "symbol_ratio": over(q["n_symbols"], n),
        "stop_word_ratio": F.when(n < STOP_WORDS_FROM, F.lit(1.0)).otherwise(q["n_stop_words"] / n),
        "dup_line_ratio": over(q["n_dup_lines"], q["n_lines"]),
        "repeat_word_ratio": over(q["n_repeat_words"], n),
    }


def base_failed(q: Column) -> Column:
    """The rule that holds whatever the table says."""
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def verdict(q: Column, thresholds=THRESHOLDS) -> Column:
    """True where every bound of the table holds; a null measure breaks its bound."""
    known, ok = ratios(q), ~base_failed(q)
    for name, least, most in thresholds:
        if least is not None:
            ok = ok & (known[name] >= least)
        if most is not None:
            ok = ok & (known[name] <= most)
    return F.coalesce(ok, F.lit(False))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept."""
    q = F.col("__q")
    flat = docs.select("doc_id", measures(F.col("text")).alias("__q"))
    return flat.select("doc_id", *[q[c].alias(c) for c in COUNTS[:5]], base_failed(q).alias("base_failed"), verdict(q, thresholds).alias("kept"), *[q[c].alias(c) for c in COUNTS[5:]])


def keep(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The documents that pass, with the columns they came with: a filter on the text alone."""
    return docs.where(_let(measures(docs["text"]), lambda q: verdict(q, thresholds)))


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: length(x) <= {STOP_CHARS} AND lower(translate(x, '{PUNCTUATION}', '')) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       coalesce(NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND word_chars / n_words >= 1.5 AND word_chars / n_words <= 30 AND n_symbols / n_words <= 0.1
         AND (n_words < {STOP_WORDS_FROM} OR n_stop_words / n_words >= 0.01) AND n_dup_lines / n_lines <= 0.5, false) AS kept,
       n_lines, n_stop_words
FROM c
"""
