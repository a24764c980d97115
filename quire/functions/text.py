"""Column expressions over strings: natural order, markup, names, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is published where a value is missing. Inside the engine it is NULL.
MISSING = "—"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U64 = "18446744073709551615"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x: Column | str) -> Column:
    return F.translate(col(x), _UPPER, _LOWER)


def natural_key(x: Column | str) -> Column:
    """Order of names with numbers in them: runs of digits by value (beyond 64 bits: 0), before text; text by ASCII-lower bytes."""
    runs = F.regexp_extract_all(col(x), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = p.rlike("^[0-9]")
        short = F.length(F.regexp_replace(p, "^0+", "")) <= 20
        n = F.when(digits & short, p.try_cast("decimal(38,0)"))
        n = F.when(n <= F.lit(_U64).cast("decimal(38,0)"), n)
        return F.struct(F.when(digits, 0).otherwise(1).alias("t"), F.coalesce(n, F.lit(0).cast("decimal(38,0)")).alias("n"), F.when(digits, "").otherwise(ascii_lower(p)).alias("s"))

    return F.transform(runs, part)


def strip_tags(x: Column | str) -> Column:
    """Text of markup: CDATA kept as it is, comments and instructions dropped, an unclosed < ends it."""
    return F.regexp_replace(col(x), r"(?s)<!\[CDATA\[(.*?)(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)|<[^>]*>|<.*\z", "$1")


def collapse_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def html_escape(x: Column | str) -> Column:
    out = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def without_controls(x: Column, written) -> Column:
    """x with each control character written another way; text without any, the usual case, is only looked over."""
    each = F.transform(F.split(x, ""), lambda c: F.when((c != "") & ((F.ascii(c) < 32) | (F.ascii(c) == 127)), written(c)).otherwise(c))
    return F.when(x.rlike("[\\x00-\\x1F\\x7F]"), F.array_join(each, "")).otherwise(x)


def path_component(x: Column | str) -> Column:
    """A name that is safe as one step of a path: separators and controls as %XX, no trailing space or dot (but where
    nothing else is left), `_` before a leading dot or nothing."""
    out = F.replace(F.replace(F.replace(col(x), F.lit("/"), F.lit("%2F")), F.lit("\\"), F.lit("%5C")), F.lit(":"), F.lit("%3A"))
    out = without_controls(out, lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c).cast("long")), 2, "0")))
    out = F.when(out.rlike("^[ .]*$"), out).otherwise(F.regexp_replace(out, "[ .]+\\z", ""))
    return F.when((out == "") | F.startswith(out, F.lit(".")), F.concat(F.lit("_"), out)).otherwise(out)


def byte_window(x: Column | str, most: int) -> Column:
    """The first `most` bytes of a text, without a character cut in two."""
    head = F.substring(col(x).cast("binary"), 1, most)
    return F.when(F.octet_length(col(x)) <= most, col(x)).otherwise(F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\\x{FFFD}\\z", ""))


def href(path: Column | str) -> Column:
    """A relative link to a path: each step percent-encoded but for the unreserved characters."""
    def step(s: Column) -> Column:
        return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    return F.concat(F.lit("./"), F.array_join(F.transform(F.split(col(path), "/"), step), "/"))


def year_in(x: Column | str) -> Column:
    """The first 19xx or 20xx that no digit touches."""
    return F.nullif(F.regexp_extract(col(x), "(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit(""))


def date_year(x: Column | str) -> Column:
    """The leading four digits of a date, if they are a year from 1900 to 2100; what follows them isn't looked at."""
    y = F.regexp_extract(col(x), "^\\s*([0-9]{4})", 1)
    return F.when(y.between("1900", "2100"), y)


def number_after(x: Column | str, token: str) -> Column:
    """Digits and dots after a token (any case) and white space, without trailing dots."""
    return F.nullif(F.rtrim(F.regexp_extract(col(x), f"(?i){token}\\s*([0-9][0-9.]*)", 1), F.lit(".")), F.lit(""))


def is_document_path(path: Column | str) -> Column:
    """The path gate of the archive scan."""
    p = col(path)
    low = ascii_lower(p)
    hidden = F.exists(F.split(p, "/"), lambda s: (ascii_lower(s) == "__macosx") | F.startswith(s, F.lit(".")))
    return ~F.endswith(p, F.lit("/")) & F.endswith(low, F.lit(".xml")) & ~hidden & ~F.endswith(low, F.lit(".css.xml"))


def has_marker(window: Column | str) -> Column:
    """The content gate: one of the five markers, any case."""
    return ascii_lower(window).rlike("<aoxml|<aoheader|<docid|<tei|<teiheader")
