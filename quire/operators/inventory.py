"""The ordered, grouped inventory: display order, runs, numbering, pages of HTML and the filter over them.

Records come in the order of catalogue number, natural siglum, editor, year; consecutive
records of one label are a run, which is what the pages show as a group. Positions, runs
and running totals are numbered in range partitions, so no task sees all rows; a page of
HTML is put together from row strings, one file a part, in the order of the runs.

Defined results. A missing field is NULL in records and the marker in what is shown. Records
without a label are a group of their own under the marker. Ties are ordered by `order`, the
key that the caller names. Empty tables give no rows; a page without records has an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.ordering import global_index, running_sum
from quire.staging import stage

GROUP_INDEX = "index.html"
#: Heights of a heading and of a row where a page is cut by them. Fixed values.
GROUP_H, ROW_H = 44, 40
ITEM_BITS = 20
#: Credits of the corpus: name and city. Fixed values.
CORPUS_AUTHORS = (("Gerfrid Müller", "Würzburg"), ("Doris Prechel", "Mainz"), ("Elisabeth Rieken", "Marburg"), ("Daniel Schwemer", "Würzburg"))
#: Heading, class and legend of the columns shown. Fixed values.
COLUMNS = (
    ("№", "c-num", "row number"), ("Siglum", "c-sig", "publication id (e.g. KBo 3.22)"), ("Lang", "c-lang", "languages, most-used first (Hit, Hur…)"),
    ("Corpus", "c-corp", "edition series (HFR, TLH, HAnn…)"), ("Editor", "c-ed", "transliteration / edition author"), ("Year", "c-year", "edition year"),
)


def shown(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(T.MISSING))


def authors_line() -> str:
    return ", ".join(f"{name} ({city})" for name, city in CORPUS_AUTHORS)


def group_label() -> Column:
    return shown("cth")


def display_sorted(records: DataFrame, order: str, out: str = "rank") -> DataFrame:
    """records with their 0-based position in display order; `order` settles ties."""
    keyed = records.withColumns({"__sigla": T.natural_key(shown("sigla")), "__who": shown("authorship").cast("binary"), "__year": shown("year").cast("binary")})
    keys = [F.col(c) for c in ("cth_num", "__sigla", "__who", "__year", order)]
    return global_index(keyed, keys, out).drop("__sigla", "__who", "__year")


def with_runs(ranked: DataFrame, label: Column, rank: str = "rank", out: str = "run") -> DataFrame:
    """ranked plus the 0-based number of its run: rows next to each other in rank with one label.

    Rows are dealt in blocks of ranks and compared with the row before inside the block; one row
    a block carries its last label to the next, so no join over all rows and no single task.
    """
    w = Window.partitionBy("__block").orderBy(rank)
    blocks = ranked.withColumns({"__label": F.struct(label.alias("x")), "__block": F.floor(F.col(rank) / F.lit(_BLOCK)).cast("long")})
    lasts = blocks.groupBy("__block").agg(F.max_by("__label", rank).alias("__last")).select((F.col("__block") + 1).alias("__block"), "__last")
    before = F.coalesce(F.lag("__label").over(w), F.col("__last"))
    new = F.when(before.isNull() | ~before["x"].eqNullSafe(F.col("__label")["x"]), 1).otherwise(0).cast("long")
    inside = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.join(lasts, "__block", "left").withColumn("__new", new).withColumn("__inside", inside)
    local = stage(marked.drop("__last", "__label", "__new"), "runs")
    # One row a block of _BLOCK rows: the running sum over them is a small task.
    sums = local.groupBy("__block").agg(F.max("__inside").alias("n")).select("__block", F.coalesce(F.sum("n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return local.join(sums, "__block").withColumn(out, F.col("__base") + F.col("__inside") - 1).drop("__block", "__base", "__inside")


_BLOCK = 100_000


def numbered(runs: DataFrame, rank: str = "rank") -> DataFrame:
    """runs plus no (from 1 over all groups), first (the run's first position) and at (place in the run from 0)."""
    firsts = runs.groupBy("run").agg(F.min(rank).alias("first"), F.count("*").alias("run_size"))
    return runs.join(firsts, "run").withColumns({"no": F.col(rank) + 1, "at": F.col(rank) - F.col("first")})


def inventory(records: DataFrame, order: str) -> DataFrame:
    """records in display order with rank, run, first, run_size, no, at."""
    return numbered(with_runs(display_sorted(records, order), group_label()))


def runs_in_order(rows: DataFrame, order: str, label: str) -> DataFrame:
    """How many runs of one label the rows have in the order given: what a scan reports before it sorts."""
    ranked = global_index(rows.select(order, label), [F.col(order)], "rank")
    return with_runs(ranked, F.col(label)).agg(F.coalesce(F.max("run") + 1, F.lit(0)).alias("runs"))


# ---- HTML -----------------------------------------------------------------------------------------

def name_shown() -> Column:
    """The siglum under a group's heading, the whole title where there is none."""
    return F.when(F.col("cth").isNotNull() & F.col("sigla").isNotNull(), F.col("sigla")).otherwise(shown("title"))


def _link(href: Column, text: Column, extra: str = "") -> Column:
    return F.concat(F.lit(f'<a {extra}href="'), T.html_escape(href), F.lit('" target="_blank" rel="noopener">'), text, F.lit("</a>"))


def item_row(href: Column | None = None) -> Column:
    """The HTML of one record of `inventory`."""
    cell = lambda c: F.concat(F.lit("          <td>"), c, F.lit("</td>\n"))
    name = T.html_escape(name_shown())
    if href is not None:
        name = F.when(href.isNull(), name).otherwise(_link(href, name))
    return F.concat(
        F.lit('        <tr>\n          <td class="num">'), F.col("no").cast("string"), F.lit("</td>\n"), cell(name), *[cell(T.html_escape(shown(c))) for c in ("lang", "corpus", "authorship")],
        F.lit('          <td class="year">'), T.html_escape(shown("year")), F.lit("</td>\n        </tr>\n"),
    )


_TOGGLE = '<button type="button" class="group-toggle" aria-expanded="true"><span class="chevron" aria-hidden="true"></span>'


def heading_row(href: Column | None = None) -> Column:
    """The HTML of a run's heading, with its label and how many records it has."""
    label, count = T.html_escape(group_label()), F.concat(F.lit('<span class="group-count">'), F.col("run_size").cast("string"), F.lit("</span>"))
    plain = F.concat(F.lit(f'{_TOGGLE}<span class="group-label">'), label, F.lit("</span>"), count, F.lit("</button>"))
    inner = plain
    if href is not None:
        inner = F.when(href.isNull(), plain).otherwise(F.concat(F.lit(f'<span class="group-head">{_TOGGLE}</button>'), _link(href, label, 'class="group-label" '), count, F.lit("</span>")))
    return F.concat(F.lit('        <tr class="group">\n          <td colspan="6">'), inner, F.lit("</td>\n        </tr>\n"))


def html_rows(inv: DataFrame, href: Column | None = None, group_href: Column | None = None) -> DataFrame:
    """(rank, html): a page's rows in order, each run's heading with its first record."""
    heading = F.when(F.col("at") == 0, heading_row(group_href)).otherwise(F.lit(""))
    return inv.select("rank", F.concat(heading, item_row(href)).alias("html"))


def page_head(title: str, source: str, generated: str, manuscripts: int, groups: int, style: str = "") -> str:
    """All of a page up to its rows."""
    from html import escape

    e = lambda x: escape(x).replace("&#x27;", "&#39;")
    stamp = f"      <span>Generated: {e(generated)}</span>\n" if generated else ""
    legend = "".join(f'        <li><span class="k">{h}</span><span class="d">{x}</span></li>\n' for h, _, x in COLUMNS)
    columns = "".join("        " + "".join(f'<col class="{c}" />' for _, c, _ in COLUMNS[k : k + 3]) + "\n" for k in (0, 3))
    heads = "".join(f'          <th scope="col">{h}</th>\n' for h, *_ in COLUMNS)
    return (
        f'<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="utf-8" />\n  <title>{e(title)}</title>\n  <style>\n{style}  </style>\n</head>\n<body>\n'
        f'    <p class="meta">\n      <span>Source: {e(source)}</span>\n      <span>Corpus authors: {e(authors_line())}</span>\n{stamp}'
        f'      <span class="counts"><span class="count">Manuscripts: {manuscripts}</span><span class="count">Groups (CTH): {groups}</span></span>\n    </p>\n'
        f'    <section class="legend" aria-label="Column legend">\n      <p class="legend-title">Columns</p>\n      <ul class="legend-list">\n{legend}      </ul>\n    </section>\n'
        f'    <table id="inv">\n      <colgroup>\n{columns}      </colgroup>\n      <thead>\n        <tr>\n{heads}        </tr>\n      </thead>\n      <tbody>\n'
    )


PAGE_TAIL = "      </tbody>\n    </table>\n</body>\n</html>\n"


def counts(inv: DataFrame) -> DataFrame:
    """manuscripts and groups (runs)."""
    return inv.agg(F.count("*").alias("manuscripts"), F.coalesce(F.max("run") + 1, F.lit(0)).alias("groups"))


def write_page(inv: DataFrame, target: str, title: str, source: str, generated: str = "", href: Column | None = None, group_href: Column | None = None) -> None:
    """The page as one file at target. Rows stream through the driver partition by partition, in order; none is kept."""
    from quire.sources.files import write_through

    n = counts(inv).first()
    rows = stage(html_rows(inv, href, group_href), "rows").orderBy("rank").select("html")
    parts = (r["html"] for r in rows.toLocalIterator(prefetchPartitions=True))
    write_through(inv.sparkSession, target, (page_head(title, source, generated, n["manuscripts"], n["groups"]), parts, PAGE_TAIL))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def group_rows(inv: DataFrame, file: str, label: str, back: str) -> DataFrame:
    """(run, label, at, html): the page of each run row by row, the records listed with links to their files.

    The first row has the page's head and the last one its tail, so a page of any length is never one value.
    """
    dim = F.concat_ws(" · ", *[T.html_escape(shown(c)) for c in ("lang", "authorship", "year")])
    name = F.element_at(F.split(file, "/"), -1)
    line = F.concat(F.lit("  <li>"), _link(T.href(name), T.html_escape(F.col(label))), F.lit('<span class="dim">'), dim, F.lit("</span></li>\n"))
    title = T.html_escape(group_label())
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'), title, F.lit("</title>\n</head>\n<body>\n<h1>"), title, F.lit('</h1>\n<p class="meta">'),
        plural(F.col("run_size"), "manuscript", "manuscripts"), F.lit(f' · <a href="../{back}">back to the inventory</a></p>\n<ul>\n'),
    )
    tail = F.when(F.col("at") == F.col("run_size") - 1, F.lit("</ul>\n</body>\n</html>\n")).otherwise(F.lit(""))
    return inv.select("run", group_label().alias("label"), "at", F.concat(F.when(F.col("at") == 0, head).otherwise(F.lit("")), line, tail).alias("html"))


# ---- the filter over a page, and parts of it --------------------------------------------------------

def page_filter(inv: DataFrame, query: str, folded: DataFrame | None = None) -> DataFrame:
    """run, rank, hit, on_screen of the records that the page shows or holds back for a query.

    A label that holds the query stands for all its records; else the cells do, without number and
    inventory number. folded: runs (run) whose records are hidden but still count.
    """
    q = F.lit(query.strip().lower())
    cells = F.lower(F.concat_ws("\n", name_shown(), *[shown(c) for c in ("lang", "corpus", "authorship", "year")]))
    hits = inv.where((q == "") | F.contains(F.lower(group_label()), q) | F.contains(cells, q)).select("run", "rank")
    if folded is None:
        return hits.withColumn("on_screen", F.lit(True))
    closed = folded.select("run").distinct().withColumn("__folded", F.lit(True))
    return hits.join(closed, "run", "left").withColumn("on_screen", F.col("__folded").isNull()).drop("__folded")


def match_totals(hits: DataFrame) -> DataFrame:
    """matches, on_screen, and the line that tells them."""
    n = hits.agg(F.count("*").alias("matches"), F.count_if("on_screen").alias("on_screen"))
    m, s = thousands(F.col("matches")), thousands(F.col("on_screen"))
    said = F.when(F.col("matches") == 0, F.lit("No matches")).when(F.col("matches") == F.col("on_screen"), F.concat(F.lit("Match: "), m)).otherwise(F.concat(F.lit("Match: "), m, F.lit(" · "), s, F.lit(" shown")))
    return n.withColumn("said", said)


def layout(groups: DataFrame, run: str = "run", n: str = "n", open_all: bool = True) -> DataFrame:
    """groups plus item_base (records before the group) and group_y (its offset), running sums in the order of runs."""
    rows = F.col(n) if open_all else F.lit(0)
    height = groups.withColumn("__rows", rows.cast("long")).withColumn("__h", (F.lit(GROUP_H) + F.lit(ROW_H) * F.col("__rows")).cast("long"))
    placed = running_sum(running_sum(height, [F.col(run)], "__rows", "item_base"), [F.col(run)], "__h", "group_y")
    return placed.drop("__rows", "__h")


def visible(laid: DataFrame, y0: int, y1: int, run: str = "run", n: str = "n", open_all: bool = True) -> DataFrame:
    """The headings and rows between two offsets: run, at (null for a heading), top, number, key. Only those rows are made."""
    top, bottom = F.col("group_y"), F.col("group_y") + GROUP_H + (F.lit(ROW_H) * F.col(n) if open_all else F.lit(0))
    near = laid.where((F.lit(y1) > y0) & (top < y1) & (bottom > y0))
    heads = near.where(top + GROUP_H > y0).select(run, F.lit(None).cast("long").alias("at"), top.alias("top"), F.lit(None).cast("long").alias("number"), F.shiftleft(F.col(run).cast("long"), ITEM_BITS).bitwiseOR(F.lit((1 << ITEM_BITS) - 1)).alias("key"))
    if not open_all:
        return heads
    first = F.greatest(F.lit(0), F.floor((F.lit(y0) - top - GROUP_H) / ROW_H)).cast("long")
    last = F.least(F.col(n).cast("long"), F.ceil((F.lit(y1) - top - GROUP_H) / ROW_H).cast("long"))
    rows = near.withColumns({"__a": first, "__z": last}).where("__z > __a").withColumn("at", F.explode(F.sequence(F.col("__a"), F.col("__z") - 1)))
    return heads.unionByName(rows.select(run, "at", (top + GROUP_H + F.lit(ROW_H) * F.col("at")).alias("top"), (F.col("item_base") + F.col("at") + 1).alias("number"), F.shiftleft(F.col(run).cast("long"), ITEM_BITS).bitwiseOR(F.col("at")).alias("key")))


def coverage(records: DataFrame, *fields: str) -> DataFrame:
    """field, present, percent of records that have it; `below` compares with floors."""
    n = records.agg(F.count("*").alias("n"), *[F.count(f).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), F.when(F.col("n") > 0, F.round(100.0 * F.col(f) / F.col("n"), 4)).alias("percent")) for f in fields])
    return n.select(F.explode(rows).alias("x")).select("x.*")


def below(covered: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Fields whose share is under its floor."""
    floor = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(float(v)))])
    return covered.withColumn("floor", F.try_element_at(floor, F.col("field"))).where("percent < floor")


def empty_fields(published: DataFrame, *fields: str) -> DataFrame:
    """Published records with a field that is empty or null: there are none in a sound inventory."""
    bad = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in fields]))
    return published.withColumn("empty", bad).where(F.size("empty") > 0)


def stamp(at: Column) -> Column:
    """Whole seconds since 1970 as a UTC date and time in any session time zone; a year outside 0 to 9999 has the digits it needs, unpadded and without a plus."""
    second = F.pmod(at, F.lit(86400))
    day = F.date_from_unix_date(((at - second) / 86400).cast("int"))
    year = F.year(day).cast("string")
    shown = F.when(F.year(day).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = [two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60)]
    return F.concat(shown, F.lit("-"), two(F.month(day)), F.lit("-"), two(F.dayofmonth(day)), F.lit(" "), *clock, F.lit(" UTC"))
