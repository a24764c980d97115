"""The verified export: where documents go, what is written, and the proof that it is whole.

Documents are normalised in their prologue alone, placed at paths of their own, listed
in a manifest, checked against it both ways, and published by renaming a folder that
was validated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'
_SPACE = "[ \\t\\r\\n]"
#: A byte order mark, then white space and processing instructions.
_PROLOGUE = f"(?s)\\A\\x{{FEFF}}?{_SPACE}*+(?:<\\?.*?\\?>{_SPACE}*+)*+"
_INSTRUCTION = "(?s)<\\?.*?\\?>"
#: Instructions that may go.
_DROPPED = f"(?i)\\A<\\?(?:xml|xml-stylesheet)(?:{_SPACE}|\\?)"


def instructions(x: Column | str) -> Column:
    """The processing instructions before the first element, in order."""
    return F.regexp_extract_all(F.regexp_extract(T.col(x), _PROLOGUE, 0), F.lit(_INSTRUCTION), F.lit(0))


def body(x: Column | str) -> Column:
    """What follows the prologue."""
    return F.regexp_replace(T.col(x), _PROLOGUE, "")


def normalized(x: Column | str) -> Column:
    """The text under the one declaration: stylesheets and other declarations go, other instructions keep a line each, the body stays. Null: null."""
    kept = F.filter(instructions(x), lambda p: ~p.rlike(_DROPPED))
    return F.concat(F.lit(DECLARATION), F.array_join(F.transform(kept, lambda p: F.concat(p, F.lit("\n"))), ""), body(x))


def distortion(source: Column | str, output: Column | str) -> Column:
    """Why `output` isn't `source` normalised, or null: the body differs, the declaration is missing, an instruction was lost or invented."""
    had, has = instructions(source), instructions(output)
    lost = F.filter(F.array_except(had, has), lambda p: ~p.rlike(_DROPPED))
    invented = F.filter(F.array_except(has, had), lambda p: p != F.lit(DECLARATION.rstrip()))
    return (
        F.when(body(source) != body(output), "body differs").when(~F.startswith(T.col(output), F.lit(DECLARATION)), "no declaration")
        .when(F.size(lost) > 0, "instruction lost").when(F.size(invented) > 0, "instruction invented")
    )


def place(records: DataFrame, group: str, label: str, source: str, order: str) -> DataFrame:
    """records with `relative` and `pdf`: group/label.xml for the first of a path in `order`, which is unique; the folder
    of the source is added to the label of the others. A path's rows meet as one minimum, however many there are."""
    at = lambda name: F.concat(T.path_component(group), F.lit("/"), T.path_component(name), F.lit(".xml"))
    with_path = records.withColumn("__path", at(F.col(label)))
    first = with_path.groupBy("__path").agg(F.min(order).alias("__first"))
    folder = F.coalesce(F.try_element_at(F.split(source, "/"), F.lit(-2)), F.col(source))
    other = at(F.concat(F.col(label), F.lit(" ("), T.path_component(folder), F.lit(")")))
    placed = with_path.join(first, "__path").withColumn("relative", F.when(F.col(order) == F.col("__first"), F.col("__path")).otherwise(other))
    return placed.withColumn("pdf", F.regexp_replace("relative", "\\.xml$", ".pdf")).drop("__path", "__first")


def join_placements(entries: DataFrame, placed: DataFrame, source: str, order: str) -> DataFrame:
    """entries with the place of their source; of several places of one source the last in `order` counts, as the entry is written once."""
    last = placed.groupBy(source).agg(F.max_by("relative", order).alias("relative"))
    return entries.join(last, source)


def collisions(placed: DataFrame, source: str) -> DataFrame:
    """Paths that more than one document would take: relative, n, first (the least source). An export with any is refused."""
    return placed.groupBy("relative").agg(F.count("*").alias("n"), F.min(source).alias("first")).where("n > 1")


def percent_decode(x: Column | str) -> Column:
    """%XX as bytes of UTF-8; escapes that aren't any stay, and so does +."""
    safe = F.regexp_replace(T.col(x), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def resolve(href: Column | str) -> Column:
    """The path inside the package that a link leads to, or null: it has to begin with ./ and no step may be empty, a dot, two dots or hold a slash."""
    steps = F.transform(F.split(F.substring(T.col(href), 3, 1 << 30), "/"), percent_decode)
    bad = F.exists(steps, lambda s: s.isin("", ".", "..") | F.contains(s, F.lit("/")))
    return F.when(F.startswith(T.col(href), F.lit("./")) & ~bad, F.array_join(steps, "/"))


def manifest(placed: DataFrame, *columns: str) -> DataFrame:
    """One JSON line a document with `relative` as file and the columns named, `line`; keyed by relative."""
    return placed.select("relative", F.to_json(F.struct(F.col("relative").alias("file"), *columns)).alias("line"))


def manifest_files(lines: DataFrame) -> DataFrame:
    """The files that a manifest names."""
    return lines.select(F.get_json_object("line", "$.file").alias("relative"))


def flagged(sides: dict[str, DataFrame]) -> DataFrame:
    """(relative, a flag a side): every path with where it was met, by one partial aggregate."""
    every = None
    for name, df in sides.items():
        part = df.select("relative", *[F.lit(n == name).alias(n) for n in sides])
        every = part if every is None else every.unionByName(part)
    return every.groupBy("relative").agg(*[F.max(n).alias(n) for n in sides])


def violations(sides: dict[str, DataFrame]) -> DataFrame:
    """(missing_in, relative) for each listing of paths that lacks one which the first listing has, and the reverse."""
    known, *others = sides
    wrong = [F.when(F.col(known) & ~F.col(o), F.lit(o)) for o in others] + [F.when(F.col(o) & ~F.col(known), F.lit(f"{known} of {o}")) for o in others]
    return flagged(sides).select(F.explode(F.array_compact(F.array(*wrong))).alias("missing_in"), "relative")


def target_of(instruction: Column) -> Column:
    return F.lower(F.regexp_extract(instruction, r"\A<\?([^ \t\r\n?]*)", 1))


def rules(source: Column | str, output: Column | str) -> Column:
    """What was done to a document, by the names of the permitted rules; the leading mark goes without a name."""
    had, has = instructions(source), instructions(output)
    gone = F.transform(F.filter(had, lambda p: ~F.array_contains(has, p) & p.rlike(_DROPPED)), lambda p: F.concat(F.lit("DROP_PI "), target_of(p)))
    declared = F.exists(had, lambda p: target_of(p) == "xml")
    between = F.split(F.regexp_replace(F.regexp_extract(T.col(source), _PROLOGUE, 0), "\\A\\x{FEFF}", ""), _INSTRUCTION, -1)
    reflowed = F.exists(between, lambda w: (w != "") & (w != "\n"))
    return F.array_compact(F.concat(gone, F.array(F.when(~declared, F.lit("ADD declaration")), F.when(reflowed, F.lit("REFLOW prologue whitespace")))))


def rule_tally(documents: DataFrame, source: str) -> DataFrame:
    """rule, documents-times it was applied."""
    return documents.select(F.explode(rules(source, normalized(source))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def carries_stylesheet(x: Column | str) -> Column:
    return F.contains(T.col(x), F.lit("<?xml-stylesheet"))


# ---- the coverage that a renderer's fonts need ----------------------------------------------------

#: Name, first and last code point of the blocks that are counted. Fixed values.
BLOCKS = (
    ("Basic Latin", 0x0, 0x7F), ("Latin-1 Supplement", 0x80, 0xFF), ("Latin Extended-A", 0x100, 0x17F), ("General Punctuation", 0x2000, 0x206F),
    ("Block Elements", 0x2580, 0x259F), ("Arrows", 0x2190, 0x21FF), ("Latin Extended Additional", 0x1E00, 0x1EFF), ("Superscripts and Subscripts", 0x2070, 0x209F),
    ("Enclosed Alphanumerics", 0x2460, 0x24FF), ("Cuneiform", 0x12000, 0x1254F), ("Combining Diacritical Marks", 0x300, 0x36F), ("Spacing Modifier Letters", 0x2B0, 0x2FF),
    ("Miscellaneous Technical", 0x2300, 0x23FF), ("Currency Symbols", 0x20A0, 0x20CF), ("Supplementary Private Use Area-B", 0x100000, 0x10FFFD),
    ("Mathematical Operators", 0x2200, 0x22FF), ("Supplemental Punctuation", 0x2E00, 0x2E7F), ("Miscellaneous Mathematical Symbols-A", 0x27C0, 0x27EF),
    ("Control Pictures", 0x2400, 0x243F), ("Number Forms", 0x2150, 0x218F), ("Greek and Coptic", 0x370, 0x3FF), ("Hebrew", 0x590, 0x5FF),
    ("Private Use Area", 0xE000, 0xF8FF), ("Supplementary Private Use Area-A", 0xF0000, 0xFFFFD),
)
OTHER = "Other"


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in ranges)


#: Characters of the private use areas, combining marks, and of none of the blocks.
PRIVATE_USE = f"[{_class((a, z) for n, a, z in BLOCKS if 'Private Use' in n)}]"
COMBINING = "[\\x{300}-\\x{36F}]"
OUTSIDE = f"[^{_class((a, z) for _, a, z in BLOCKS)}]"


def block_of(code_point: Column) -> Column:
    """The name of a code point's block, or Other."""
    out = None
    for n, a, z in BLOCKS:
        out = (F.when if out is None else out.when)(code_point.between(a, z), F.lit(n))
    return out.otherwise(F.lit(OTHER))


def font_contract(documents: DataFrame, text: str) -> DataFrame:
    """One row: documents, not_nfc, private_use, and blocks, a map from each block met (and Other) to its documents.

    The first block is most of a text; what is left without it is short, and the other blocks are looked for there.
    """
    rest = F.col("__rest")
    t = documents.select(F.col(text).alias("__text"), F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x{0}-\\x{7F}]+", "").alias("__rest"))
    tests = [(n, F.col("__text").rlike("[\\x{0}-\\x{7F}]") if a == 0 else rest.rlike(f"[{_class([(a, z)])}]")) for n, a, z in BLOCKS] + [(OTHER, rest.rlike(OUTSIDE))]
    n = t.agg(F.count("*").alias("documents"), F.count_if(rest.rlike(COMBINING)).alias("not_nfc"), F.count_if(rest.rlike(PRIVATE_USE)).alias("private_use"), *[F.count_if(c).alias(f"b{k}") for k, (_, c) in enumerate(tests)])
    every = F.map_from_arrays(F.array(*[F.lit(x) for x, _ in tests]), F.array(*[F.col(f"b{k}") for k in range(len(tests))]))
    return n.select("documents", "not_nfc", "private_use", F.map_filter(every, lambda _, v: v > 0).alias("blocks"))


# ---- the package --------------------------------------------------------------------------------

MAX_DOCUMENT, MAX_INVENTORY = 64 << 20, 256 << 20
#: The rules that a package may apply, as its manifest states them. Fixed values.
PERMITTED = (
    "DROP_BOM: a leading U+FEFF",
    "DROP_PI xml: the declaration, replaced by a canonical one",
    "DROP_PI xml-stylesheet: HPMxml.css is not part of the package",
    'ADD declaration: <?xml version="1.0" encoding="UTF-8"?>',
    "REFLOW prologue whitespace: between prologue instructions, to one newline",
)
MANIFEST, INVENTORY_PAGE = "manifest.json", "inventory.html"


class Collision(ValueError):
    """Two documents would take one path."""


class Incomplete(ValueError):
    """Fewer documents were written than were placed."""


class Distorted(ValueError):
    """A document was written with another body than it came with."""


class Invalid(ValueError):
    """Links, files and manifest of a package disagree."""


def write_documents(placed: DataFrame, content: str, root: str) -> DataFrame:
    """One normalised file a document under root, made new: (relative, md5), staged.

    Each is written beside its place and moved there. A file that already stands there with the same bytes
    is an earlier attempt of the same task; with others, it is a collision and raises.
    """
    import pyarrow as pa

    from quire.staging import stage

    def write(batches):
        import hashlib

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            digests = []
            for relative, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, path = text.encode(), f"{base}/{relative}"
                digests.append(hashlib.md5(data).hexdigest())
                folder = path.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    with system.open_input_stream(path) as f:
                        if f.read() != data:
                            raise ValueError(f"{relative} is taken")
                    continue
                with system.open_output_stream(f"{path}.part") as f:
                    f.write(data)
                system.move(f"{path}.part", path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["relative", "md5"])

    return stage(placed.select("relative", normalized(content).alias("text")).mapInArrow(write, "relative string, md5 string"), "written")


def files_under(spark: SparkSession, root: str, pattern: str = "*.xml") -> DataFrame:
    """(relative, length) of the files under root whose name matches; each folder of root is listed by a task.

    Spark's own listing passes over names that begin with an underscore, which a place can have.
    """
    import pyarrow as pa
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    top = system.get_file_info(fs.FileSelector(base, recursive=False))
    folders = spark.createDataFrame([(x.base_name, x.type == fs.FileType.Directory, x.size or 0) for x in top], "name string, folder boolean, size long")

    def walk(batches):
        from fnmatch import fnmatchcase

        for b in batches:
            found = []
            for name, folder, size in zip(*(c.to_pylist() for c in b.columns)):
                inside = system.get_file_info(fs.FileSelector(f"{base}/{name}", recursive=True)) if folder else []
                found += [(x.path[len(base.rstrip("/")) + 1 :], x.size) for x in inside if x.type == fs.FileType.File and fnmatchcase(x.base_name, pattern)]
                found += [(name, size)] * (not folder and fnmatchcase(name, pattern))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (1, pa.int64()))], names=["relative", "length"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return folders.repartition(parts, "name").mapInArrow(walk, "relative string, length long")


def read_back(placed: DataFrame, content: str, root: str) -> DataFrame:
    """(relative, source, back): each document's text as it came and as it lies under root, null if it isn't there."""
    import pyarrow as pa

    def read(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for k in range(0, len(b), 64):
                part, found = b.slice(k, 64), []
                for relative in part.column(0).to_pylist():
                    try:
                        with system.open_input_stream(f"{base}/{relative}") as f:
                            found.append(f.read().decode("utf-8", "replace"))
                    except FileNotFoundError:
                        found.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["relative", "source", "back"])

    return placed.select("relative", F.col(content).alias("source")).mapInArrow(read, "relative string, source string, back string")


def manifest_rows(placed: DataFrame) -> DataFrame:
    """(rank, json): the documents of the manifest with their groups' brackets, in order; placed is an inventory with places."""
    from quire.operators.catalog import json_text
    from quire.operators.inventory import GROUP_INDEX, group_label, shown

    folder = T.path_component(group_label())
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), json_text(v))
    fields = {"siglum": shown("sigla"), "title": shown("title"), "file": F.col("relative"), "href": T.href("relative"), "pdf": F.col("pdf")}
    fields |= {"lang": shown("lang"), "corpus": shown("corpus"), "editor": shown("authorship"), "year": shown("year"), "inv": shown("inv")}
    row = F.concat(F.lit("{"), F.concat_ws(",", *[pair(k, v) for k, v in fields.items()]), F.lit("}"))
    head = F.concat(F.lit("{"), pair("label", group_label()), F.lit(","), pair("dir", folder), F.lit(","), pair("href", T.href(F.concat(folder, F.lit(f"/{GROUP_INDEX}")))), F.lit(',"documents":[\n'))
    opening = F.when(F.col("at") == 0, F.concat(F.when(F.col("run") == 0, F.lit("")).otherwise(F.lit(",\n")), head)).otherwise(F.lit(",\n"))
    return placed.select("rank", F.concat(opening, row, F.when(F.col("at") == F.col("run_size") - 1, F.lit("]}")).otherwise(F.lit(""))).alias("json"))


def write_manifest(placed: DataFrame, content: str, target: str, package: str, source: str, archive_md5: str) -> None:
    """The manifest as one JSON file: counts, permitted and applied rules, coverage, groups with their documents. Rows stream through."""
    import json

    from quire.operators.inventory import counts
    from quire.sources.files import write_through
    from quire.staging import stage

    # At most a row a rule and one of 25 blocks: bounded by the lists above.
    applied = {r["rule"]: r["n"] for r in rule_tally(placed, content).orderBy("rule").collect()}
    fonts = font_contract(placed.select(normalized(content).alias("text")), "text").first()
    n = counts(placed).first()
    head = {
        "schema": 1, "package": package, "inventory": INVENTORY_PAGE, "source": {"label": source, "archive_md5": archive_md5}, "counts": {"groups": n["groups"], "documents": n["manuscripts"]},
        "normalisation": {"permitted": list(PERMITTED), "applied": applied},
        "fonts": {"files_included": False, "documents_examined": fonts["documents"], "documents_not_in_nfc": fonts["not_nfc"], "documents_with_private_use": fonts["private_use"], "blocks": dict(sorted(fonts["blocks"].items()))},
    }
    rows = stage(manifest_rows(placed), "manifest").orderBy("rank").select("json")
    text = json.dumps(head, ensure_ascii=False, indent=1)[:-2] + ',\n "groups": [\n'
    write_through(placed.sparkSession, target, (text, (r["json"] for r in rows.toLocalIterator(prefetchPartitions=True)), "\n]}\n"))


def named_in(lines: DataFrame, key: str) -> DataFrame:
    """(value): every string that a key has in a JSON text given as lines."""
    found = F.regexp_extract_all("value", F.lit(f'"{key}": ?"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))
    text = F.concat(F.lit('{"x":"'), F.col("v"), F.lit('"}'))
    return lines.select(F.explode(found).alias("v")).select(F.get_json_object(text, "$.x").alias("value"))


def faults(spark: SparkSession, root: str, placed: DataFrame) -> DataFrame:
    """(message) of each disagreement between a package's page, files, manifest and the places; none in a sound package."""
    from quire.operators.inventory import GROUP_INDEX, group_label
    from quire.staging import stage

    hrefs = spark.read.text(f"{root}/{INVENTORY_PAGE}").select(F.explode(F.regexp_extract_all("value", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    links = stage(hrefs.select("href", resolve("href").alias("relative"), F.endswith("href", F.lit(GROUP_INDEX)).alias("index"), F.endswith("href", F.lit(".xml")).alias("file")), "links")
    lines = spark.read.text(f"{root}/{MANIFEST}")
    pdfs = named_in(lines, "pdf")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")

    def said(rows: DataFrame, checks: dict[str, Column], end: str = "") -> DataFrame:
        found = F.array_compact(F.array(*[F.when(c, F.concat(F.lit(f"{text}: "), F.col("relative"), F.lit(end))) for text, c in checks.items()]))
        return rows.select(F.explode(found).alias("message"))

    inside = links.where("relative is not null")
    files = flagged({"placed": placed, "disk": files_under(spark, root), "linked": inside.where("file"), "named": named_in(lines, "file").withColumnRenamed("value", "relative")})
    e, d, k, n = (F.col(c) for c in ("placed", "disk", "linked", "named"))
    out = said(files, {
        "document link points at nothing": k & ~d, "placed but not linked": e & ~(k & d), "linked but not placed": k & d & ~e, "orphan file in the package": d & ~e,
        "expected document missing": e & ~d, "not named in the manifest": e & ~n, "named in the manifest, not in the package": n & ~e,
    })
    groups = flagged({
        "inventory": placed.select(T.path_component(group_label()).alias("relative")), "linked": inside.where("index").select(folder("relative").alias("relative")),
        "page": files_under(spark, root, GROUP_INDEX).select(folder("relative").alias("relative")),
    })
    g, k, page = (F.col(c) for c in ("inventory", "linked", "page"))
    out = out.unionByName(said(groups, {"group link points at no page": k & ~page}, f"/{GROUP_INDEX}"))
    out = out.unionByName(said(groups, {"group without a working link": g & ~(k & page), "link to a group that is not in the inventory": k & page & ~g}))
    text = F.when(F.col("relative").isNull(), F.concat(F.lit("link is not a relative path inside the package: "), "href")).otherwise(F.concat(F.lit("link is neither a document nor a group page: "), "href"))
    out = out.unionByName(links.where("relative is null or (not file and not index)").select(text.alias("message")))
    listed, known = pdfs.agg(F.count("*").alias("n"), F.count_distinct("value").alias("d")).first(), placed.count()
    wrong = [f"the manifest lists {listed['n']} PDF names for {known} documents"] * (listed["n"] != known) + [f"the manifest gives {listed['d']} PDF names to {listed['n']} documents"] * (listed["n"] != listed["d"])
    return out.unionByName(spark.createDataFrame([(x,) for x in wrong], "message string"))


def first_faults(messages: DataFrame, most: int = 10) -> DataFrame:
    """The first faults by their text, each with the number of all."""
    return messages.orderBy("message").limit(most).withColumn("n", F.lit(messages.count()))


def refuse(messages: DataFrame, most: int = 10) -> None:
    """Raise with the number of faults and the first ten, if there are any."""
    if rows := first_faults(messages, most).collect():
        raise Invalid(f"{rows[0].n} faults: " + "; ".join(r.message for r in rows))


def build_package(spark: SparkSession, inv: DataFrame, content: str, source_path: str, target: str, title: str = "Inventory", source: str = "", archive_md5: str = "") -> dict:
    """Place, write, link and describe all documents of an inventory, check the whole in a folder beside, then put it at target.

    An older package at target is moved aside and brought back if the new one can't take its place. Returns counts.
    """
    from quire.operators.inventory import GROUP_INDEX, group_label, group_rows, shown, write_page
    from quire.staging import stage

    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)) and not fs.exists(path(f"{target}/{MANIFEST}")):
        raise ValueError(f"{target} holds something else")
    named = inv.withColumns({"__group": group_label(), "__label": shown("sigla")})
    placed = stage(place(named, "__group", "__label", source_path, "rank"), "placed")
    taken = placed.groupBy("pdf").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(source_path))[0].alias("first"), F.max(source_path).alias("second")).where("n > 1")
    if bad := taken.limit(10).collect():
        raise Collision("; ".join(f"{r.pdf}: {r['first']} and {r.second}" for r in bad))
    scratch = f"{target.rstrip('/')}.staging"
    fs.delete(path(scratch), True)
    written = write_documents(placed, content, scratch)
    documents = placed.count()
    if written.count() != documents:
        raise Incomplete(f"{written.count()} of {documents} documents were written")
    read = read_back(placed, content, scratch)
    wrong = read.select("relative", F.coalesce(distortion("source", "back"), F.when(F.col("back").isNull() & F.col("source").isNotNull(), "not there")).alias("error")).where("error is not null")
    if bad := wrong.limit(10).collect():
        raise Distorted("; ".join(f"{r.relative}: {r.error}" for r in bad))
    folder = T.path_component(group_label())
    write_page(placed, f"{scratch}/{INVENTORY_PAGE}", title, source, "", T.href("relative"), T.href(F.concat(folder, F.lit(f"/{GROUP_INDEX}"))))
    rows = group_rows(placed, "relative", "__label", INVENTORY_PAGE)
    # Runs of one label share a folder: the last one's page stands, as the inventory's order has it.
    last = placed.groupBy(group_label().alias("label")).agg(F.max("run").alias("run"))
    _write_pages(rows.join(last, ["label", "run"]).select(F.concat(T.path_component("label"), F.lit(f"/{GROUP_INDEX}")).alias("relative"), "at", "html"), scratch)
    write_manifest(placed, content, f"{scratch}/{MANIFEST}", target.rstrip("/").rpartition("/")[2], source, archive_md5)
    refuse(faults(spark, scratch, placed))
    aside = f"{target.rstrip('/')}.old"
    older = fs.exists(path(target))
    if older:
        fs.delete(path(aside), True)
        fs.rename(path(target), path(aside))
    if not fs.rename(path(scratch), path(target)):
        if older:
            fs.rename(path(aside), path(target))
        raise OSError(f"{target} could not be put in place")
    refuse(faults(spark, target, placed))
    if older:
        fs.delete(path(aside), True)
    n = placed.agg(F.count_if(carries_stylesheet(content)).alias("stylesheets"), F.count_if(F.contains("relative", F.concat(F.lit(" ("), T.path_component(F.coalesce(F.try_element_at(F.split(source_path, "/"), F.lit(-2)), F.lit("\x00"))), F.lit(")")))).alias("disambiguated")).first()
    return {"documents": documents, "stylesheets": n["stylesheets"], "disambiguated": n["disambiguated"]}


def _write_pages(rows: DataFrame, root: str) -> None:
    """Files under root from their rows (relative, at, html), each streamed as its rows come; written again by a repeated task."""
    import pyarrow as pa

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        path, out, n = None, None, 0

        def close():
            if out is not None:
                out.close()
                system.move(f"{path}.part", path)

        for b in batches:
            for relative, html in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if f"{base}/{relative}" != path:
                    close()
                    path, n = f"{base}/{relative}", n + 1
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(f"{path}.part")
                out.write(html.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("relative", "at", "html").repartition(parts, "relative").sortWithinPartitions("relative", "at")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def publish(spark: SparkSession, placed: DataFrame, content: str, target: str, *columns: str) -> DataFrame:
    """Write a table of files (relative, md5, content) and one of manifest lines, reread and check both, then rename the folder to `target`.

    `target` must not exist. Collisions, distortions of the original or a manifest that disagrees
    with the files raise ValueError and leave no target; executors write through Spark's committer only.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    end = fs_path(target)
    fs = end.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(end):
        raise ValueError(f"{target} exists")
    from quire.staging import stage

    placed = stage(placed.select("relative", F.col(content).alias("__source"), *columns), "placed")
    if (taken := collisions(placed, "relative").select("relative").limit(10).collect()):
        raise ValueError(f"paths taken twice: {[r.relative for r in taken]}")
    scratch = f"{target.rstrip('/')}.partial"
    fs.delete(fs_path(scratch), True)
    made = placed.select("relative", normalized("__source").alias("content"), *columns)
    made.withColumn("md5", F.md5(F.col("content").cast("binary"))).write.parquet(f"{scratch}/files")
    files = spark.read.parquet(f"{scratch}/files")
    manifest(files, "md5", *columns).write.parquet(f"{scratch}/manifest")
    lines = spark.read.parquet(f"{scratch}/manifest")
    judged = files.join(placed.select("relative", "__source"), "relative").where(distortion("__source", "content").isNotNull() | (F.col("md5") != F.md5(F.col("content").cast("binary"))))
    wrong = judged.select("relative").unionByName(violations({"placed": placed, "disk": files, "manifest": manifest_files(lines)}).select("relative"))
    if bad := wrong.limit(10).collect():
        fs.delete(fs_path(scratch), True)
        raise ValueError(f"package is not whole: {[r.relative for r in bad]}")
    if not fs.rename(fs_path(scratch), end):
        raise ValueError(f"{target} could not be put in place")
    return spark.read.parquet(f"{target}/files").select("relative", "md5", "content", *columns)
