"""The export's prologue, places and links on fixtures, and publishing as a whole."""

import pytest
from pyspark.sql import functions as F

from quire.operators import export as E

HEAD = E.DECLARATION


@pytest.mark.parametrize(
    "source, want",
    [
        ("<a/>", HEAD + "<a/>"),
        ("﻿ <?xml version='1.0'?>\n<?XML-stylesheet x?> <?keep me?>\n\n<a>\n <?in body?></a>\n", HEAD + "<?keep me?>\n<a>\n <?in body?></a>\n"),
        ("<?xmlfoo y?><a/>", HEAD + "<?xmlfoo y?>\n<a/>"),
        ("<?unclosed <a/>", HEAD + "<?unclosed <a/>"),
        ("", HEAD),
        (None, None),
    ],
)
def test_normalized(spark, source, want):
    df = spark.createDataFrame([(source,)], "x string").withColumn("y", E.normalized("x"))
    row = df.select("y", E.distortion("x", "y").alias("e")).first()
    assert row.y == want and row.e is None


def test_distortion(spark):
    rows = [("<?k 1?><a/>", HEAD + "<a/>"), ("<a/>", HEAD + "<?n?>\n<a/>"), ("<a/>", HEAD + "<a />"), ("<a/>", "<a/>")]
    got = spark.createDataFrame(rows, "x string, y string").select(E.distortion("x", "y").alias("e")).collect()
    assert [r.e for r in got] == ["instruction lost", "instruction invented", "body differs", "no declaration"]


def test_resolve(spark):
    cases = {"./CTH%2096/544%252Ff.xml": "CTH 96/544%2Ff.xml", "./a+b/%zz": "a+b/%zz", "./": None, "/etc": None, "./../x": None, "./a/%2E%2E/b": None, "./a%2Fb": None, "./a//b": None, "x": None}
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", E.resolve("h").alias("p")).collect()
    assert {r.h: r.p for r in got} == cases


def _records(spark, *rows):
    return spark.createDataFrame([(i, *r, f"<a>{i}</a>") for i, r in enumerate(rows)], "no long, grp string, label string, source string, xml string")


def test_place(spark):
    rows = [("CTH 1", "A/1", "x/CTH 1_XML_HFR/a.xml"), ("CTH 1", "A/1", "x/CTH 1_XML_TLH/a.xml"), ("CTH 2", "A/1", "x/CTH 2_XML_TLH/a.xml")]
    placed = E.place(_records(spark, *rows), "grp", "label", "source", "no")
    assert {r.no: r.relative for r in placed.collect()} == {0: "CTH 1/A%2F1.xml", 1: "CTH 1/A%2F1 (CTH 1_XML_TLH).xml", 2: "CTH 2/A%2F1.xml"}
    assert E.collisions(placed, "source").count() == 0
    third = E.place(_records(spark, *rows, rows[1]), "grp", "label", "source", "no")
    assert [(r.relative, r.n) for r in E.collisions(third, "source").collect()] == [("CTH 1/A%2F1 (CTH 1_XML_TLH).xml", 2)]


def test_publish(spark, tmp_path):
    rows = [("g", f"n{i}", f"d/s{i}.xml") for i in range(5)]
    placed = E.place(_records(spark, *rows), "grp", "label", "source", "no")
    out = E.publish(spark, placed, "xml", f"file://{tmp_path}/package", "label")
    assert {r.relative: r.content for r in out.collect()} == {f"g/n{i}.xml": f"{HEAD}<a>{i}</a>" for i in range(5)}
    lines = spark.read.parquet(f"file://{tmp_path}/package/manifest")
    assert E.violations({"placed": placed, "manifest": E.manifest_files(lines)}).count() == 0
    with pytest.raises(ValueError, match="exists"):
        E.publish(spark, placed, "xml", f"file://{tmp_path}/package")
    twice = placed.unionByName(placed.limit(1))
    with pytest.raises(ValueError, match="twice"):
        E.publish(spark, twice, "xml", f"file://{tmp_path}/other")
    missing = E.violations({"placed": placed, "disk": placed.where(F.col("no") > 0)}).collect()
    assert [(r.missing_in, r.relative) for r in missing] == [("disk", "g/n0.xml")]


def test_empty(spark, tmp_path):
    assert E.publish(spark, E.place(spark.createDataFrame([], "no long, grp string, label string, source string, xml string"), "grp", "label", "source", "no"), "xml", f"file://{tmp_path}/none").count() == 0


def _inventory(spark):
    from quire.operators import inventory
    from quire.operators.markup import SCHEMA

    rows = [(i, None, s, g, n, "E", "2020", "Hit", None, "HFR", f"x/{d}/f{i}.xml", x) for i, (s, g, n, d, x) in enumerate([
        ("544/f", "CTH 1", 1, "CTH 1_XML_HFR", "<?xml version='1.0'?>\n<?xml-stylesheet a?><a>é</a>"), ("544/f", "CTH 1", 1, "CTH 1_XML_TLH", "<b/>"), ("..", "CTH 2", 2, "d", "﻿<?keep?><c/>"), (None, None, 4294967295, "e", "<d/>"),
    ])]
    return inventory.inventory(spark.createDataFrame(rows, f"k long, {SCHEMA}, path string, xml string"), "k")


def test_package(spark, tmp_path):
    import json

    inv, target = _inventory(spark), f"file://{tmp_path}/package"
    assert E.build_package(spark, inv, "xml", "path", target, "T", "s", "0" * 32) == {"documents": 4, "stylesheets": 1, "disambiguated": 1}
    root = tmp_path / "package"
    files = {p.relative_to(root).as_posix(): p.read_text() for p in root.rglob("*.xml")}
    assert files == {"CTH 1/544%2Ff.xml": f"{HEAD}<a>é</a>", "CTH 1/544%2Ff (CTH 1_XML_TLH).xml": f"{HEAD}<b/>", "CTH 2/_...xml": f"{HEAD}<?keep?>\n<c/>", "—/—.xml": f"{HEAD}<d/>"}
    m = json.loads((root / "manifest.json").read_text())
    assert m["counts"] == {"groups": 3, "documents": 4} and [g["label"] for g in m["groups"]] == ["CTH 1", "CTH 2", "—"]
    assert m["normalisation"]["applied"] == {"ADD declaration": 3, "DROP_PI xml": 1, "DROP_PI xml-stylesheet": 1}
    assert m["fonts"]["blocks"] == {"Basic Latin": 4, "Latin-1 Supplement": 1} and m["groups"][0]["documents"][0]["href"] == "./CTH%201/544%252Ff.xml"
    # A second time over the first, then every kind of damage.
    E.build_package(spark, inv, "xml", "path", target)
    placed = E.place(inv.withColumns({"g": F.coalesce("cth", F.lit("—")), "l": F.coalesce("sigla", F.lit("—"))}), "g", "l", "path", "rank").cache()
    assert E.faults(spark, target, placed).count() == 0
    (root / "CTH 1" / "544%2Ff.xml").rename(root / "CTH 1" / "orphan.xml")
    (root / "CTH 2" / "index.html").unlink()
    page = root / "inventory.html"
    page.write_text(page.read_text().replace('href="./%E2%80%94/%E2%80%94.xml"', 'href="../out.xml"'))
    manifest = root / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"file":"CTH 1/544%2Ff (CTH 1_XML_TLH).xml"', '"file":"CTH 1/other.xml"').replace('.pdf"', '"', 1).replace('"pdf":"—/—.pdf"', '"pdf":"CTH 1/544%2Ff"'))
    for crc in root.rglob(".*.crc"):
        crc.unlink()
    said = {r.message for r in E.faults(spark, target, placed).collect()}
    assert said == {
        "link is not a relative path inside the package: ../out.xml", "document link points at nothing: CTH 1/544%2Ff.xml", "placed but not linked: CTH 1/544%2Ff.xml", "placed but not linked: —/—.xml",
        "orphan file in the package: CTH 1/orphan.xml", "expected document missing: CTH 1/544%2Ff.xml", "not named in the manifest: CTH 1/544%2Ff (CTH 1_XML_TLH).xml",
        "named in the manifest, not in the package: CTH 1/other.xml", "group link points at no page: CTH 2/index.html", "group without a working link: CTH 2", "the manifest gives 3 PDF names to 4 documents",
    }
    with pytest.raises(E.Invalid, match="11 faults"):
        E.refuse(E.faults(spark, target, placed))
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="something else"):
        E.build_package(spark, inv, "xml", "path", f"file://{tmp_path}/other")
    with pytest.raises(E.Collision):
        E.build_package(spark, inv.unionByName(inv.where("k = 1").withColumn("rank", F.lit(9).cast("long"))), "xml", "path", f"file://{tmp_path}/twice")


def test_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a/b.xml", "<a/>")], "relative string, xml string")
    E.write_documents(df, "xml", f"file://{tmp_path}/w")
    assert E.write_documents(df, "xml", f"file://{tmp_path}/w").count() == 1  # a repeated task finds its own file
    with pytest.raises(Exception, match="is taken"):
        E.write_documents(df.withColumn("xml", F.lit("<b/>")), "xml", f"file://{tmp_path}/w")
