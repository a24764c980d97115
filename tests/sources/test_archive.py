import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators.markup import extract, languages, record
from quire.sources import archive
from quire.sources.archive import read, skipped, wanted

HEAD = "<AOxml><AOHeader><docID>{id}</docID><meta><uebern editor='FB' date='2017-03-28'/><annot editor=\"SG\" date='2021'/></meta></AOHeader><body lg='Hit'><w lg='Akk'/><w lg='Hitt'/></body></AOxml>"


@pytest.mark.parametrize("path, kept", [
    ("TLHbasis/CTH 786_XML_HFR/KBo 17.86+.xml", True), ("CTH 1_XML/İK 174-66.XML", True), ("KBo 1.xml", True), ("__MACOSX/CTH 1_XML/KBo 1.xml", False),
    ("CTH 1_XML/.hidden/KBo 1.xml", False), ("CTH 1_XML/._KBo 1.xml", False), ("CTH 1_XML/HPMxml.css.xml", False), ("CTH 1_XML/", False), ("notes.txt", False), (".xml", False),
])
def test_path_gate(path, kept, spark):
    from quire.functions.text import is_document_path

    assert wanted(path) == kept
    assert spark.createDataFrame([(path,)], "p string").select(is_document_path("p")).first()[0] == kept


def test_archive_to_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("r/CTH 786_XML_HFR/KBo 17.86+.xml", HEAD.format(id="KBo 17.86+"))
        z.writestr("r/CTH 12_XML_TLH/544.xml", HEAD.format(id="€1}"))
        z.writestr("r/__MACOSX/x.xml", HEAD)
        z.writestr("r/page.xml", "<html/>")
        z.writestr("r/.DS_Store", "x")
    got = extract(read(spark, f"file://{tmp_path}/*.zip"), "ordinal", "path", "content").orderBy("ordinal").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("KBo 17.86+ · CTH 786", "KBo 17.86+", "CTH 786", 786, "FB", "2017", "Hit, Akk", None, "HFR"),
        ("544 · CTH 12", "544", "CTH 12", 12, "FB", "2017", "Hit, Akk", None, "TLH"),
    ]
    assert tuple(skipped(spark, f"file://{tmp_path}/*.zip").first()) == (1, 1)


def test_fields():
    assert record("a/b.xml", "")["sigla"] == "b" and record("a/b.xml", "")["cth_num"] == 4294967295
    assert languages("<!-- lg='Hat' --><w flg='x' lg=\"Hit\"/><w lg='ign'/><w lg='Lu'/>") == ["Hat", "Hit", "Lu"]
    two = record("x.xml", "<AOHeader><docID>€1}</docID><TxtPubl>A {€1}+B {€2}</TxtPubl><author author='D S' date='2026-05-11'/></AOHeader>")
    assert two["sigla"] == "A" and two["authorship"] == "D S" and two["year"] == "2026"
    assert record("x.xml", "<AOHeader><e src='MZ' editor='auto'/><f editor='SG' date='2021'/></AOHeader>")["authorship"] == "SG"
    assert record("x.xml", "<AOHeader></AOHeader><inv>VAT 1</inv><AO:InvNr>VAT 7479</AO:InvNr>")["inv"] == "VAT 7479"
    assert record("x.xml", "<cth neu='786'/><docID>unclosed <b 2021")["cth"] == "CTH 786"
    for text in ("<", "<a", "<!--", "<![CDATA[", "<?x", "</", "<a b='", None):
        record("p", text)


def zipped(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, text in entries:
            z.writestr(name, text)
    return f"file://{path}"


def test_no_document_and_damage(spark, tmp_path):
    with pytest.raises(archive.EmptyArchive):
        read(spark, zipped(tmp_path / "none.zip", [("a.txt", "x"), ("p.xml", "<html/>"), ("e.xml", "")]))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(archive.BadArchive, match="bad.zip"):
        read(spark, f"file://{tmp_path}/bad.zip")
    path = zipped(tmp_path / "cut.zip", [("a.xml", HEAD.format(id="a") + "x" * 5000)])
    data = bytearray((tmp_path / "cut.zip").read_bytes())
    data[60:90] = bytes(30)
    (tmp_path / "cut.zip").write_bytes(bytes(data))
    with pytest.raises(archive.BadArchive, match="a.xml"):
        read(spark, path, whole=True)


def test_too_large(spark, tmp_path, monkeypatch):
    big = HEAD.format(id="a") + " " * archive.MAX_DOCUMENT
    path = zipped(tmp_path / "big.zip", [("a.xml", big)])
    assert read(spark, path).count() == 1
    with pytest.raises(archive.DocumentTooLarge, match="a.xml"):
        read(spark, path, whole=True)


def test_windows_duplicates_and_repair(spark, tmp_path):
    with pytest.warns(UserWarning):
        path = zipped(tmp_path / "a.zip", [("a.xml", HEAD.format(id="é" * 9000)), ("a.xml", HEAD.format(id="two")), ("b.xml", b"<TEI>\xff\xc3</TEI>")], zipfile.ZIP_STORED)
    rows = {r.ordinal: r.content for r in read(spark, path).collect()}
    assert len(rows) == 3 and len(rows[0]) < 9000 and "two" in rows[1] and rows[2] == "<TEI>\ufffd\ufffd</TEI>"
    assert {r.ordinal: len(r.content) for r in read(spark, path, whole=True).collect()}[0] > 9000
    assert {r.stage: r.documents for r in archive.timings(spark, path).collect()} == {"read": 3, "gate": 3, "parse": 3}
    assert archive.report(2, 1) == "Skipped 3 entries: 2 by path, 1 by content" and archive.report(0, 0) is None


def test_entries_are_read_by_several_tasks(spark, tmp_path):
    import random

    rng = random.Random(1)
    path = zipped(tmp_path / "a.zip", [(f"d/{i}.xml", HEAD.format(id=i) + "".join(rng.choice("abcdefgh") for _ in range(3000))) for i in range(600)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = archive.entries(spark, path)
        assert found.rdd.getNumPartitions() > 1 and archive.scan(found).where("gate is null").count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("path, xml, field, want", [
    ("x.xml", "<AOHeader><creation-date date='2014'/><annot date='2021'/></AOHeader>", "year", "2014"),
    ("x.xml", "<AOHeader><kor2 date='x'/><kor1 date='2015-1'/></AOHeader>", "year", "2015"),
    ("x.xml", "<AOHeader><date>20170328</date></AOHeader>", "year", "2017"),
    ("x.xml", "<AOHeader><date>in 1999</date></AOHeader>", "year", "1999"),
    ("x.xml", "<AOHeader></AOHeader><cth n='99'/>", "cth", None),
    ("x.xml", "<AOHeader><cth alt='12.3 x'/></AOHeader>", "cth", "CTH 12.3 x"),
    ("x.xml", "<AOHeader><docID>€1}</docID></AOHeader><docID>no</docID>", "sigla", "x"),
    ("x.xml", "<AOHeader><f editor='' author='A'/></AOHeader>", "authorship", None),
    ("x.xml", "<AOHeader><editor editor=SG date='2020'/><annot editor='B'/></AOHeader>", "authorship", "B"),
    ("x.xml", "<a lg = 'Hit'/><a lg=' Lu'/><a lg='Akkadisch'/>", "lang", " Lu"),
    ("x.xml", "<a lg=\"a lg='Hur'\"/>", "lang", "Hur"),
    ("x.xml", "<AOHeader><![CDATA[<docID>no</docID>]]><docID><![CDATA[a<b]]></docID>", "sigla", "a<b"),
    ("x.xml", "<AOHeader><a <docID>yes</docID>", "sigla", "yes"),
    ("a/_XML_/b_xml_TLH/c.xml", "", "corpus", "TLH"),
    ("/.xml", "", "sigla", ".xml"), (None, None, "sigla", None),
])
def test_rules(path, xml, field, want):
    assert record(path, xml)[field] == want


def test_scan_and_elements(spark):
    from quire.operators.markup import element_text, published, scan

    df = spark.createDataFrame([(1, "<!-- <a> --><A:b c='1' d=\"e\">t<i>x</i></A:b><br/>"), (2, None), (3, "<x")], "k long, x string")
    assert [(r.k, r.closing, r.local) for r in scan(df, "k", "x").orderBy("k", "at").collect()] == [(1, False, "b"), (1, False, "i"), (1, True, "i"), (1, True, "b"), (1, False, "br")]
    assert {r.k: r.value for r in element_text(df, "k", "x", "b").collect()} == {1: "tx", 2: None, 3: None}
    assert {r.k: r.value for r in element_text(df, "k", "x", "b", "D").collect()} == {1: "e", 2: None, 3: None}
    got = published(extract(df.withColumn("p", F.lit("q/w.xml")), "k", "p", "x")).where("k = 2").first()
    assert got.sigla == "w" and got.year == "—" and got.cth_num == 4294967295
    assert extract(df.where("false").withColumn("p", F.lit("")), "k", "p", "x").count() == 0
