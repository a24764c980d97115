import json

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, inventory
from quire.operators import search as S
from quire.operators.markup import SCHEMA

ROWS = [
    (0, None, "KBo 3.22", "CTH 12", 12, "LS", "2021", "Hit", None, "HFR"), (1, None, "KBo 22.5", "CTH 12.1", 12, "LS", "2021", "Hit", None, "HFR"),
    (2, None, "kbo 3.3", "CTH 12", 12, None, None, None, "Bo 1", None), (3, "T", None, "CTH 2", 2, "A & B", "2020", "Hur", None, None),
    (4, "KBo 1", "KBo 1", None, 4294967295, "DS", "1999", None, None, "TLH"), (5, "KBo 1", "KBo 1", None, 4294967295, "DS", "1999", None, None, "TLH"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, f"k long, {SCHEMA}")


def test_order_and_runs(records):
    got = inventory.inventory(records, "k").orderBy("rank").collect()
    assert [r.k for r in got] == [3, 2, 0, 1, 4, 5]
    assert [r.run for r in got] == [0, 1, 1, 2, 3, 3] and [r["at"] for r in got] == [0, 0, 1, 0, 0, 1]
    assert [r.no for r in got] == [1, 2, 3, 4, 5, 6]


def test_one_label_can_have_several_runs(spark):
    rows = [(i, None, f"K {i}", "CTH 1" if i % 2 else "CTH 1.1", 1, *[None] * 5) for i in range(6)]
    got = inventory.inventory(spark.createDataFrame(rows, f"k long, {SCHEMA}"), "k")
    assert got.select("run").distinct().count() == 6


def test_runs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(inventory, "_BLOCK", 3)
    labels = [None, None, "a", "a", "a", "a", "a", "b", "a", None]
    df = spark.createDataFrame(list(enumerate(labels)), "rank long, x string")
    got = [r.run for r in inventory.with_runs(df, F.col("x")).orderBy("rank").collect()]
    assert got == [0, 0, 1, 1, 1, 1, 1, 2, 3, 4]


def test_page(spark, records, tmp_path):
    inv = inventory.inventory(records, "k")
    inventory.write_page(inv, f"file://{tmp_path}/p.html", "T & t", "s", href=F.concat(F.lit("./x/"), F.col("k").cast("string")))
    page = (tmp_path / "p.html").read_text()
    assert "<title>T &amp; t</title>" in page and "Manuscripts: 6" in page and "Groups (CTH): 4" in page
    assert '<a href="./x/3" target="_blank" rel="noopener">T</a>' in page and "<td>A &amp; B</td>" in page and page.count("<tr>\n          <td") == 6
    inventory.write_page(inv.where("false"), f"file://{tmp_path}/p.html", "none", "s")
    assert "Manuscripts: 0" in (tmp_path / "p.html").read_text()


def test_filter(records, spark):
    inv = inventory.inventory(records, "k")
    ks = lambda q: {r.k for r in inv.join(inventory.page_filter(inv, q), ["run", "rank"]).collect()}
    assert ks("") == set(range(6)) and ks(" CTH 12") == {0, 1, 2} and ks("bo 1") == {4, 5} and ks("hit\nhfr") == {0, 1}
    totals = lambda q, f=None: inventory.match_totals(inventory.page_filter(inv, q, f)).first().said
    assert totals("zzz") == "No matches" and totals("cth 12") == "Match: 3"
    assert totals("cth 12", spark.createDataFrame([(1,)], "run long")) == "Match: 3 · 1 shown"


def test_layout(spark):
    groups = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "run long, n long")
    laid = inventory.layout(groups)
    assert [(r.item_base, r.group_y) for r in laid.orderBy("run").collect()] == [(0, 0), (2, 124), (2, 168)]
    rows = [(r.run, r["at"], r.top, r.number) for r in inventory.visible(laid, 100, 220).orderBy("top").collect()]
    assert rows == [(0, 1, 84, 2), (1, None, 124, None), (2, None, 168, None), (2, 0, 212, 3)]
    assert inventory.visible(laid, 50, 50).count() == 0 and inventory.visible(laid.where("false"), 0, 99).count() == 0
    closed = inventory.layout(groups, open_all=False)
    assert [(r.run, r.top) for r in inventory.visible(closed, 0, 90, open_all=False).orderBy("run").collect()] == [(0, 0), (1, 44), (2, 88)]


def test_coverage(records):
    got = {r.field: (r.present, round(r.percent, 2)) for r in inventory.coverage(records, "year", "inv").collect()}
    assert got == {"year": (5, 83.33), "inv": (1, 16.67)}
    assert [r.field for r in inventory.below(inventory.coverage(records, "year", "inv"), {"year": 80, "inv": 20}).collect()] == ["inv"]


def test_catalog_file(spark, records, tmp_path):
    odd = records.unionByName(records.where("k = 0").withColumns({"k": F.lit(9).cast("long"), "sigla": F.lit('q"\\\n\t\x01é'), "cth": F.lit("CTH 99"), "cth_num": F.lit(99).cast("long")}))
    inv = inventory.inventory(odd, "k")
    catalog.write(inv, 'a "b"', f"file://{tmp_path}/c.json")
    w = json.loads((tmp_path / "c.json").read_text())
    assert (w["s"], w["m"], w["v"], len(w["g"])) == ('a "b"', 7, 2, 5) and w["p"][:5] == ["A & B", "2020", "Hur", "—", "Bo 1"]
    assert w["g"][3] == ["CTH 99", [['q"\\\n\t\x01é', *[w["p"].index(x) for x in ("LS", "2021", "Hit", "—", "HFR")]]]]
    told, pooled, facts = catalog.read(spark, f"file://{tmp_path}/c.json")
    assert told == {"source": 'a "b"', "manuscripts": 7}
    got = catalog.decode(pooled, facts).orderBy("rank").collect()
    assert [(r.label, r.sigla, r.authorship) for r in got][:3] == [("CTH 2", "—", "A & B"), ("CTH 12", "kbo 3.3", "—"), ("CTH 12", "KBo 3.22", "LS")]
    (tmp_path / "old.json").write_text('{"s":"","m":0,"p":[],"g":[],"v":1}')
    with pytest.raises(catalog.BadCatalog):
        catalog.read(spark, f"file://{tmp_path}/old.json")
    catalog.write(inv.where("false"), "", f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == {"s": "", "m": 0, "p": [], "g": [], "v": 2}
    assert catalog.read(spark, f"file://{tmp_path}/none.json")[2].count() == 0


def test_short_rows_and_numbers_outside(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"s":"","m":2,"p":["x"],"g":[["CTH 1",[["a",0],["b",0,9,0,0,0]]]],"v":2}')
    _, pooled, facts = catalog.read(spark, f"file://{tmp_path}/c.json")
    assert [(r.sigla, r.authorship, r.year, r.corpus) for r in catalog.decode(pooled, facts).orderBy("rank").collect()] == [("a", "x", "x", "x"), ("b", "x", "—", "x")]


def test_stored_index(spark, records, tmp_path):
    inv = inventory.inventory(records, "k")
    S.save_index(inv, f"file://{tmp_path}/i")
    idx = S.open_index(spark, f"file://{tmp_path}/i")
    find = lambda q: {r.group: r["items"] for r in S.search(idx, q).collect()}
    assert find("3.22") == {1: [1]} and find("Schwemer") == {3: [0, 1]} and find("cth 12") == {1: None, 2: None} and len(find("")) == 4 and find("zzz") == {}
    assert find("—") == {3: None}  # the group without a label is shown under the marker; missing fields hold none
    assert {r.k for r in S.applied(inv, S.search(idx, "bo 1")).collect()} == {2, 4, 5}
    with pytest.raises(S.BadIndex, match="not an index"):
        S.open_index(spark, f"file://{tmp_path}/none")
    assert S.spellings(" ds ") == " ds \ndaniel schwemer" and S.spellings("dsx") == "dsx"


def test_stamps_of_long_years(spark):
    """Years beyond 9999 and below 0, no time, and another session time zone."""
    seconds = {253402300799: "9999-12-31 23:59:59 UTC", 253402300800: "10000-01-01 00:00:00 UTC", 518394000000: "18397-04-02 13:20:00 UTC", 0: "1970-01-01 00:00:00 UTC",
               -1: "1969-12-31 23:59:59 UTC", -62167219200: "0000-01-01 00:00:00 UTC", -62167219201: "-1-12-31 23:59:59 UTC", None: None}
    df = spark.createDataFrame([(x,) for x in seconds], "x long").select("x", inventory.stamp(F.col("x")).alias("at"))
    for zone in ("Asia/Tokyo", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert {r["x"]: r["at"] for r in df.collect()} == seconds


def test_utc_stamp_of_large_keys(spark, tmp_path):
    """Keys that make years of five and six digits, and seconds that a double of microseconds doesn't hold, against the SQL."""
    import duckdb

    from quire.plans.catalogue import ORACLES, QUERIES

    keys = [0, 2932925, 2932926, 5999999, 6672072, *range(10**7, 10**7 + 500), *range(10**8, 10**8 + 500), None]
    spark.createDataFrame([(k,) for k in keys], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.execute(ORACLES["utc_stamp"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in QUERIES["utc_stamp"](spark, str(tmp_path)).collect())
