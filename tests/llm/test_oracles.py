import duckdb

from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_oracles(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, SF)
        want = c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        columns = sorted(names)
        assert sorted(tuple(r[names.index(k)] for k in columns) for r in want.fetchall()) == sorted(tuple(r[k] for k in columns) for r in got.collect())
