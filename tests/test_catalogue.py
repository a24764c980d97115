"""Every query with an oracle against DuckDB, order aside."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()
from quire.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_inventory():
    """The queries over the same inventory share one here; `inventory_order` and others compare it with SQL."""
    from quire.plans import corpus

    made, build = {}, corpus._inventory

    def kept(spark, sf_dir):
        if sf_dir not in made:
            made[sf_dir] = build(spark, sf_dir)
        return made[sf_dir]

    corpus._inventory = kept
    yield
    corpus._inventory = build


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    assert len(rows) == len(mine)
    assert sorted(map(str, rows)) == sorted(map(str, mine))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """A copy without the folders of the subpackage imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", *(["corpus_pipeline.py"] if (root / "corpus_pipeline.py").exists() else [])):
        shutil.copy(root / f, tmp_path / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'extract_records' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
