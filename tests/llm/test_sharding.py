import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm.sharding import capacities, cuts, digest, reshard, transfers
from quire.staging import new_path


def test_flow_moves_the_fewest_bytes():
    old, new = [50, 0, 10, 40], [25, 25, 25, 25]
    f = transfers(old, new)
    assert [sum(x for (i, _), x in f.items() if i == k) for k in range(4)] == old
    assert [sum(x for (_, j), x in f.items() if j == k) for k in range(4)] == new
    assert sum(x for (i, j), x in f.items() if i != j) == 40
    assert transfers([30], capacities(30, 3)) == {(0, 0): 10, (0, 1): 10, (0, 2): 10}
    assert all(a < z for *_, a, z in cuts(f))


def test_layout_against_brute_force(spark):
    rows = [(i, "x" * (i * 7 % 90) if i % 9 else None, f"s{i % 3 if i % 2 else 0}", i) for i in range(500)]
    rows += [(None, "n", "s1", 0), (7, "tie", "s2", 0), (7, "tie", "s2", 0), (600, "y" * 3000, "s0", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(5))
    got = digest(df, old, 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((d or -1, len(t or "") + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert sorted(by) == list(range(8))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_untouched_shards_stay(spark):
    df = spark.createDataFrame([(i, "abcd", i % 4) for i in range(40)], "doc_id long, text string, at int")
    path = new_path(spark, "t")
    out = reshard(df, F.col("at"), 4, path)
    assert out.where("shard <> at").count() == 0 and out.count() == 40


def test_empty(spark):
    assert digest(spark.createDataFrame([], "doc_id long, text string"), F.lit(0), 3).count() == 0


def test_only_affected_shards_are_rewritten(spark):
    """A giver, a taker, an untouched shard and rows of no shard, beside columns that clash."""
    rows = [(i, "abcd", 0, i, "f") for i in range(20)] + [(100 + i, "abcd", 1, i, "f") for i in range(10)] + [(200 + i, "abcd", 2, i, "f") for i in range(15)]
    rows += [(300 + i, "abcd", None, i, "f") for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, shard int, folder string")
    path = new_path(spark, "t")
    out = reshard(df, F.col("at"), 4, path)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert [sum(r.shard == k for r in got) for k in range(4)] == [15, 15, 15, 15]
    assert all(r.shard == 2 for r in got if 200 <= r.doc_id < 215) and all(r.in_shard is not None for r in got)
    files = spark.read.parquet(path)
    assert files.where("shard = 2").count() == 0 and files.count() == 45
    moved = sum(r.old_shard != r.shard for r in got)
    assert moved == 20  # five from shard 0, fifteen that had none
