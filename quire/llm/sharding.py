"""Operator 10: resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A byte that stays costs 0, a
byte that moves costs 1; the transfers of least cost are a minimum-cost flow
from old to new shards, solved by successive shortest paths on their few nodes;
with these costs each is a single arc (`transfers`).
The flow is then carried out in blocks: an old shard's rows lie in one order
(a hash of doc_id), and each destination takes a run of them as long as its flow.
A row that lies across a cut goes where its middle lies, so a shard's size is
its capacity within half a row for every cut.

Law: `bytes`. Sizes are near equal: total / shards, plus or minus rows at cuts.

Only affected shards are rewritten: rows of a shard that neither gives nor takes
keep their files.

Defined results. A row whose old shard is null belongs to none: it counts as a shard of
its own, -1, which gives all it has. Null text: size 16. A null doc_id is one key like others. Rows
that share a doc_id and text are alike and each keeps a slot. Extra columns pass
through `reshard`; those named like its own are renamed in_<name>. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import global_index, running_sum
from quire.staging import new_path, stage


#: Bytes of text to a file, about.
FILE_BYTES = 128 << 20


def row_size() -> Column:
    """UTF-8 bytes of the text and 16 for the row."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")


def capacities(total: int, shards: int) -> list[int]:
    """Equal parts of total, the first ones larger by one where it doesn't divide."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def transfers(old: list[int], new: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, moving the fewest; sum(old) == sum(new).

    A minimum-cost flow on the network source -> old -> new -> sink, where old i ->
    new i costs 0 and any other pair 1, by successive shortest paths. With these costs
    no path needs a search: those of cost 0 are the arcs i -> i, and every later
    shortest path is one direct arc. Both sides are a few dozen or thousand shards,
    whatever the data.
    """
    if sum(old) != sum(new):
        raise ValueError("capacities must equal sizes")
    flow: dict[tuple[int, int], int] = {}
    left, room = list(old), list(new)
    # Paths of cost 0 come first: each shard keeps what fits.
    for i in range(min(len(old), len(new))):
        if stay := min(left[i], room[i]):
            flow[i, i] = stay
            left[i] -= stay
            room[i] -= stay
    # Then paths of cost 1. A longer path would go back over an arc i -> i and cost no less than 1,
    # so the shortest is always direct, from what is left to where there is room.
    givers = [i for i, x in enumerate(left) if x]
    takers = [j for j, x in enumerate(room) if x]
    while givers:
        i, j = givers[-1], takers[-1]
        x = min(left[i], room[j])
        flow[i, j] = flow.get((i, j), 0) + x
        left[i] -= x
        room[j] -= x
        if not left[i]:
            givers.pop()
        if not room[j]:
            takers.pop()
    return flow


def cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the runs of bytes of each old shard that go to each new one. What stays comes first."""
    out, at = [], {}
    for i, j in sorted(flow, key=lambda p: (p[0], p[0] != p[1], p[1])):
        a = at.get(i, 0)
        out.append((i, j, a, a + flow[i, j]))
        at[i] = a + flow[i, j]
    return out


def _key() -> Column:
    """A row's place in its old shard. Rows alike in doc_id and text have one key, and so go one way."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return F.struct(F.xxhash64(doc_id).alias("h"), doc_id.alias("d"), F.xxhash64("text").alias("t"))


def _shard(old: Column) -> Column:
    return F.coalesce(old.cast("int"), F.lit(-1))


def plan(docs: DataFrame, old: Column, shards: int) -> DataFrame:
    """The runs of the new layout: old_shard, shard, first_key and next_key (null: to the end), at most old + new rows."""
    spark = docs.sparkSession
    rows = docs.select(_key().alias("key"), row_size().alias("size"), _shard(old).alias("old_shard"))
    placed = running_sum(rows.select("old_shard", "key.*", "size"), [F.col("old_shard"), F.col("h"), F.col("d"), F.col("t")], "size", "before")
    # One row an old shard: their number is the layout's, not the data's.
    sizes = {r["old_shard"]: (r["n"], r["first"]) for r in placed.groupBy("old_shard").agg(F.sum("size").alias("n"), F.min("before").alias("first")).collect()}
    # The shard of rows without one comes last, where no new shard has its number.
    top = max([*sizes, shards - 1]) + 1
    have = [sizes.get(i, (0, 0))[0] for i in range(top)] + [sizes.get(-1, (0, 0))[0]]
    number = [*range(top), -1]
    runs = [(number[i], j, sizes[number[i]][1] + a, sizes[number[i]][1] + z) for i, j, a, z in cuts(transfers(have, capacities(sum(have), shards)))]
    table = spark.createDataFrame(runs, "old_shard int, shard int, first long, last long")
    middle = F.col("before") + F.shiftright("size", 1)
    at = placed.join(F.broadcast(table), "old_shard").where((middle >= F.col("first")) & (middle < F.col("last")))
    firsts = at.groupBy("old_shard", "shard").agg(F.min("before").alias("at"), F.min(F.struct("h", "d", "t")).alias("first_key"))
    after = Window.partitionBy("old_shard").orderBy("at")
    return firsts.withColumn("next_key", F.lead("first_key").over(after)).withColumn("total", F.lit(sum(have)).cast("long")).drop("at")


def assign(docs: DataFrame, runs: DataFrame, old: Column) -> DataFrame:
    """docs plus old_shard, shard and size; runs is as small as the layouts are."""
    tagged = docs.withColumns({"old_shard": _shard(old), "size": row_size(), "__key": _key()})
    r = F.broadcast(runs.withColumnRenamed("old_shard", "__old"))
    inside = (F.col("old_shard") == F.col("__old")) & (F.col("__key") >= F.col("first_key")) & (F.col("next_key").isNull() | (F.col("__key") < F.col("next_key")))
    return tagged.join(r, inside).drop("__key", "__old", "first_key", "next_key", "total")


def reshard(docs: DataFrame, old: Column, shards: int, path: str) -> DataFrame:
    """Move docs to `shards` shards of equal bytes and return the new layout: docs plus old_shard, size and shard.

    The rows of affected shards are written to path, a folder a shard, and read
    from there; those of a shard that neither gives nor takes stay where they are.
    """
    spark = docs.sparkSession
    clash = {c: f"in_{c}" for c in docs.columns if c in {"old_shard", "size", "shard", "folder", "h", "d", "t"}}
    runs = stage(plan(docs, old, shards), "runs").coalesce(1)
    affected = [r["shard"] for r in runs.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct().collect()]
    new = assign(docs.withColumn("__was", old).withColumnsRenamed(clash), runs, F.col("__was")).drop("__was")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A task writes about FILE_BYTES of a shard, however many bytes there are.
    total = runs.agg(F.max("total")).first()[0] or 0
    pieces = max(1, 2 * parts // shards, -(-total // (shards * FILE_BYTES)))
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces))
    parts = max(parts, shards * pieces)
    moved = new.where(F.col("shard").isin(affected)).repartition(parts, "shard", salt).withColumn("folder", F.col("shard"))
    moved.write.partitionBy("folder").option("compression", "zstd").parquet(path)
    written = spark.read.schema(new.schema).parquet(path).select(*new.columns)
    still = new.where(~F.col("shard").isin(affected))
    return written if not runs.where(~F.col("shard").isin(affected)).count() else written.unionByName(still)


def number(layout: DataFrame) -> DataFrame:
    """layout plus slot, gapless from 0 in each shard, by doc_id and the row's text_crc32."""
    indexed = global_index(layout, [F.col("shard"), F.col("doc_id"), F.col("text_crc32")], "at")
    firsts = indexed.groupBy("shard").agg(F.min("at").alias("__first"))
    return indexed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("at") - F.col("__first")).drop("at", "__first")


def digest(docs: DataFrame, old: Column, shards: int = 40) -> DataFrame:
    """Reshard docs(doc_id, text) and describe the files' rows."""
    layout = reshard(docs, old, shards, new_path(docs.sparkSession, "shards"))
    rows = layout.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "old_shard", "shard")
    return number(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
