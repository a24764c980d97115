"""Global positions without a single-partition window.

row_number() over an unpartitioned window pulls every row into one task. Here
the rows are range-partitioned and sorted, numbered inside each partition, and
the partitions' counts (one row each) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.staging import stage

_ROWS = (1 << 33) - 1


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, keys: list[Column], out: str = "idx") -> DataFrame:
    """df plus `out`: 0-based position in the order of keys. Rows equal on all keys keep some order among themselves.

    The numbered rows are staged, so that a recomputed task can't renumber what others have read.
    The offsets are one row a partition: their size is that of the partition count, never of the data.
    """
    spark = df.sparkSession
    raw = stage(
        df.repartitionByRange(_partitions(df), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()),
        "index",
    )
    raw = raw.withColumn("__part", F.shiftright("__at", 33).cast("int"))
    counts = sorted((r["__part"], r["n"]) for r in raw.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for part, n in counts:
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets, "__part int, __before long")
    return raw.join(F.broadcast(table), "__part").withColumn(out, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_ROWS))).drop("__at", "__part", "__before")


def running_sum(df: DataFrame, keys: list[Column], value: str, out: str = "before") -> DataFrame:
    """df plus `out`: the exclusive running sum of `value` (no nulls) in the order of keys, over all rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = df.sparkSession
    kept = df.columns

    def sums(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(kept.index(value)).cast(pa.int64())
            run = pc.cumulative_sum(v)
            before = pc.add(pc.subtract(run, v), total)
            total += run[-1].as_py() if len(run) else 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * len(b), pa.int32()), before, pc.add(before, v)],
                names=[*kept, "__part", "__local", "__upto"],
            )

    from pyspark.sql.types import IntegerType, LongType, StructType

    schema = StructType(list(df.schema.fields)).add("__part", IntegerType()).add("__local", LongType()).add("__upto", LongType())
    raw = stage(df.repartitionByRange(_partitions(df), *keys).sortWithinPartitions(*keys).mapInArrow(sums, schema), "sums")
    totals = sorted((r["__part"], r["n"]) for r in raw.groupBy("__part").agg(F.max("__upto").alias("n")).collect())
    offsets, before = [], 0
    for part, n in totals:
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets, "__part int, __before long")
    return raw.join(F.broadcast(table), "__part").withColumn(out, F.col("__before") + F.col("__local")).drop("__part", "__local", "__upto", "__before")
