"""Substring search that answers with whole groups or single items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of one person, as whole values. Fixed values.
ALIASES = (("DS", "ds", "Daniel Schwemer"), ("FF", "Francesco Fuscagni"))


def normalise(query: str) -> str:
    return query.strip().lower()


def index(rows: DataFrame, label: str, group: str, item: str, fields: list[str]) -> DataFrame:
    """group, item, label and one lower-case haystack; NULL fields are no text."""
    hay = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in fields]))
    return rows.select(F.col(group).alias("group"), F.col(item).alias("item"), F.lower(label).alias("label"), hay.alias("hay"))


def spellings(name: str) -> str:
    """A name and the other spellings of the same person, one a line; the whole value decides, never a part of it."""
    key = name.strip().lower()
    for group in ALIASES:
        folded = list(dict.fromkeys(x.lower() for x in group))
        if key in folded:
            return "\n".join([name, *(x for x in folded if x != key)])
    return name


def search(idx: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Groups that match, in order: items is NULL where the label matches (or the query is empty), else the matching items.

    The label is tested first and the filter runs before the shuffle, so only hits are grouped.
    """
    q = F.lit(normalise(query))
    whole = F.contains("label", q)
    hits = idx.where(whole | F.contains("hay", q)).groupBy("group").agg(F.max(whole).alias("whole"), F.sort_array(F.collect_list(F.when(~whole, F.col("item")))).alias("items"))
    out = hits.select("group", F.when(~F.col("whole"), F.col("items")).alias("items"))
    return out.orderBy("group").limit(limit) if limit is not None else out


def with_aliases(rows: DataFrame, column: str) -> DataFrame:
    """The column followed by a person's other spellings, where the whole value (any case) is one of them."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, "\n".join(x for x in dict.fromkeys(s.lower() for s in group) if x != k)) for group in ALIASES for k in dict.fromkeys(s.lower() for s in group)], "__key string, __others string")
    # The table of spellings is a constant of a few rows.
    joined = rows.join(F.broadcast(table), F.lower(F.trim(F.col(column))) == F.col("__key"), "left")
    return joined.withColumn(column, F.concat_ws("\n", F.col(column), F.col("__others"))).drop("__key", "__others")


def inventory_index(inv: DataFrame) -> DataFrame:
    """The index of an inventory: group (its run), item (place in it), label, and one haystack of name, editor in all
    spellings, year, languages, inventory number, corpus. Missing fields are no text."""
    from quire.operators.inventory import group_label

    rows = with_aliases(inv.withColumn("__editor", F.col("authorship")), "__editor")
    return index(rows.withColumn("__label", group_label()), "__label", "run", "at", ["sigla", "__editor", "year", "lang", "inv", "corpus"])


def hits(idx: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(group, item) rows in order, item null where the whole group matches: one row a group or item, at most `limit`."""
    q = F.lit(normalise(query))
    whole = F.contains("label", q)
    found = idx.where(whole | F.contains("hay", q)).select("group", F.when(~whole, F.col("item")).alias("item"))
    rows = found.where("item is not null").unionByName(found.where("item is null").distinct())
    return rows.orderBy("group", "item").limit(limit) if limit is not None else rows


def folded(rows: DataFrame) -> DataFrame:
    """Hits folded to one row a group: items in order, null where the group is whole."""
    g = rows.groupBy("group").agg(F.max(F.col("item").isNull()).alias("whole"), F.sort_array(F.collect_list("item")).alias("items"))
    return g.select("group", F.when(~F.col("whole"), F.col("items")).alias("items"))


def applied(inv: DataFrame, matches: DataFrame) -> DataFrame:
    """The inventory's records that matches (group, items or null for all) stand for."""
    m = matches.select(F.col("group").alias("run"), F.explode_outer("items").alias("__item"), F.col("items").isNull().alias("__whole"))
    whole = inv.join(m.where("__whole").select("run").distinct(), "run", "left_semi")
    some = inv.join(m.where("not __whole and __item is not null").select("run", F.col("__item").alias("at")).distinct(), ["run", "at"], "left_semi")
    return whole.unionByName(some)


# ---- the index as tables that last ------------------------------------------------------------------

INDEX_VERSION = 1


class BadIndex(ValueError):
    """A stored index that isn't whole; the message names what is wrong."""


def save_index(inv: DataFrame, path: str) -> None:
    """Write the index of an inventory under path: items, groups, editors, years, and last a row that tells their counts."""
    from quire.operators.catalog import pool
    from quire.staging import stage

    rows = stage(with_aliases(inv.withColumn("__editor", F.col("authorship")), "__editor").withColumns({"editor": F.lower(F.coalesce("__editor", F.lit(""))), "years": F.coalesce("year", F.lit(""))}), "index")
    spark, out = inv.sparkSession, rows
    for name, column in (("editors", "editor"), ("years", "years")):
        stage_pool = stage(pool(rows, column, "rank"), name)
        stage_pool.write.parquet(f"{path}/{name}")
        out = out.join(stage_pool.toDF(f"{column}_id", column), column)
    from quire.operators.inventory import group_label

    hay = F.lower(F.concat_ws("\n", "sigla", "lang", "inv", "corpus"))
    out.select(F.col("run").alias("group"), F.col("at").alias("item"), hay.alias("hay"), "editor_id", "years_id").write.parquet(f"{path}/items")
    rows.where("at = 0").select(F.col("run").alias("group"), F.lower(group_label()).alias("label"), "first", F.col("run_size").alias("n")).write.parquet(f"{path}/groups")
    counts = {t: spark.read.parquet(f"{path}/{t}").count() for t in ("items", "groups", "editors", "years")}
    spark.createDataFrame([(INDEX_VERSION, counts["items"], counts["groups"], counts["editors"], counts["years"])], "version int, items long, groups long, editors long, years long").write.parquet(f"{path}/whole")


def index_faults(spark: SparkSession, path: str) -> DataFrame:
    """(fault, n) of a stored index: counts that differ, numbers outside their pool, groups outside the items, totals that disagree."""
    t = {n: spark.read.parquet(f"{path}/{n}") for n in ("items", "groups", "editors", "years", "whole")}
    told = F.broadcast(t["whole"])  # one row
    rows = [t[n].agg(F.count("*").alias("n")).join(told, F.col("n") != F.col(n)).select(F.lit(f"truncated {n}").alias("fault"), "n") for n in ("items", "groups", "editors", "years")]
    for n, key in (("editors", "editor_id"), ("years", "years_id")):
        rows.append(t["items"].join(t[n].select(F.col("id").alias(key)), key, "left_anti").agg(F.lit(f"number not in {n}").alias("fault"), F.count("*").alias("n")))
        rows.append(t[n].agg(F.lit(f"pool {n} has gaps").alias("fault"), (F.coalesce(F.max("id") + 1, F.lit(0)) - F.count_distinct("id")).alias("n")))
    in_groups = t["items"].groupBy("group").agg(F.count("*").alias("c"), F.max("item").alias("top"))
    rows.append(t["groups"].join(in_groups, "group", "full").where("c is null or n is null or c <> n or top >= n").agg(F.lit("group outside the items").alias("fault"), F.count("*").alias("n")))
    rows.append(t["groups"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).join(told, F.col("s") != F.col("items")).select(F.lit("rows of groups and items differ").alias("fault"), F.col("s").alias("n")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("n <> 0 or fault like 'truncated%'")


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index as `search` takes it, after every check; raises BadIndex."""
    try:
        told = spark.read.parquet(f"{path}/whole").first()
    except Exception as e:
        raise BadIndex(f"{path}: not an index, or not whole") from e
    if told["version"] != INDEX_VERSION:
        raise BadIndex(f"{path}: version {told['version']}")
    if bad := index_faults(spark, path).collect():
        raise BadIndex("; ".join(f"{r.fault} ({r.n})" for r in bad))
    t = {n: spark.read.parquet(f"{path}/{n}") for n in ("items", "groups", "editors", "years")}
    rows = t["items"].join(t["editors"].toDF("editor_id", "editor"), "editor_id").join(t["years"].toDF("years_id", "year"), "years_id").join(t["groups"].select("group", "label"), "group")
    return rows.select("group", "item", "label", F.concat_ws("\n", "hay", F.nullif("editor", F.lit("")), F.nullif("year", F.lit(""))).alias("hay"))
