"""Operator 2: near-duplicate documents by bottom-k sketches.

One hash function orders all word shingles; a document's sketch is its k least
hashes. Documents with equal sets are one node. Then:

1. Inverted lists of retained values, in two refinements of one rule. Sets that
   share `need` of their values must share one of the first (size - need + 1) of
   them in any common order; ordered from rare to frequent, those are the values
   that are worth a list. A frequent passage gets a list only from documents that
   consist of little else.
2. Lists of at most `crowd` nodes give their pairs. The nodes of longer lists go
   through the rule once more with their full sets and the exact need; what is
   still crowded is a group of true near copies, and is joined to a hub, the member
   with the fewest values of its own. Members that don't link with the hub are
   compared with all others of the list for which position and length still allow
   the threshold: the exact way for the rest, and nearly empty after the two rules.
   A long list is dealt in blocks, and a hub's partners in salted parts.
3. The sketch of the union (the k least of both) estimates the likeness of each
   pair; pairs 5.5 standard deviations below the threshold go.
4. Exact Jaccard on the full sets decides. Only then is there a link.
5. Components by alternating large and small stars, in tables.

No list is cut and no partner dropped: what step 1 can lose is a pair whose
sketches lie 5.5 standard deviations apart from their likeness.

Defined results. Null text, or one with no words: no shingles, linked with nothing.
Fewer than `width` words: the whole sequence is the one shingle. A null doc_id
counts as smaller than any other and makes a component's id null. Rows that share
a doc_id are judged each by its text. Extra columns are ignored by `near_duplicates`
and kept by `keep_one`. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WordHashes, shingle_hashes, text_batches, texts
from quire.staging import stage

K = 64
CROWD = 16
STAR_BLOCKS = 256
LIST_BLOCK = 2000
_NULL_ID = -(1 << 63)
_FLIP = np.uint64(1 << 63)


def _signed(h: np.ndarray) -> np.ndarray:
    """uint64 to int64 with the same order."""
    return (h ^ _FLIP).view(np.int64)


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, digest of the text, n (set size), rid (hash of the set; null if empty), sketch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache = WordHashes()
        for b in batches:
            n, rid, offsets, values = [], [], [0], []
            for text in texts(b):
                h = shingle_hashes(text, width, cache)
                n.append(len(h))
                rid.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None)
                values.append(_signed(h[:k]))
                offsets.append(offsets[-1] + len(values[-1]))
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            sk = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(rid, pa.int64()), sk], names=["doc_id", "digest", "n", "rid", "sketch"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(make, "doc_id long, digest long, n long, rid long, sketch array<long>")


def least_shared(n: Column, threshold: float, k: int) -> Column:
    """Values that the sketches of two sets have in common, at least, if the sets reach the threshold.

    Up to 0.85 k values the sketch of either set misses nothing that matters, and the
    need is exact; above, it is the mean of what the union's sketch shows, less 5.5
    standard deviations.
    """
    large = max(1, math.floor(threshold * k - 5.5 * math.sqrt(k * threshold * (1 - threshold))))
    return F.when(n < math.floor(threshold * k), F.ceil(F.lit(threshold) * n - F.lit(1e-9))).otherwise(F.lit(large))


def prefix_lists(sets: DataFrame) -> DataFrame:
    """From sets(rid, n, size, need, values): rows (value, rid, n, at, own) of the lists worth making.

    at: the value's place in the set's order from rare to frequent; own: values of no other set.
    """
    postings = sets.select("rid", "n", "size", "need", F.explode("values").alias("value"))
    frequency = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(frequency, "value")
    # At most `size` entries a set.
    by_set = shared.groupBy("rid").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("order"))
    own = F.col("size") - F.size("order")
    kept = by_set.withColumn("own", own).withColumn("order", F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("size") - F.col("need") + 1 - own).cast("int")))
    return kept.select("rid", "n", "own", F.posexplode("order").alias("p", "e")).select(F.col("e.value").alias("value"), "rid", "n", (F.col("own") + F.col("p")).alias("at"), "own")


def _sides(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = lists.select("value", *[F.col(c).alias(f"a_{c}") for c in ("rid", "n", "at")])
    return a, lists.select("value", *[F.col(c).alias(f"b_{c}") for c in ("rid", "n", "at")])


def _long_enough(threshold: float) -> Column:
    return F.least("a_n", "b_n") >= F.lit(threshold) * F.greatest("a_n", "b_n") - 1e-9


def _reachable(threshold: float) -> Column:
    """Whether two sets can reach the threshold if the list's value is the first that they share."""
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return most >= F.lit(threshold / (1 + threshold)) * (F.col("a_n") + F.col("b_n")) - 1e-9


def estimated(pairs: DataFrame, sk: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) that the sketch of their union doesn't rule out."""
    s = sk.select("rid", "n", "sketch")
    both = pairs.join(s.toDF("a", "na", "x"), "a").join(s.toDF("b", "nb", "y"), "b")
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    seen = F.size(F.array_intersect(F.array_intersect("u", "x"), "y"))
    m = F.size("u")
    exact = (F.col("na") <= k) & (F.col("nb") <= k)
    full = F.size(F.array_intersect("x", "y")) >= F.lit(threshold) * F.size(F.array_union("x", "y")) - 1e-9
    likely = seen >= F.lit(threshold) * m - 5.5 * F.sqrt(m * F.lit(threshold * (1 - threshold)))
    return both.withColumn("u", union).where(F.when(exact, full).otherwise(likely)).select("a", "b", "salt")


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b, salt) whose full sets reach the threshold. nodes: rid, text.

    All partners of a come past its set one at a time, in as many tasks as a has salts.
    """
    members = pairs.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("rid")).unionByName(pairs.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("rid")))
    rows = members.join(nodes, "rid").select("a", "salt", "role", "rid", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hub, mine = WordHashes(), None, None
        for b in batches:
            a, salt, role, rid = (c.to_pylist() for c in b.columns[:4])
            found: tuple[list, list] = ([], [])
            for i, text in enumerate(texts(b)):
                h = shingle_hashes(text, width, cache)
                if not role[i]:
                    hub, mine = (a[i], salt[i]), h
                    continue
                assert hub == (a[i], salt[i])
                both = len(np.intersect1d(mine, h, assume_unique=True))
                if both >= threshold * (len(mine) + len(h) - both) - 1e-9:
                    found[0].append(a[i])
                    found[1].append(rid[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    dealt = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges(a, b): root is the least node that can be reached. Alternating stars, staged a round."""
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stage(small.where("u <> v").distinct(), "edges")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, k: int = K, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, digest (xxhash64 of its text)."""
    text_batches(docs.sparkSession)
    sk = stage(sketches(docs, width, k), "sketches")
    classes = stage(sk.where("rid is not null").groupBy("rid").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("n").alias("n")), "classes")
    reps = classes.select("rid", "n", "rep.doc_id", "rep.digest")
    own = stage(sk.join(reps.select("rid", "doc_id", "digest"), ["rid", "doc_id", "digest"], "left_semi").dropDuplicates(["rid"]).select("rid", "n", "sketch"), "nodes")

    size = F.size("sketch").cast("long")
    lists = stage(prefix_lists(own.select("rid", "n", size.alias("size"), least_shared(F.col("n"), threshold, k).cast("long").alias("need"), F.col("sketch").alias("values"))), "lists")
    counts = lists.groupBy("value").agg(F.count("*").alias("c"))
    few, many = lists.join(counts.where(f"c between 2 and {crowd}"), "value"), lists.join(counts.where(f"c > {crowd}"), "value")
    a, b = _sides(few)
    first = a.join(b, "value").where("a_rid < b_rid").where(_long_enough(threshold)).select(F.col("a_rid").alias("a"), F.col("b_rid").alias("b")).distinct().withColumn("salt", F.lit(0))
    first = stage(estimated(first, own, threshold, k), "pairs")
    crowded = stage(many.select("rid").distinct(), "crowded")

    wanted = first.select(F.col("a").alias("rid")).unionByName(first.select(F.col("b").alias("rid"))).unionByName(crowded).distinct()
    where = reps.join(wanted, "rid").select("rid", "doc_id", "digest")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    nodes = stage(source.join(where, ["doc_id", "digest"]).dropDuplicates(["rid"]).select("rid", "text"), "texts")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            h = [_signed(shingle_hashes(t, width, cache)) for t in texts(batch)]
            offsets = np.cumsum([0, *map(len, h)])
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(h) if h else [], pa.int64()))
            n = pa.array([len(x) for x in h], pa.int64())
            need = pa.array([math.ceil(threshold * len(x) - 1e-9) for x in h], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, n, need, values], names=["rid", "n", "size", "need", "values"])

    sets = nodes.join(crowded, "rid", "left_semi").select("rid", "text").mapInArrow(full, "rid long, n long, size long, need long, values array<long>")
    exact = stage(prefix_lists(sets), "lists")
    counts = exact.groupBy("value").agg(F.count("*").alias("c"), F.min(F.struct("own", "rid")).alias("hub"))
    few = exact.join(counts.where(f"c between 2 and {crowd}").select("value"), "value")
    a, b = _sides(few)
    second = a.join(b, "value").where("a_rid < b_rid").where(_long_enough(threshold) & _reachable(threshold)).select(F.col("a_rid").alias("a"), F.col("b_rid").alias("b")).distinct().withColumn("salt", F.lit(0))
    hot = stage(exact.join(counts.where(f"c > {crowd}").select("value", F.col("hub.rid").alias("hub"), F.ceil(F.col("c") / LIST_BLOCK).alias("blocks")), "value"), "hot")
    star = hot.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct().withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(STAR_BLOCKS)).cast("int"))
    links = stage(verified(first.unionByName(estimated(second.unionByName(star), own, threshold, k)).distinct(), nodes, threshold, width), "links")

    linked = links.select(F.col("a").alias("hub"), F.col("b").alias("rid")).unionByName(links.select(F.col("b").alias("hub"), F.col("a").alias("rid"))).distinct()
    alone = hot.where("rid <> hub").join(linked, ["hub", "rid"], "left_anti")
    # A list of any length is dealt in blocks of one side, so no task has more than LIST_BLOCK of its rows on that side.
    a = alone.select("value", F.pmod(F.xxhash64("rid"), "blocks").alias("block"), *[F.col(c).alias(f"a_{c}") for c in ("rid", "n", "at")])
    b = hot.select("value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"b_{c}") for c in ("rid", "n", "at")])
    rest = a.join(b, ["value", "block"]).where("a_rid <> b_rid").where(_long_enough(threshold) & _reachable(threshold)).select(F.least("a_rid", "b_rid").alias("a"), F.greatest("a_rid", "b_rid").alias("b")).distinct().withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(STAR_BLOCKS)).cast("int"))
    links = links.unionByName(verified(estimated(rest, own, threshold, k), nodes, threshold, width))

    roots = stage(components(links), "roots").withColumnRenamed("node", "rid")
    placed = classes.select("rid", F.col("rep.doc_id").alias("least")).join(roots, "rid", "left").select("rid", "least", F.coalesce("root", "rid").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(ids, "root").select("rid", "component")
    out = sk.select("doc_id", "digest", "n", "rid").join(named, "rid", "left").withColumn("component", F.coalesce("component", "doc_id"))
    null = lambda c: F.nullif(F.col(c), F.lit(_NULL_ID))
    return out.select(null("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"), "digest")


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs that a component keeps: all rows of its least doc_id with that row's text."""
    found = near_duplicates(docs, threshold, width).where("kept").select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__digest"))
    return docs.join(found, same, "left_semi")
