"""Problem 5: one group identifier for all records linked directly or indirectly.

Seed-tree pruning. In each round every vertex points its neighbourhood at the
smallest id it sees; a vertex that nobody chose drops out of the graph and hangs
under the smallest id it was pointed at. The rest of the graph shrinks quickly;
when no edge is left, the smallest id of each component is its seed, and seeds
flow down the forest, round by round in reverse.

Distribution: every step is an aggregate with map-side combining or an equi-join on
a vertex. A vertex with very many edges is hot; such vertices are at most
``2 * edges / limit`` by counting, so their list is broadcast and their rows are
spread over as many partitions as their number asks for, with the one matching row replicated as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evisift.plans.lineage import Workspace

HOT_LEAST = 2_000_000
HOT_MOST = 1_000


def clean_id(c: Column) -> Column:
    """Ids are compared trimmed and in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def valid_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (u < v) of cleaned ids; a null, empty or equal endpoint links nothing."""
    p = pairs.select(clean_id(F.col(a)).alias("a"), clean_id(F.col(b)).alias("b"))
    p = p.where("a is not null and b is not null and a <> '' and b <> '' and a <> b")
    return p.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def join_one(rows: DataFrame, one: DataFrame, key: str, size: str, limit: int, total: int) -> DataFrame:
    """Join ``rows`` with ``one`` (one row a key, with its row count in ``size``) without a hot partition.

    total: at most so many rows are in ``rows``; if that is no more than ``limit``, no key is hot.
    """
    if total <= limit:
        return rows.join(one, key)
    # so many parts that each has at most ``limit`` rows
    parts = F.ceil(F.col(size) / limit).cast("int")
    hot = F.broadcast(one.where(F.col(size) > limit).select(F.col(key).alias("_hot"), parts.alias("_parts")))
    spread = rows.join(hot, rows[key] == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("_parts"))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot", "_parts")
    copies = one.withColumn("_salt", F.explode(F.when(F.col(size) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return spread.join(copies, [key, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``(id, group_id)`` of every vertex of ``edges`` (u, v: distinct, u < v); group_id is the smallest id reached.

    An empty input gives an empty result. Vertices without an edge do not occur.
    """
    spark = edges.sparkSession
    ws = workspace or Workspace(spark, "components")
    (graph, left), rounds = ws.counted(edges.select("u", "v"), "edges"), []
    while left:
        limit = max(HOT_LEAST, 2 * left // HOT_MOST)
        both = graph.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select(
            F.col("e.u").alias("x"), F.col("e.v").alias("y")
        )
        if 4 * left <= limit:
            # no vertex can be hot: its rows meet in one task
            w = Window.partitionBy("x")
            m = F.least("x", F.min("y").over(w))
            told = ws.write(both.select("x", "y", m.alias("m")).select(F.explode(F.array("x", "y")).alias("x"), "m").distinct(), "told")
            nxt = told.select("x", "m", F.min("m").over(w).alias("low")).where("m <> low").select(F.col("low").alias("u"), F.col("m").alias("v")).distinct()
        else:
            least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
            told = join_one(both, least, "x", "n", limit, 2 * left).select(F.col("y").alias("x"), "m").unionByName(least.select("x", "m")).distinct()
            told = ws.write(told, "told")
            chosen = told.groupBy("x").agg(F.min("m").alias("low"), F.count(F.lit(1)).alias("n"))
            nxt = join_one(told, chosen, "x", "n", limit, 4 * left).where("m <> low").select(F.col("low").alias("u"), F.col("m").alias("v")).distinct()
        chosen = told.groupBy("x").agg(F.min("m").alias("low"), F.max((F.col("x") == F.col("m")).cast("int")).alias("kept"))
        nxt, more = ws.counted(nxt, "edges")
        rounds.append((chosen.where("kept = 0").select(F.col("x").alias("id"), F.col("low").alias("up")), 2 * left))
        ws.drop(graph)
        graph, left = nxt, more
    if not rounds:
        return graph.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # the vertices that stayed to the end of the last round in which they had edges are the seeds
    labels = None
    for k, (tree, most) in enumerate(reversed(rounds)):
        if labels is None:
            done = tree.select("id", F.col("up").alias("group_id"))
        else:
            sizes = tree.groupBy("up").agg(F.count(F.lit(1)).alias("n"))
            heads = sizes.join(labels.select(F.col("id").alias("up"), "group_id"), "up", "left").select("up", "n", F.coalesce("group_id", "up").alias("group_id"))
            done = join_one(tree, heads, "up", "n", HOT_LEAST, most).select("id", "group_id")
        labels = done if labels is None else labels.unionByName(done)
        if k % 3 == 2 and k + 1 < len(rounds):
            labels = ws.write(labels, "labels")
    labels = ws.write(labels, "labels")
    seeds = labels.select(F.col("group_id").alias("id"), "group_id").distinct()
    return labels.unionByName(seeds)


def grouped_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(record_id, group_id)`` of every record in a valid pair.

    Nulls, empty ids and self pairs link nothing; repeated or turned-round pairs
    count once; extra columns are ignored; no valid pair gives no row.
    """
    return connected_components(valid_pairs(pairs, a, b)).select(F.col("id").alias("record_id"), "group_id")
