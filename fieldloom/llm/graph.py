"""Connected components: of an edge table, by alternating large-star and small-star rounds, and of an index of posting lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Workspace, sized


def _hook(edges: DataFrame, rows: int) -> DataFrame:
    """Tie every larger neighbour of a node to the least node of its neighbourhood; ``edges`` has at most ``rows`` rows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(sized(least, 2 * rows), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _fold(edges: DataFrame, rows: int) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them; ``edges`` has at most ``rows`` rows."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(sized(least, rows), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``a`` and ``b`` (long) in, ``node`` and ``root`` out: the least node that each node can reach.

    Roots themselves have no row, nor have nodes without an edge; look roots up with an outer join and take
    the node itself where none is found. Self-loops, repeated and reversed edges and rows with nulls change
    nothing; an empty table gives an empty table. Every round is written to the shared folder, so lost
    executors cost no more than one round.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    with Workspace(edges.sparkSession) as work:
        now, mark = work.keep(edges.distinct(), "cc"), None
        for _ in range(max_rounds):
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if seen == mark or seen[0] == 0:
                break
            mark, done = seen, list(work.paths)
            now = work.keep(_fold(_hook(now, seen[0]), seen[0]), "cc")
            work.drop(done)
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        return work.give(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "cc-roots")


def linked_components(nodes: DataFrame, payload: tuple[str, ...], index: Callable[[DataFrame, tuple[str, ...]], DataFrame], near: Callable[[str, str], Column]) -> DataFrame:
    """``node``, ``root``, ``component_id`` for distinct ``node`` with ``first_id``: the component and the least ``first_id`` in it.

    ``index(df, columns)`` makes a row per node and posting list: those columns, ``key`` and ``sub`` (a further
    cut of long lists). Any two nodes that ``near`` links (a condition on the payload columns with either
    suffix) share a key. Lists can be long where thousands of near copies meet, and then hold mostly pairs
    that are connected already. So neighbours in each list, by payload, are linked first; pairs are made only
    between members of a list that those links leave in different components. No link between components is
    lost, and no list is expanded in full. What a join broadcasts is counted first (``common.sized``).
    """
    with Workspace(nodes.sparkSession) as work:
        beside = Window.partitionBy("key", "sub").orderBy(*payload)
        chain = index(nodes, ("node", *payload)).select("node", *(F.col(c).alias(f"{c}_a") for c in payload), F.lag("node").over(beside).alias("prev"), *(F.lag(c).over(beside).alias(f"{c}_b") for c in payload))
        first = connected_components(chain.where(F.col("prev").isNotNull() & near("_a", "_b")).select(F.col("node").alias("a"), F.col("prev").alias("b")))

        labelled = nodes.join(sized(first, first.count()), "node", "left").select("node", *payload, "first_id", F.coalesce("root", "node").alias("label"))
        labelled = work.keep(labelled, "link-labels")
        lists = index(labelled, (*payload, "label")).drop("sub")
        sizes = lists.groupBy("key", "label").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("main"))
        mixed = work.keep(mixed, "link-keys")
        mixed = work.keep(lists.join(sized(mixed, mixed.count()), "key"), "link-mixed")
        other = mixed.where("label <> main").select("key", F.col("label").alias("la"), *(F.col(c).alias(f"{c}_a") for c in payload))
        every = mixed.select("key", "main", F.col("label").alias("lb"), *(F.col(c).alias(f"{c}_b") for c in payload))
        links = sized(other, other.count()).join(every, "key").where("la <> lb and (lb = main or la < lb)").where(near("_a", "_b"))
        second = connected_components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))

        rooted = labelled.join(sized(second.withColumnRenamed("node", "label"), second.count()), "label", "left").select("node", "first_id", F.coalesce("root", "label").alias("root"))
        rooted = work.keep(rooted, "link-roots")
        # Written, so that the join deals both sides anew and Spark can split a large component.
        least = work.keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "link-least")
        return work.give(rooted.join(sized(least, least.count()), "root").select("node", "root", "component_id"), "linked")
