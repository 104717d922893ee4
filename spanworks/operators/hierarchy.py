"""Hierarchies over all levels, by path doubling.

A hierarchy is a table of (child, parent) with at most one parent per child and key (a period,
say). From the ancestor at distance d of every node one join gives the ancestor at distance 2d, so
a hierarchy of depth d takes about log2(d) rounds, each of which is written and cuts the lineage.
Nodes leave a round when their path ends, so later rounds are small. Only counts reach the driver.

Rows without a child or a parent are no edges. Of several parents of a child (within the keys) the
least counts. Nodes that are only parents are nodes as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanworks.workdir import materialize


def _edges(rows: DataFrame, child: str, parent: str, keys: Sequence[str]) -> DataFrame:
    known = rows.filter(F.col(child).isNotNull() & F.col(parent).isNotNull())
    edges = known.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(child).alias("node")).agg(F.min(parent).alias("up"))
    return materialize(edges, "edges")


def _far(jumps: DataFrame, names: Sequence[str], *more: Column) -> DataFrame:
    """From ancestors ``up`` at some distance those at twice the distance."""
    above = jumps.select(*names, F.col("node").alias("up"), F.col("up").alias("far"), *[F.col(c).alias(f"_{c}") for c in jumps.columns if c not in (*names, "node", "up")])
    return _joined(jumps, above, names).select(*names, "node", F.col("far").alias("up"), *more)


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``up`` and the keys, null keys being a key."""
    renamed = right.withColumnsRenamed({n: f"r_{n}" for n in [*names, "up"]})
    on = F.col("up") == F.col("r_up")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"r_{n}"))
    return left.join(renamed, on, how)


def cycles(rows: DataFrame, child: str, parent: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cycle, node, length): the nodes that are above themselves; ``cycle`` is the least node of theirs.

    Once paths are longer than there are nodes left, all that go on lead into cycles, and their
    ends lie on them.
    """
    names = [f"k{i}" for i in range(len(keys))]
    return _cycles(_edges(rows, child, parent, keys), names).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "cycle", "node", "length")


def _cycles(edges: DataFrame, names: Sequence[str]) -> DataFrame:
    jumps, distance = edges.withColumn("least", F.least("node", "up")), 1
    left = jumps.count()
    while left and distance <= left:
        jumps = materialize(_far(jumps, names, F.least("least", "_least").alias("least")), "jumps")
        distance, left = 2 * distance, jumps.count()
    on_cycle = jumps.select(*names, "up").distinct()
    # the path of a node on a cycle never leaves it, so its least node is that of the cycle
    found = _joined(on_cycle, jumps.select(*names, F.col("node").alias("up"), "least"), names).select(
        *names, F.col("up").alias("node"), F.col("least").alias("cycle"))
    lengths = found.groupBy(*names, "cycle").agg(F.count(F.lit(1)).alias("length"))
    both = lengths.withColumnsRenamed({n: f"r_{n}" for n in [*names, "cycle"]})
    on = F.col("cycle") == F.col("r_cycle")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"r_{n}"))
    return found.join(both, on).select(*names, "cycle", "node", "length")


def team_rollup(
    rows: DataFrame, child: str, parent: str, amounts: DataFrame, node: str, sums: Sequence[str], keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, node, members, levels, sums...): per node the sums over itself and all nodes below, on every level.

    ``amounts`` has one row per node (and keys); nodes without one add nothing but count as members,
    ``levels`` is the number of levels below. With the sums over all nodes nearer than d and the
    ancestor at distance d of each, one join adds those nearer than 2d: no list of all pairs of a
    node and one below it is ever made. Edges between nodes of a cycle are left out; ``cycles``
    reports them. Exact for whole numbers and decimals.
    """
    names = [f"k{i}" for i in range(len(keys))]
    edges = _edges(rows, child, parent, keys)
    circular = _cycles(edges, names).select(*names, F.col("node").alias("up"), F.lit(True).alias("circular"))
    jumps = _joined(edges.withColumnRenamed("up", "above").withColumnRenamed("node", "up"), circular, names, "left").filter(
        "circular is null").select(*names, F.col("up").alias("node"), F.col("above").alias("up"))
    jumps = materialize(jumps, "jumps")

    own = amounts.filter(F.col(node).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(node).alias("node"), *[F.col(s).alias(f"a{i}") for i, s in enumerate(sums)])
    people = edges.select(*names, "node").unionByName(edges.select(*names, F.col("up").alias("node"))).unionByName(own.select(*names, "node"))
    kinds = {f.name: f.dataType for f in own.schema}
    nothing = [F.lit(None).cast(kinds[f"a{i}"]).alias(f"a{i}") for i in range(len(sums))]
    totals = people.select("*", *nothing).unionByName(own).groupBy(*names, "node").agg(
        F.lit(1).cast("long").alias("members"), F.lit(0).alias("levels"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(len(sums))])
    totals = materialize(totals, "totals")
    distance = 1
    while not jumps.isEmpty():
        below = _joined(jumps.select(*names, F.col("node").alias("up"), F.col("up").alias("above")),
                        totals.withColumnRenamed("node", "up"), names)
        below = below.select(*names, F.col("above").alias("node"), "members", (F.col("levels") + distance).alias("levels"), *[f"a{i}" for i in range(len(sums))])
        totals = materialize(totals.unionByName(below).groupBy(*names, "node").agg(
            F.sum("members").alias("members"), F.max("levels").alias("levels"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(len(sums))]), "totals")
        jumps, distance = materialize(_far(jumps, names), "jumps"), 2 * distance
    return totals.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("node").alias(node), "members", "levels",
        *[F.col(f"a{i}").alias(s) for i, s in enumerate(sums)])


def edges_at(
    relations: DataFrame, moments: Sequence[str], child: str, parent: str, valid_from: str, valid_to: str, moment: str = "moment",
) -> DataFrame:
    """(moment, child, parent): the relations that hold on each of a few dates, such as the ends of quarters."""
    dates = F.explode(F.array(*[F.to_date(F.lit(m)) for m in moments]))
    held = relations.select(child, parent, F.to_date(valid_from).alias("_from"), F.to_date(valid_to).alias("_to"), dates.alias(moment))
    at = F.col(moment)
    return held.filter((F.col("_from") <= at) & (F.col("_to").isNull() | (at < F.col("_to")))).select(moment, child, parent)
