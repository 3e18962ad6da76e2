"""Recursive operators on graphs (tasks, roles, templates): levels, cycles, longest paths, closures.

All of them work on frontiers: each round joins the rows that changed in the last
one with the edges and combines them by node (or pair of nodes), so the work follows
nodes and edges, not paths, and chains may be of any length. Rounds are cut by
written tables; their files go when the next round is written.

Defined cases: nodes on a cycle, and those behind one, have no level and no finish;
repeated edges count once; an edge from or to null is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut, drop_cut


def _waves(nodes: DataFrame, edges: DataFrame, own: Column, step: Column) -> DataFrame:
    """node, value of all nodes whose prerequisites are settled: ``own`` for those without any, else the largest ``step`` over them.

    A node is settled one round behind the last of its prerequisites. ``nodes``: node
    and what ``own`` and ``step`` need; edges: node, needs. ``before`` is the value of a prerequisite.
    """
    needs = cut(edges.where("node is not null and needs is not null").select("node", "needs").distinct())
    waiting = cut(needs.groupBy("node").agg(F.count(F.lit(1)).alias("open")))
    settled = cut(nodes.join(waiting.select("node"), "node", "left_anti").select("node", own.alias("value")).distinct())
    parts, new, before = [settled], settled, None
    while not new.isEmpty():
        reached = new.select(F.col("node").alias("needs"), F.col("value").alias("before")).join(needs, "needs").groupBy("node").agg(F.count(F.lit(1)).alias("done"), F.max("before").alias("before"))
        if before is not None:
            reached = reached.unionByName(before.where("done < open").select("node", "done", "before")).groupBy("node").agg(F.sum("done").alias("done"), F.max("before").alias("before"))
        together = cut(reached.join(waiting, "node"))
        new = cut(together.where("done = open").select("node", "before").join(nodes, "node").select("node", step.alias("value")).distinct())
        if before is not None:
            drop_cut(before)
        before = together
        parts.append(new)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest chain of prerequisites; edges: node, needs (a node without prerequisites has ``needs`` null)."""
    nodes = edges.select("node").where("node is not null").distinct()
    return _waves(nodes, edges, F.lit(0), F.col("before") + 1).withColumnRenamed("value", "level")


def critical_path(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """node, finish: the earliest finish of each task behind its longest chain; tasks: node, duration; edges: node, needs."""
    nodes = tasks.select("node", "duration").where("node is not null")
    return _waves(nodes, edges, F.col("duration"), F.col("before") + F.col("duration")).withColumnRenamed("value", "finish")


def closure(edges: DataFrame) -> DataFrame:
    """node, reached: every pair that a path of one edge or more connects; edges: node, next (with cycles or without).

    Paths double from round to round: new pairs are joined with all pairs known.
    """
    known = cut(edges.where("node is not null and next is not null").select("node", F.col("next").alias("reached")).distinct())
    new = known
    while not new.isEmpty():
        longer = new.select("node", F.col("reached").alias("at")).join(known.select(F.col("node").alias("at"), "reached"), "at").select("node", "reached")
        longer = longer.unionByName(known.select("node", F.col("reached").alias("at")).join(new.select(F.col("node").alias("at"), "reached"), "at").select("node", "reached"))
        found = cut(longer.distinct().join(known, ["node", "reached"], "left_anti"))
        more = cut(known.unionByName(found))
        if new is not known:
            drop_cut(new)
        drop_cut(known)
        known, new = more, found
    return known


def cycles(edges: DataFrame) -> DataFrame:
    """node: the nodes that reach themselves; edges: node, next.

    Nodes that nothing leads to, or that lead nowhere, can't lie on a cycle and are
    peeled off round by round; what is left is closed.
    """
    left = cut(edges.where("node is not null and next is not null").select("node", "next").distinct())
    size = left.count()
    while True:
        inner = left.join(left.select(F.col("next").alias("node")).distinct(), "node", "left_semi").join(left.select(F.col("node").alias("next")).distinct(), "next", "left_semi")
        inner = cut(inner.select("node", "next"))
        drop_cut(left)
        left, before, size = inner, size, inner.count()
        if size == before:
            return closure(left).where("node = reached").select("node")


def cycle_chains(edges: DataFrame) -> DataFrame:
    """node, chain: of each node on a cycle a shortest chain of nodes that leads back to it, the node first and last; edges: node, next.

    Of equally short chains the smallest one by its nodes is given. One row a node and
    place is kept in each round (not one a path).
    """
    on = cut(cycles(edges))
    inner = cut(edges.join(on, "node", "left_semi").join(on.select(F.col("node").alias("next")), "next", "left_semi").select("node", "next").distinct())
    walk = cut(inner.select("node", F.col("next").alias("at"), F.array("node", "next").alias("chain")))
    seen, done = walk, []
    while not walk.isEmpty():
        done.append(walk.where("node = at").select("node", "chain"))
        found = done[-1].select("node")
        longer = walk.where("node <> at").join(found, "node", "left_anti").join(inner.select(F.col("node").alias("at"), F.col("next").alias("then")), "at")
        longer = longer.groupBy("node", "then").agg(F.min(F.array_append("chain", F.col("then"))).alias("chain")).withColumnRenamed("then", "at")
        walk = cut(longer.join(seen.select("node", "at"), ["node", "at"], "left_anti").select("node", "at", "chain"))
        seen = cut(seen.unionByName(walk))
    out = done[0] if done else walk.select("node", "chain")
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("node").agg(F.min_by("chain", F.struct(F.size("chain"), F.col("chain"))).alias("chain"))
