"""Merging overlapping groups: connected components by minimum label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.session import cut_lineage, small

GROUP = 10_000  # members of one group that meet under one key


def _split(rows: DataFrame, size: int) -> DataFrame:
    """(g, m) of groups of about `size` members at most that connect what the given groups connect.

    A larger group becomes a tree: its members are dealt by hash to parts, and the
    smallest members of the parts form a group of their own, which is split again.
    """
    levels, level = [], 0
    rows = rows.select(F.struct(F.lit(0).alias("level"), F.col("g"), F.lit(0).cast("bigint").alias("part")).alias("g"), "m")
    while True:
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        large = small(sizes.filter(F.col("n") > size))
        if large.isEmpty():
            return _union([*levels, rows])
        level += 1
        dealt = cut_lineage(rows.join(large, "g").withColumn("part", F.pmod(F.xxhash64("m", F.lit(level)), F.ceil(F.col("n") / size) + 1)))
        parts = dealt.select(F.struct(F.lit(-level).alias("level"), F.col("g.g").alias("g"), F.col("part")).alias("g"), "m")
        levels += [rows.join(large, "g", "left_anti"), parts]
        tops = dealt.groupBy("g", "part").agg(F.min("m").alias("m"))
        rows = cut_lineage(tops.select(F.struct(F.lit(level).alias("level"), F.col("g.g").alias("g"), F.lit(0).cast("bigint").alias("part")).alias("g"), "m"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_groups(groups: DataFrame, member: str = "member", group: str = "group_id",
                 stop: DataFrame | None = None, group_size: int = GROUP) -> DataFrame:
    """member, component: members of overlapping groups share a component.

    Members in ``stop`` are removed first and groups left with one member do not
    connect anything. The component is the smallest member in it. Groups of more than
    ``group_size`` members are split into trees of small ones first, so no key holds a
    large group; then each group goes by its smallest member, so that the rounds move pairs of
    members only. Each round takes the minimum over groups and then over members (both
    combine on the map side) and follows labels to their own label, by a small table
    where a label has more than ``group_size`` members; that halves the distance left. Rounds end when no
    label changes. Members of groups that were dropped are not in the result.
    """
    rows = groups.select(F.col(group).alias("g"), F.col(member).alias("m"))
    if stop is not None:
        rows = rows.join(stop.select(F.col(member).alias("m")), "m", "left_anti")
    rows, labels = _stars(rows, group_size), None
    while True:
        if labels is None:
            labels = rows.select("m").distinct().withColumn("label", F.col("m"))
        labelled = rows.join(labels, "m")
        by_group = labelled.groupBy("g").agg(F.min("label").alias("low"))
        near = cut_lineage(labelled.join(by_group, "g").groupBy("m").agg(F.min("low").alias("low"), F.first("label").alias("old")))
        # labels are members too: take over the label of the label
        new = cut_lineage(_jumped(near, group_size))
        if new.filter("label <> old").isEmpty():
            return new.select(F.col("m").alias(member), F.col("label").alias("component"))
        labels = new.drop("old")


def _stars(rows: DataFrame, size: int) -> DataFrame:
    """(g, m) with the smallest member of each group of two and more as g, which is a member of its own group.

    The names of the groups, which may be long, are needed here only; groups of more than
    ``size`` rows are split into trees first.
    """
    sizes = cut_lineage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"), F.max("m").alias("high")).filter("low < high"))
    large = small(sizes.filter(F.col("n") > size).select("g"))
    pairs = rows.join(sizes.filter(F.col("n") <= size).select("g", "low"), "g").select(F.col("low").alias("g"), "m")
    if not large.isEmpty():
        tree = _split(cut_lineage(rows.join(large, "g").distinct()), size)
        pairs = pairs.unionByName(tree.join(tree.groupBy("g").agg(F.min("m").alias("low")), "g").select(F.col("low").alias("g"), "m"))
    return cut_lineage(pairs.distinct())


def _jumped(near: DataFrame, size: int) -> DataFrame:
    """m, old, label: the label of the label, if it is smaller. Labels of many members are looked up in a small table."""
    lower = near.filter("low <> m").select(F.col("m").alias("low"), F.col("low").alias("lower"))
    hot = small(near.groupBy("low").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size).select("low"))
    if hot.isEmpty():
        found = near.join(lower, "low", "left")
    else:
        few = small(lower.join(hot, "low"))
        found = near.join(hot, "low", "left_semi").join(few, "low", "left").unionByName(near.join(hot, "low", "left_anti").join(lower, "low", "left"))
    return found.select("m", "old", F.coalesce("lower", "low").alias("label"))


def component_of(members: DataFrame, components: DataFrame, member: str = "member") -> DataFrame:
    """Look up the component of each member; a member of no group is its own."""
    return members.join(components, member, "left").withColumn("component", F.coalesce("component", member))
