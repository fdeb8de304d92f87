"""Declarations along a class graph: the nearest wins; and edges that may be kept without a cycle."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, written


def effective(parents: DataFrame, declared: DataFrame) -> DataFrame:
    """(class, name, value, from): each name's nearest declaration over (class, parent, ordinal); own declarations first.

    Nearness is depth, then the order in which parents are listed along the path. A cycle is walked once. A round for each level
    keeps one route, the first by order, to each ancestor that is new, so paths are never listed; rounds go to the shared folder.
    """
    folder = shared_folder(parents.sparkSession)
    up = parents.select(F.col("class").alias("at"), "parent", F.col("ordinal").cast("int").alias("ordinal"))
    classes = declared.select("class").unionAll(parents.select("class")).unionAll(parents.select("parent")).distinct()
    start = classes.select("class", F.col("class").alias("at"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("route"))
    rounds = [fresh := written(start, f"{folder}/0")]
    while not fresh.isEmpty():
        known = functools.reduce(DataFrame.unionAll, rounds).select("class", F.col("at").alias("parent"))
        further = fresh.join(up, "at").select("class", "parent", F.array_append("route", F.col("ordinal")).alias("route"))
        first = further.groupBy("class", "parent").agg(F.min("route").alias("route")).join(known, ["class", "parent"], "left_anti")
        fresh = written(first.select("class", F.col("parent").alias("at"), F.lit(len(rounds)).alias("depth"), "route"), f"{folder}/{len(rounds)}")
        rounds.append(fresh)
    near = F.struct("depth", "route", "at")
    found = functools.reduce(DataFrame.unionAll, rounds).join(declared.select(F.col("class").alias("at"), "name", "value"), "at")
    return found.groupBy("class", "name").agg(F.min_by("value", near).alias("value"), F.min_by("at", near).alias("from"))


def acyclic(edges: DataFrame, group: str, source: str, target: str) -> DataFrame:
    """Edges of each group in sorted order, but for those whose target already reaches their source.

    Every decision depends on those before: a group is one sorted stream that holds the edges it kept.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out = None, {}

        def reaches(a, b) -> bool:
            stack, seen = [a], set()
            while stack:
                x = stack.pop()
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    stack += out.get(x, ())
            return False

        for frame in frames:
            keep = []
            for g, s, t in zip(frame[group], frame[source], frame[target], strict=True):
                if g != at:
                    at, out = g, {}
                fits = not reaches(t, s)
                if fits:
                    out.setdefault(s, []).append(t)
                keep.append(fits)
            yield frame[keep]

    return edges.repartition(n, group).sortWithinPartitions(group, source, target).mapInPandas(walk, edges.schema)
