"""Joins that the engine needs beyond equality: as-of, hierarchy closure, membership, priorities."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder, written


def as_of(probes: DataFrame, builds: DataFrame, by: list[str], probe_order: str, build_order: str, value: str, tie: str, clamp: bool = False) -> DataFrame:
    """Each probe row with the value of the last build row at or before it, of its group; null if there is none.

    With `clamp`, a probe before all build rows gets the first one's value instead, as an index's first block covers all keys
    below it. One shuffle by the group and one sort: both sides are stacked and the last build value is carried along.
    """
    names = probes.columns
    left = probes.select(*names, F.col(probe_order).alias("_at"), F.lit(1).alias("_probe"), F.lit(None).cast(builds.schema[value].dataType).alias("_value"), F.lit(None).cast(builds.schema[tie].dataType).alias("_tie"))
    right = builds.select(*(F.col(n) if n in by else F.lit(None).cast(probes.schema[n].dataType).alias(n) for n in names), F.col(build_order).alias("_at"), F.lit(0).alias("_probe"), F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    ordered = W.partitionBy(*by).orderBy("_at", "_probe", "_tie")
    found = F.last("_value", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    if clamp:
        found = F.coalesce(found, F.first("_value", ignorenulls=True).over(ordered.rowsBetween(0, W.unboundedFollowing)))
    return left.unionByName(right).withColumn("as_of", found).where("_probe = 1").select(*names, "as_of")


def with_next(rows: DataFrame, by: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """Add the value of the row that follows in its group; null for the last."""
    return rows.withColumn(to, F.lead(value).over(W.partitionBy(*by).orderBy(*order)))


def bucket_of(c: Column, edges: tuple[float, ...]) -> Column:
    """The number of edges at or below the value."""
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, ancestor) over any path, without a node as its own ancestor; cycles are walked once.

    Rounds of pairs that are new: each round joins them to all pairs known, so paths double in length, and drops what is known.
    Pairs are never more than the result and its loops, however many paths there are. Each round is written to the shared folder.
    """
    folder = shared_folder(edges.sparkSession)
    pairs = edges.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("ancestor")).where("child <> ancestor").distinct()
    rounds = [fresh := written(pairs, f"{folder}/0")]
    while not fresh.isEmpty():
        known = functools.reduce(DataFrame.unionAll, rounds)
        further = fresh.withColumnRenamed("ancestor", "via").join(known.withColumnRenamed("child", "via"), "via").select("child", "ancestor")
        back = known.withColumnRenamed("ancestor", "via").join(fresh.withColumnRenamed("child", "via"), "via").select("child", "ancestor")
        fresh = written(further.unionAll(back).distinct().join(known, ["child", "ancestor"], "left_anti"), f"{folder}/{len(rounds)}")
        rounds.append(fresh)
    return functools.reduce(DataFrame.unionAll, rounds).where("child <> ancestor")


def relation(pairs: DataFrame, a: str, b: str, closed: DataFrame) -> DataFrame:
    """Add relation: exact, broader (b is an ancestor of a), narrower or none."""
    up = closed.select(F.col("child").alias(a), F.col("ancestor").alias(b), F.lit(True).alias("_up"))
    down = closed.select(F.col("ancestor").alias(a), F.col("child").alias(b), F.lit(True).alias("_down"))
    out = pairs.join(up, [a, b], "left").join(down, [a, b], "left")
    return out.withColumn("relation", F.when(F.col(a) == F.col(b), "exact").when(F.col("_up"), "broader").when(F.col("_down"), "narrower").otherwise("none")).drop("_up", "_down")


def preferred_only(df: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Statements that hold: none that are deprecated, and of a group with preferred ones only those."""
    best = F.max(F.col(rank) == "preferred").over(W.partitionBy(*by))
    return df.where(F.col(rank) != "deprecated").withColumn("_best", best).where(~F.col("_best") | (F.col(rank) == "preferred")).drop("_best")


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key), key, "left_anti")


def both_known(links: DataFrame, source: str, target: str, known: DataFrame, key: str) -> DataFrame:
    """Links whose ends are both known and differ."""
    ends = known.select(F.col(key))
    found = links.where(F.col(source) != F.col(target)).join(ends.withColumnRenamed(key, source), source, "left_semi")
    return found.join(ends.withColumnRenamed(key, target), target, "left_semi")


def owners(spellings: DataFrame, spelling: str, unit: str) -> DataFrame:
    """For each spelling how many units it names (`owners`), and the unit if it is the only one."""
    out = spellings.groupBy(spelling).agg(F.min(unit).alias(unit), F.count_distinct(unit).alias("owners"))
    return out.withColumn(unit, F.when(F.col("owners") == 1, F.col(unit)))


def unambiguous(spellings: DataFrame, spelling: str, unit: str) -> DataFrame:
    """Spellings that name one unit only."""
    return owners(spellings, spelling, unit).where("owners = 1").drop("owners")


def first_spelling(rows: DataFrame, key: list[str], forms: str, spellings: DataFrame, spelling: str, unit: str) -> DataFrame:
    """The unit of the first form, in order, that a spelling names; keys without one are left out."""
    exploded = rows.select(*key, F.posexplode(forms).alias("_at", spelling))
    return exploded.join(spellings, spelling).groupBy(*key).agg(F.min_by(unit, "_at").alias(unit))


#: Rows of an axis at most, and of the whole grid: an experiment is declared, not computed.
MAX_AXIS, MAX_GRID = 100_000, 100_000_000


def other_of_group(df: DataFrame, key: str, order: str) -> DataFrame:
    """Add other: the first key of the table, and for that row the second ("another document"). Null for a single row."""
    two = [r[0] for r in df.orderBy(order).select(key).limit(2).collect()]
    first, second = (F.lit(x).cast(df.schema[key].dataType) for x in (*two, None, None)[:2])
    return df.withColumn("other", F.when(F.col(key) == first, second).otherwise(first))


def grid(*axes: DataFrame, repetitions: int = 1) -> DataFrame:
    """Every combination of small axes, numbered repetitions of each. An axis of over MAX_AXIS rows is an error."""
    out, size = axes[0], max(1, repetitions)
    for axis in axes:
        rows = axis.limit(MAX_AXIS + 1).count()
        size *= max(1, rows)
        if rows > MAX_AXIS or size > MAX_GRID:
            raise ValueError(f"a grid of over {MAX_AXIS} rows an axis or {MAX_GRID} in all")
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out.withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(repetitions).cast("long"))))
