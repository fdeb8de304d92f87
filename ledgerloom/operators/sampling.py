"""Caps, strata and copies, by window functions over an explicit order."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cap_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group. Spark prunes with a group limit before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def require_groups(df: DataFrame, by: str, wanted: list[str]) -> DataFrame:
    """df if every wanted group has a row; else an error that names the first that lacks any."""
    held = {r[0] for r in df.select(by).where(F.col(by).isin(wanted)).distinct().collect()}
    missing = [w for w in wanted if w not in held]
    if missing:
        raise ValueError(f"no rows of {by} {missing[0]!r}")
    return df


#: Strata that a round may have: their first rows are numbered in one task.
MAX_STRATA = 1_000_000


def round_robin(df: DataFrame, stratum: str, order: list[str]) -> DataFrame:
    """Add turn and seat: the first of every stratum, then the second of each; strata in the order of their first rows.

    Over MAX_STRATA strata are an error rather than one task without bound.
    """
    within = W.partitionBy(stratum).orderBy(*order)
    firsts = df.groupBy(stratum).agg(F.min(F.struct(*order)).alias("_first"))
    if firsts.limit(MAX_STRATA + 1).count() > MAX_STRATA:
        raise ValueError(f"over {MAX_STRATA} strata")
    seats = firsts.withColumn("seat", F.row_number().over(W.orderBy("_first")).cast("long")).drop("_first")
    return df.withColumn("turn", F.row_number().over(within).cast("long")).join(F.broadcast(seats), stratum)


def even_spread(df: DataFrame, by: list[str], order: list, k: Column) -> DataFrame:
    """k rows of each group's n, evenly spaced from the first to the last; one: the middle. Halves round to even."""
    window = W.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(window)).withColumn("_k", F.least(k, F.col("_n")))
    # row i is kept if some j < k has round(j * (n - 1) / (k - 1)) = i, and j can only be near i * (k - 1) / (n - 1)
    near = F.floor(F.col("_i") * (F.col("_k") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.lit(False)
    for d in (0, 1):
        j = near + d
        hit = hit | ((j < F.col("_k")) & (F.bround(j * (F.col("_n") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))) == F.col("_i")))
    kept = F.when(F.col("_k") <= 1, (F.col("_k") == 1) & (F.col("_i") == F.floor(F.col("_n") / 2))).otherwise(hit)
    return rows.where(kept).drop("_i", "_n", "_k")


def matched_strata(df: DataFrame, stratum: str, cls: str, classes: list[str], order: list) -> DataFrame:
    """Strata that hold every class, thinned evenly so that each class has as many rows as the rarest there."""
    counts = df.where(F.col(cls).isin(classes)).groupBy(stratum, cls).count()
    room = counts.groupBy(stratum).agg(F.min("count").alias("_room"), F.count("*").alias("_classes")).where(F.col("_classes") == len(classes)).drop("_classes")
    return even_spread(df.where(F.col(cls).isin(classes)).join(room, stratum), [stratum, cls], order, F.col("_room")).drop("_room")


def first_copies(df: DataFrame, by: list[str], fingerprint: Column, order: list) -> DataFrame:
    """The first row of each fingerprint within a group; rows with the empty fingerprint, or none, all stay.

    One scan and one shuffle: a row without a print has its own key in place of it, so such rows are spread and never compete.
    """
    printed = F.coalesce(fingerprint, F.lit(""))
    own = F.when(printed == "", F.monotonically_increasing_id()).otherwise(F.lit(-1))
    marked = df.withColumn("_print", printed).withColumn("_own", own)
    rank = F.row_number().over(W.partitionBy(*by, "_print", "_own").orderBy(*order))
    return marked.withColumn("_rank", rank).where("_rank = 1").drop("_print", "_own", "_rank")


def first_values(rows: DataFrame, by: list[str], order: str, value: str, to: str) -> DataFrame:
    """The value that comes first in each group, and how many other values there are: a fold that counts its conflicts."""
    return rows.groupBy(*by).agg(F.min_by(value, order).alias(to), (F.count_distinct(value) - 1).alias("conflicts"))


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different ends."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def capped_values(df: DataFrame, group: str, key: str, facts: str, room: int) -> DataFrame:
    """In each group, walk entities by key and pass over one if any of its facts was already used `room` times.

    Each decision depends on all before it, so a group is one sorted stream in one task; it holds the counts of facts only.
    """
    schema = df.schema
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, {}
        for frame in frames:
            keep = []
            for g, held in zip(frame[group], frame[facts], strict=True):
                if g != at:
                    at, used = g, {}
                held = [] if held is None else list(held)
                fits = all(used.get(x, 0) < room for x in held)
                if fits:
                    for x in held:
                        used[x] = used.get(x, 0) + 1
                keep.append(fits)
            yield frame[keep]

    return df.repartition(n, group).sortWithinPartitions(group, key).mapInPandas(walk, schema)


#: Keys that a seeded sample is drawn from at most: they are sorted on the driver, so that the draw is the same anywhere.
MAX_DRAWN = 5_000_000


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by a seeded draw from the sorted distinct keys (all, if there are no more). Over MAX_DRAWN keys are an error."""
    keys = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).distinct().limit(MAX_DRAWN + 1).collect()]
    if len(keys) > MAX_DRAWN:
        raise ValueError(f"over {MAX_DRAWN} keys to draw from")
    chosen = random.Random(seed).sample(sorted(keys), min(n, len(keys)))
    drawn = df.sparkSession.createDataFrame([(k,) for k in chosen], T.StructType([df.schema[key]]))
    return df.join(F.broadcast(drawn) if len(chosen) <= 100_000 else drawn, key, "left_semi")


def split_halves(keys: DataFrame, key: str, seed: int, first: str = "train", second: str = "heldout") -> DataFrame:
    """Two disjoint halves by a seeded hash of the key: the same key is in the same half whatever else there is."""
    return keys.withColumn("half", F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2)) == 0, first).otherwise(second))
