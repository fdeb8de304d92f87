"""What a task offers and expects: catalogues cut to size, answers that are known, seeds that are accepted."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def offered(catalogue: Column, value_objects: Column, embed: Column) -> Column:
    """The classes on offer: with embedding, none that are reached through the slot of another. An error if that leaves none."""
    rest = F.filter(catalogue, lambda c: ~F.array_contains(value_objects, c))
    empty = F.raise_error(F.lit("only value objects on offer")).cast("array<string>")
    return F.when(~embed | (F.size(catalogue) == 0), catalogue).otherwise(F.when(F.size(rest) > 0, rest).otherwise(empty))


def trimmed(on_offer: Column, needed: Column, limit: Column) -> Column:
    """At most `limit` classes (null: all): those that the task needs, then others in their order. An error if it needs more."""
    wanted = F.array_distinct(F.filter(needed, lambda c: F.array_contains(on_offer, c)))
    filled = F.slice(F.concat(wanted, F.array_except(on_offer, wanted)), 1, F.greatest(F.coalesce(limit, F.lit(0)), F.lit(1)))
    short = F.raise_error(F.concat(F.lit("needed classes: "), F.size(wanted).cast("string"))).cast("array<string>")
    return F.when(limit.isNull() | (limit >= F.size(on_offer)), on_offer).when(F.size(wanted) > limit, short).otherwise(filled)


def shuffled(names: Column, task: Column) -> Column:
    """An order that depends on the task alone, so that no place in it gives the answer away."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series, ids: pd.Series) -> pd.Series:
        def one(values, key):
            if values is None:
                return None
            out = list(values)
            random.Random(f"catalogue:{key}").shuffle(out)
            return out

        return pd.Series([one(v, k) for v, k in zip(lists, ids, strict=True)])

    return run(names, task)


def known_answers(tasks: DataFrame, key: str, expected: str) -> DataFrame:
    """What each step of a task would answer if it knew: each entity's class, its mention, and the slots that it fills.

    `expected` is an array of (key, class, mentions, fields, optional); an entity without a mention is called by its key.
    """
    e = tasks.select(key, F.explode(expected).alias("_e"))
    optional = F.coalesce(F.map_keys("_e.optional"), F.array().cast("array<string>"))
    fields = F.coalesce(F.map_keys("_e.fields"), F.array().cast("array<string>"))
    return e.select(
        key, F.col("_e.key").alias("entity"), F.array(F.col("_e.class")).alias("shortlist"), F.coalesce(F.get("_e.mentions", F.lit(0)), F.col("_e.key")).alias("mention"),
        fields.alias("fillable"), F.concat(fields, F.array_except(optional, fields)).alias("fillable_optional"),
    )


def first_accepted(rows: DataFrame, order: str, accepted: Column, count: int) -> tuple[DataFrame, int]:
    """(the first `count` rows by order that are accepted, how many before the last of them were not).

    Rows are made for a whole range of seeds at once; the walk that would make them one by one ends at the last one kept.
    """
    kept = rows.where(accepted).orderBy(order).limit(count)
    last = kept.agg(F.max(order)).first()[0]
    rejected = 0 if last is None else rows.where(~F.coalesce(accepted, F.lit(False)) & (F.col(order) < last)).count()
    return kept, rejected


def pruned(node: Column, dropped: tuple[str, ...]) -> Column:
    """JSON text without the keys that are dropped, at any depth; prefixes of the vocabulary don't hide a key."""
    import json

    gone = set(dropped)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def bare(key: str) -> str:
            return key.strip().removeprefix("https://schema.org/").removeprefix("http://schema.org/").removeprefix("schema:")

        def cut(x):
            if isinstance(x, dict):
                return {k: cut(v) for k, v in x.items() if bare(k) not in gone}
            return [cut(v) for v in x] if isinstance(x, list) else x

        return texts.map(lambda t: None if t is None else json.dumps(cut(json.loads(t)), ensure_ascii=False))

    return run(node)


def hard_tier(pairs: DataFrame, truth: str, shares_name: str) -> DataFrame:
    """Pairs of one entity that share no name: what a resolver is tested for."""
    return pairs.where((F.col(truth) == "same") & ~F.col(shares_name))
