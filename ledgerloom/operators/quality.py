"""Gates: what a corpus, a chain or a run must satisfy, as tables of violations that are empty when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics

#: Controls may score this much at most: answers without content, and answers in the corpus's spelling alone.
CONTROL_CEILING, SPELLING_CEILING = 0.01, 0.25


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, id) for each row and each rule whose condition isn't true."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("id"))


def refuse(found: DataFrame, what: str, show: int = 20) -> None:
    """Raise with the first violations, if there are any."""
    rows = found.orderBy("rule", "id").limit(show).collect()
    if rows:
        raise ValueError(f"{what}: " + "; ".join(f"{r['rule']}: {r['id']}" for r in rows))


def accounting_rules(rows_in: str, resolved: str, excluded: str, per_class: str) -> dict[str, Column]:
    """What a header must add up to; `excluded` and `per_class` are maps to counts."""
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return {"in = resolved + excluded": F.col(rows_in) == F.col(resolved) + total(excluded), "classes = resolved": total(per_class) == F.col(resolved)}


def digest_matches(text: str, sha256: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256) == F.col(sha256)


def ambiguous(holders: DataFrame, name: str, holder: str) -> DataFrame:
    """Names with more than one holder."""
    return holders.groupBy(name).agg(F.count_distinct(holder).alias("holders")).where("holders > 1")


def preflight(controls: DataFrame, ceilings: dict[str, float] | None = None) -> DataFrame:
    """Controls (control, condition, f1) whose best mean over conditions is above their ceiling: a run must not start on them."""
    limits = {"spelling": SPELLING_CEILING, **(ceilings or {})}
    best = controls.groupBy("control", "condition").agg(F.avg("f1").alias("f1")).groupBy("control").agg(F.max("f1").alias("f1"))
    ceiling = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("control")), F.lit(CONTROL_CEILING))
    return best.withColumn("ceiling", ceiling).where("f1 > ceiling")


def chain_lengths(exchanges: DataFrame, calls: DataFrame, task: str) -> DataFrame:
    """Tasks whose exchanges and calls differ in number."""
    n = lambda df, name: df.groupBy(task).agg(F.count("*").alias(name))
    both = n(exchanges, "exchanges").join(n(calls, "calls"), task, "full").fillna(0, ["exchanges", "calls"])
    return both.where("exchanges <> calls")


def zip_chain(exchanges: DataFrame, calls: DataFrame, task: str, order: str) -> DataFrame:
    """The n-th exchange of each task beside its n-th call; both sides keep their other columns."""
    from pyspark.sql import Window as W

    numbered = lambda df: df.withColumn("step", F.row_number().over(W.partitionBy(task).orderBy(order))).drop(order)
    return numbered(exchanges).join(numbered(calls), [task, "step"])


def fillable_counts(df: DataFrame, wanted: str, produced: str) -> DataFrame:
    """tp, fp, fn of two arrays of names, and the ratios."""
    out = df.withColumns({"tp": F.size(F.array_intersect(wanted, produced)), "fp": F.size(F.array_except(produced, wanted)), "fn": F.size(F.array_except(wanted, produced))})
    return out.withColumns(metrics.prf())


def step_score(counts: DataFrame, exhaustive: str) -> Column:
    """What a step reports: f1 where the corpus names everything, else recall."""
    return F.when(F.col(exhaustive), F.col("f1")).otherwise(F.col("recall"))
