"""Whether a corpus can be answered and read: round trips, what a reader loses, known answers and controls, rescored records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conditions, generate, metrics, scoring

#: Dimensions in which a perfect answer must be whole.
WHOLE = ("value", "class", "entity")


def round_trips(tasks: DataFrame) -> DataFrame:
    """Tasks with `whole`: whether their own perfect answer, written and read again, scores 1 in every dimension of WHOLE."""
    scores = scoring.score_tasks(tasks, generate.control_answers(tasks, "perfect"))
    wrong = F.col("fp") + F.col("fn") > 0
    lost = scores.where(F.col("dimension").isin(*WHOLE, "parse_errors")).groupBy("task_id").agg(F.bool_or(wrong).alias("_lost"))
    return tasks.join(lost, "task_id", "left").withColumn("whole", ~F.coalesce("_lost", F.lit(False))).drop("_lost")


def parse_loss(tasks: DataFrame) -> DataFrame:
    """One row: how well the prose reader reads the documents themselves. No answer in prose can score more than that."""
    scores = scoring.score_tasks(tasks, tasks.select("task_id", F.col("document").alias("answer")), prose=True)
    each = scores.groupBy("task_id").agg(*(F.sum(F.when(F.col("dimension") == "value", F.col(c))).alias(c) for c in ("tp", "fp", "fn")), F.sum(F.when(F.col("dimension") == "parse_errors", F.col("fp"))).alias("errors"))
    return each.withColumns(metrics.prf()).agg(F.count("*").alias("tasks"), F.avg("f1").alias("f1"), F.sum("errors").alias("errors"))


def controls(tasks: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(control, dimension) with counts and ratios over all tasks, for each control's answers."""
    out = None
    for control in names:
        scored = scoring.score_tasks(tasks, generate.control_answers(tasks, control)).groupBy("dimension").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("control", F.lit(control))
        out = scored if out is None else out.unionByName(scored)
    return out.withColumns(metrics.prf())


def violations(found: DataFrame, ceilings: dict[str, float], dimension: str = "value") -> DataFrame:
    """Controls that break their bound: the perfect and nested ones must score 1, the others no more than their ceiling."""
    bound = F.coalesce(*(F.when(F.col("control") == k, F.lit(v)) for k, v in ceilings.items()), F.lit(0.0))
    perfect = F.col("control").isin("perfect", "nested")
    return found.where(F.col("dimension") == dimension).where(F.when(perfect, F.col("f1") < 1.0).otherwise(F.col("f1") > bound)).select("control", "f1")


def rescored(records: DataFrame, tasks: DataFrame, notes: str, answer: str) -> DataFrame:
    """Scores of stored answers against the corpus as it is now: records whose notes name no task that is still there are left out."""
    named = records.select("*", conditions.task_item(F.col(notes)).alias("task_id")).where("task_id IS NOT NULL").withColumn("_row", F.monotonically_increasing_id().cast("string"))
    both = named.select("_row", "task_id", F.col(answer).alias("answer"), *(c for c in records.columns if c not in (notes, answer, "task_id"))).join(tasks, "task_id")
    scores = scoring.score_tasks(both.select(F.col("_row").alias("task_id"), "document", "expected", "parents"), both.select(F.col("_row").alias("task_id"), "answer"))
    kept = [c for c in records.columns if c not in (notes, answer, "task_id")]
    return scores.withColumnRenamed("task_id", "_row").join(both.select("_row", "task_id", *kept), "_row").drop("_row")
