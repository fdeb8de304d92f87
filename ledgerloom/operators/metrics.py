"""Counts of right, wrong and missed, and the reports made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATURATED = 0.99
#: Bands of what a schema keeps; the last of the named ones holds its bound.
BANDS = ((0.5, "<0.5"), (0.95, "0.5-0.95"))
WHOLE, TOP_BAND = (1.0, "~1.0"), ">1.0"


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return {"precision": ratio(t, t + p), "recall": ratio(t, t + n), "f1": ratio(2 * t, 2 * t + p + n), "support": t + n}


def confusion(df: DataFrame, truth: Column, said: Column, by: list[str]) -> DataFrame:
    """tp, fp, fn and the ratios of a yes/no judgement, for each value of `by` (all rows if empty)."""
    counts = df.groupBy(*by).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    return counts.withColumns(prf())


def tabulate(records: DataFrame, by: list[str], score: str, tokens: str, calls: str | None = None, chars: str | None = None) -> DataFrame:
    """One row for each group: observations, mean and deviation of the score, failures, and the cost of scored records.

    A record without a score is a failure and counts nowhere else. The deviation of one observation and the mean of none are 0.
    """
    scored = F.col(score).isNotNull()
    aggs = [
        F.count(score).alias("n"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("sd"),
        F.count_if(~scored).alias("failures"),
        F.coalesce(F.sum(F.when(scored, F.col(tokens))), F.lit(0)).cast("long").alias("tokens"),
    ]
    if calls:
        aggs.append(F.coalesce(F.sum(F.when(scored, F.col(calls))), F.lit(0)).cast("long").alias("calls"))
    if chars:
        aggs.append(F.coalesce(F.avg(F.when(scored, F.col(chars))), F.lit(0.0)).alias("document_chars"))
    out = records.groupBy(*by).agg(*aggs)
    return out.withColumn("tokens_per_task", ratio(F.col("tokens"), F.col("n")))


def tabulate_dimensions(records: DataFrame, by: list[str], dimensions: str) -> DataFrame:
    """Mean f1, precision and recall of each dimension, over the scores that have it, beside each group.

    `dimensions` is a map from name to a struct with f1, precision and recall; a dimension that a score lacks counts for nothing.
    """
    each = records.select(*by, F.explode(dimensions).alias("dimension", "_d"))
    return each.groupBy(*by, "dimension").agg(F.count("*").alias("n"), *(F.avg(F.col("_d")[m]).alias(m) for m in ("f1", "precision", "recall")))


def cell_summary(calls: DataFrame, by: list[str], score: str, tokens: str, cached: str) -> DataFrame:
    """Of each cell: scored and failed runs, mean score, and tokens a run, whole and net of what was cached."""
    scored = F.col(score).isNotNull()
    per_run = lambda c: F.coalesce(F.bround(F.avg(F.when(scored, c))), F.lit(0.0)).cast("long")
    out = calls.groupBy(*by).agg(F.count(score).alias("n"), F.count_if(~scored).alias("failures"), F.coalesce(F.round(F.avg(score), 4), F.lit(0.0)).alias("f1"), per_run(F.col(tokens)).alias("prompt_tokens"), per_run(F.col(cached)).alias("cached_tokens"))
    return out.withColumn("net_prompt_tokens", F.col("prompt_tokens") - F.col("cached_tokens"))


def drop_between(rows: DataFrame, by: list[str], half: str, first: str, second: str, score: str) -> DataFrame:
    """Mean score of both halves of each group, and how much the second lies below the first."""
    out = rows.groupBy(*by).agg(*(F.avg(F.when(F.col(half) == h, F.col(score))).alias(h) for h in (first, second)))
    return out.withColumn("fall", F.col(first) - F.col(second))


def unpivoted(rows: DataFrame, key: list[str], figures: list[str]) -> DataFrame:
    """One row for each figure, in their given order."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for i, n in enumerate(figures))))
    return rows.select(*key, each.alias("_f")).select(*key, "_f.*")


def saturated(table: DataFrame) -> DataFrame:
    return table.where(F.col("mean") >= SATURATED)


def single_observation(table: DataFrame) -> DataFrame:
    return table.where("n = 1")


def fidelity_band(c: Column) -> Column:
    out = F.when(c < BANDS[0][0], BANDS[0][1])
    for bound, name in BANDS[1:]:
        out = out.when(c < bound, name)
    return F.when(c.isNotNull(), out.when(c <= WHOLE[0], WHOLE[1]).otherwise(TOP_BAND))


def banded_conditions(records: DataFrame, condition: str, model: str, fidelity: str) -> DataFrame:
    """Each condition and model with all its bands joined in order, resolved before any grouping by them."""
    bands = records.groupBy(condition, model).agg(F.array_sort(F.collect_set(fidelity_band(F.col(fidelity)))).alias("bands"))
    label = F.when(F.size("bands") > 0, F.concat(F.col(condition), F.lit("/fid"), F.array_join("bands", "|"))).otherwise(F.col(condition))
    return bands.select(condition, model, label.alias("label"))


def error_kinds(records: DataFrame, error: str, by: list[str]) -> DataFrame:
    """Failures by exception type, the part of the message before the first colon."""
    return records.where(F.col(error).isNotNull()).groupBy(*by, F.substring_index(error, ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def top_messages(records: DataFrame, message: Column, k: int = 5) -> DataFrame:
    """The k commonest messages, ties by text."""
    return records.groupBy(message.alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(k)


def cost_rows(calls: DataFrame, step: str, tokens: str) -> DataFrame:
    """Calls and tokens for each step, and one row with the total."""
    both = calls.select(F.col(step).alias("step"), F.col(tokens).alias("tokens"))
    rows = both.rollup("step").agg(F.count("*").alias("calls"), F.sum("tokens").cast("long").alias("tokens"), F.grouping("step").alias("_total"))
    return rows.select(F.when(F.col("_total") == 1, "total").otherwise(F.col("step")).alias("step"), "calls", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def identity_score(judgements: DataFrame, truth: str, decision: str, route: str, by: list[str] = ()) -> DataFrame:
    """Accuracy, coverage, accuracy of what was decided, wrong merges, and decisions by route; unclear is no decision."""
    right, decided = F.col(truth) == F.col(decision), F.col(decision) != "unclear"
    out = judgements.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(decided).alias("decided"), F.count_if(right & decided).alias("right_decided"),
        F.count_if((F.col(decision) == "same") & (F.col(truth) == "different")).alias("wrong_merges"), F.count_if(decided & (F.col(route) == "agreement")).alias("by_agreement"),
    )
    return out.withColumns({"accuracy": ratio(F.col("right"), F.col("n")), "coverage": ratio(F.col("decided"), F.col("n")), "decided_accuracy": ratio(F.col("right_decided"), F.col("decided"))})


def cross_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each combination that occurs."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, by: list[str], decision: str) -> DataFrame:
    """Rows of each group, those with a decision, and their share."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(decision).alias("decided"))
    return out.withColumn("coverage", ratio(F.col("decided"), F.col("n")))


def guessable(values: DataFrame, cls: str, prop: str, value: str, class_floor: int, statement_floor: int) -> DataFrame:
    """For each class and property that is stated often enough, the share of its commonest value (ties: the least value)."""
    counts = values.groupBy(cls, prop, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(cls, prop).agg(F.sum("n").alias("stated"), F.max("n").alias("commonest"), F.max_by(F.col(value), F.struct(F.col("n"), F.lit(0) - F.xxhash64(value))).alias("_v"))
    per_class = best.groupBy(cls).agg(F.sum("stated").alias("_all"))
    return best.join(per_class, cls).where((F.col("_all") >= class_floor) & (F.col("stated") >= statement_floor)).select(cls, prop, "stated", "commonest", ratio(F.col("commonest"), F.col("stated")).alias("share"))


def least_telling(shares: DataFrame, cls: str, prop: str) -> DataFrame:
    """For each property the class in which its commonest value says most about it (ties: the first by name)."""
    best = F.struct("share", (-F.row_number().over(_by_name(prop, cls))).alias("_first"))
    ranked = shares.withColumn("_best", best)
    return ranked.groupBy(prop).agg(F.max_by(cls, "_best").alias(cls), F.max("share").alias("share"))


def _by_name(prop: str, cls: str):
    from pyspark.sql import Window as W

    return W.partitionBy(prop).orderBy(cls)


def class_errors(rows: DataFrame, expected: str, produced: str, k: int = 10) -> DataFrame:
    """The k commonest pairs of an expected class and another that was produced; ties by name."""
    wrong = rows.where(F.col(expected).isNotNull() & F.col(produced).isNotNull() & (F.col(expected) != F.col(produced)))
    return wrong.groupBy(expected, produced).agg(F.count("*").alias("n")).orderBy(F.desc("n"), expected, produced).limit(k)


def accounting(rows: DataFrame, reason: Column, by: list[str]) -> DataFrame:
    """In = resolved + excluded by reason, in each group; `closes` says whether it adds up."""
    judged = rows.withColumn("_reason", reason)
    out = judged.groupBy(*by).agg(F.count("*").alias("rows_in"), F.count_if(F.col("_reason").isNull()).alias("resolved"), F.count("_reason").alias("excluded"))
    return out.withColumn("closes", F.col("rows_in") == F.col("resolved") + F.col("excluded"))


def _stirling_rest(x: Column) -> Column:
    """What ln x! has beyond x ln x - x + ln(2 pi x) / 2, for x of 1 or more."""
    plain = F.ln(F.factorial(F.least(x, F.lit(16.0)).cast("int")).cast("double")) - (x + 0.5) * F.ln(x) + x - math.log(2 * math.pi) / 2
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360)))))) / x
    return F.when(x < 16, plain).otherwise(series)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Exact two-sided McNemar test over paired yes/no outcomes: the discordant counts and the p-value.

    The tail is summed from its largest term, C(n, k) / 2^n, each next one being (k - j) / (n - k + j + 1) of the one before.
    The j-th is exp(-j^2 / n) of the first at most, so those beyond 8 sqrt(n) (under 2e-28 each) leave a double sum as it is,
    bit by bit; they are not formed. The largest one comes from its deviance and Stirling's series, without a difference of
    large logarithms.
    """
    counts = pairs.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    n, k = (F.col("only_a") + F.col("only_b")).cast("double"), F.least("only_a", "only_b").cast("double")
    off = (n - 2 * k) / n
    deviance = n / 2 * (2 * off * F.atanh(off) + F.log1p(-off * off))
    inner = F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - deviance) * F.sqrt(n / (2 * math.pi) / k / (n - k))
    largest = F.when(k == 0, F.pow(F.lit(2.0), -n)).otherwise(inner)
    last = F.least(k, F.ceil(8 * F.sqrt(n)).cast("double")).cast("long")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))
    summed = F.aggregate(F.sequence(F.lit(0).cast("long"), last), start, lambda s, j: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (k - j) / (n - k + j + 1)).alias("term")), lambda s: s["sum"])
    return counts.withColumn("p_value", F.least(F.lit(1.0), 2 * largest * summed))
