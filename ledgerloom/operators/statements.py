"""Statements of a knowledge base: values out of their JSON, properties that a class uses, states of an entity, steps of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics

# Characters of a date that a stated precision (year, month, day) justifies
PRECISIONS = {9: 4, 10: 7, 11: 10}
#: A property that a class doesn't declare belongs to it if this share of its sample states it; properties of a class at most.
USAGE, PROPERTY_CAP = 0.25, 20


def main_value(snak: Column, language: str = "en") -> Column:
    """Kind, value, precision and unit of a statement's main value, given as JSON text.

    Null for an unknown or missing value, for text in another language, and for JSON of another shape.
    """
    v = F.try_parse_json(snak)
    at = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
    kind = at("datavalue.type")
    made = lambda name, value, precision=None, unit=None: F.struct(F.lit(name).alias("kind"), value.alias("value"), (F.lit(None).cast("int") if precision is None else precision).alias("precision"), (F.lit(None).cast("string") if unit is None else unit).alias("unit"))
    return F.when(
        at("snaktype") == "value",
        F.when(kind == "string", made("string", at("datavalue.value")))
        .when((kind == "monolingualtext") & (at("datavalue.value.language") == language), made("string", at("datavalue.value.text")))
        .when(kind == "wikibase-entityid", made("item", at("datavalue.value.id")))
        .when(kind == "time", made("time", at("datavalue.value.time"), at("datavalue.value.precision", "int")))
        .when(kind == "quantity", made("quantity", at("datavalue.value.amount"), None, at("datavalue.value.unit"))),
    )


def slot_value(main: Column, slot: Column, label: Column) -> Column:
    """A main value as a slot of this kind (date, number, integer or text) holds it, as text; null if it can't.

    Dates are cut to their precision, a magnitude with a unit fits no number, an item is its `label`.
    """
    value = F.regexp_replace(main["value"], r"^\++", "")
    width = F.coalesce(*(F.when(main["precision"] == p, w) for p, w in PRECISIONS.items()))
    number = value.try_cast("double")
    bare = F.coalesce(main["unit"], F.lit("1")).isin("1", "")
    integer = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    of_number = F.when((main["kind"] == "quantity") & bare, F.when(slot == "integer", integer).otherwise(number.cast("string")))
    of_text = F.when(main["kind"] == "string", main["value"]).when(main["kind"] == "item", label)
    return F.when(slot == "date", F.when((main["kind"] == "time") & width.isNotNull(), F.substring(value, F.lit(1), width))).when(slot.isin("number", "integer"), of_number).otherwise(of_text)


def holding(statements: DataFrame, by: list[str], rank: str, qualifiers: str, timed: tuple[str, ...] = ("P580", "P582", "P585")) -> DataFrame:
    """Statements that hold now: of the best rank in their group, none deprecated, none qualified by a time."""
    fresh = statements.where((F.col(rank) != "deprecated") & ~F.arrays_overlap(F.coalesce(F.col(qualifiers), F.array().cast("array<string>")), F.array(*map(F.lit, timed))))
    best = F.bool_or(F.col(rank) == "preferred").over(W.partitionBy(*by))
    return fresh.withColumn("_best", best).where(~F.col("_best") | (F.col(rank) == "preferred")).drop("_best")


def through_mapping(rows: DataFrame, key: str, mapping: DataFrame, source: str, target: str, order: str, to: str) -> DataFrame:
    """Rows whose key the mapping knows, with its target: of several for one source the first in order."""
    first = mapping.groupBy(F.col(source).alias(key)).agg(F.min_by(target, order).alias(to))
    return rows.join(first, key)


def with_integrity(rows: DataFrame, facts: DataFrame, key: str, agrees: Column, say: str) -> DataFrame:
    """Rows joined with facts by key. A joined row that doesn't agree is an error, not a row less."""
    said = F.concat(F.lit(f"{say}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return rows.join(facts, key).where(F.when(F.coalesce(agrees, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def outside(answers: DataFrame, admitted: DataFrame, on: list[str], by: list[str], least: int = 1) -> DataFrame:
    """Answers that no admitted combination covers, and their share, rolled up over `by` ("all" where it is summed)."""
    marked = answers.join(admitted.select(*on).distinct().withColumn("_in", F.lit(True)), on, "left")
    rolled = marked.rollup(*by).agg(F.count_if(F.col("_in").isNull()).alias("outside"), F.count("*").alias("answers"), *(F.grouping(b).alias(f"_{b}") for b in by))
    names = [F.when(F.col(f"_{b}") == 1, "all").otherwise(F.col(b).cast("string")).alias(b) for b in by]
    return rolled.where(F.col("answers") >= least).select(*names, "outside", "answers", metrics.ratio(F.col("outside"), F.col("answers")).alias("rate"))


def used_properties(observed: DataFrame, cls: str, instance: str, prop: str, usage: float = USAGE, cap: int = PROPERTY_CAP) -> DataFrame:
    """Properties that a share `usage` of a class's instances state, the commonest `cap` of each class (ties by property)."""
    pairs = observed.select(cls, instance, prop).distinct()
    sampled = pairs.groupBy(cls).agg(F.count_distinct(instance).alias("sampled"))
    counts = pairs.groupBy(cls, prop).agg(F.count("*").alias("stated")).join(sampled, cls)
    kept = counts.where(F.col("stated") >= F.greatest(F.lit(1), F.ceil(F.lit(usage) * F.col("sampled"))))
    return kept.withColumn("_rank", F.row_number().over(W.partitionBy(cls).orderBy(F.desc("stated"), prop))).where(F.col("_rank") <= cap).drop("_rank")


def distinct_sets(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The sorted distinct members of each key: sets of a vocabulary, of which one key's are held at once."""
    return rows.where(F.col(member).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))


def distinct_folded(values: Column, limit: int) -> Column:
    """The first `limit` values that are new but for case, in order."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.slice(F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1), 1, limit)


def merged(triples: DataFrame, classes: DataFrame, errors: DataFrame, by: list[str], step: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps of an answer as one: distinct triples, each entity's class from its last step, and all errors."""
    once = triples.select(*by, "entity", "property", "value").distinct()
    last = classes.groupBy(*by, "entity").agg(F.max_by("class", step).alias("class"))
    return once, last, errors.groupBy(*by).agg(F.sum("errors").alias("errors"))


def state_shape(pairs: DataFrame, by: list[str], left: dict[str, str], right: dict[str, str], equal: Column) -> DataFrame:
    """Medians of both sides' figures (name: column) together, and the share of pairs that are `equal`, for each group."""
    both = pairs.select(*by, *(F.col(c).alias(n) for n, c in left.items())).unionByName(pairs.select(*by, *(F.col(c).alias(n) for n, c in right.items())))
    middle = both.groupBy(*by).agg(*(F.percentile(n, 0.5).alias(n) for n in left))
    return middle.join(pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.round(F.avg(equal.cast("double")), 3).alias("equal")), by)


def rescored(cells: DataFrame, model: str) -> DataFrame:
    """tp, fp, fn and the ratios of each model, and of all together."""
    out = cells.rollup(model).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.grouping(model).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(model).cast("string")).alias(model), "tp", "fp", "fn").withColumns(metrics.prf())


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason, in order, whose test holds; null if none does. A test that is null doesn't hold."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in reasons))


def enough(rows: DataFrame, by: str, least: int) -> DataFrame:
    """Rows of groups that have at least so many."""
    return rows.join(rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(by), by, "left_semi")


def history_neighbours(revisions: DataFrame, entity: str, at: str, value: str, is_merge: Column, event: str) -> DataFrame:
    """For each entity, the value of the last revision before `event` that is no merge, and of the first after it."""
    rows = revisions.where(F.col(event).isNotNull())
    before = F.when((F.col(at) < F.col(event)) & ~is_merge, F.col(at))
    after = F.when(F.col(at) > F.col(event), F.col(at))
    return rows.groupBy(entity).agg(F.max_by(value, before).alias("before"), F.min_by(value, after).alias("after"))
