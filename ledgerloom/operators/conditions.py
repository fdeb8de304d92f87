"""Names of experiment conditions: the report's key, the runner's key, and what a run was tuned on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(name: str, word: str) -> Column:
    return F.when(F.col(name), F.lit(word))


def _steps() -> Column:
    """The orchestration and the size of its shortlist, unless it is the default."""
    size = F.coalesce(F.concat(F.lit("(k"), F.col("shortlist_k").cast("string"), F.lit(")")), F.lit(""))
    return F.when(F.col("orchestration") != "single_shot", F.concat(F.col("orchestration"), size))


def report_key(band: Column | None = None) -> Column:
    """arm and its axes that differ from the default, joined by slashes; the fidelity band comes last.

    Columns: arm, signal, vocabulary, catalogue_size, pin_units, describe_catalogue, embed_nested, strict_readings,
    orchestration, shortlist_k, plan_retry, unit_match, reasoning, language. Null or false axes leave no trace.
    """
    parts = [
        F.col("arm"), F.col("signal"), F.col("vocabulary"), F.concat(F.lit("n"), F.col("catalogue_size").cast("string")), _flag("pin_units", "units"), _flag("describe_catalogue", "described"),
        _flag("embed_nested", "embedded"), _flag("strict_readings", "strict-readings"), _steps(), _flag("plan_retry", "retry"), F.when(F.col("unit_match") == "physical", "physical"),
        F.concat(F.lit("think:"), F.col("reasoning")), F.col("language"), *([F.concat(F.lit("fid"), band)] if band is not None else []),
    ]
    return F.concat_ws("/", *(F.when(p != "", p) for p in parts))


def runner_key() -> Column:
    """arm, signal and vocabulary always; then the axes, in the runner's order, that differ from the default."""
    parts = [
        F.coalesce("arm", F.lit("")), F.coalesce("signal", F.lit("")), F.coalesce("vocabulary", F.lit("")), F.when(~F.col("describe_catalogue"), F.lit("bare")), _steps(),
        F.concat(F.lit("n"), F.col("catalogue_size").cast("string")), F.when(~F.col("pin_units"), F.lit("open-units")), F.when(F.col("unit_match") == "physical", "physical"), F.when(F.col("output_form") != "json", F.col("output_form")),
        _flag("embed_nested", "embedded"), _flag("strict_readings", "strict-readings"), _flag("plan_retry", "retry"), F.concat(F.lit("think:"), F.col("reasoning")), F.col("language"),
    ]
    return F.concat_ws("/", *parts)


# What an arm was called before its name said what it carries and enforces
FORMER_ARMS = {
    "A0-prose": "no-catalog-not-enforced-prose", "A0-json": "no-catalog-not-enforced", "A1": "schema-dump-catalog-not-enforced-gated", "A1-lean": "catalog-not-enforced-gated",
    "A2": "schema-dump-catalog-flat-enforced", "A2-strict": "schema-dump-catalog-flat-enforced-strict", "A2-enforced-only": "catalog-flat-enforced", "A3": "schema-dump-catalog-flat-enforced-grounded",
    "A4": "schema-dump-catalog-enforced", "A4-strict": "schema-dump-catalog-enforced-strict", "A4-enforced-only": "catalog-enforced", "A4-blind": "no-catalog-enforced",
}
_ARM = "^(schema-dump-catalog|no-catalog|catalog)-+(not-enforced|flat-enforced|enforced)((?:-.*)?)$"


def published_name(arm: Column, described: Column, embedded: Column) -> Column:
    """The context and the enforcement that an arm names, resolved by whether classes are described and entities embedded.

    An arm that doesn't name both is an error: a default would call a constrained cell unconstrained.
    """
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FORMER_ARMS.items() for x in pair)), arm), arm)
    context, accepts, rest = (F.regexp_extract(name, _ARM, i) for i in (1, 2, 3))
    told = F.when(context != "catalog", context).when(F.coalesce(described, F.lit(False)), "schema-prose-full-catalog").otherwise("schema-prose-catalog")
    label = F.concat(told, F.lit("-"), accepts, rest, F.when(F.coalesce(embedded, F.lit(False)), "-embedded").otherwise(""))
    bad = F.raise_error(F.concat(F.lit("arm names no context and enforcement: "), F.coalesce(arm, F.lit("null")))).cast("string")
    return F.when(F.coalesce(name, F.lit("")).rlike(_ARM), label).otherwise(bad)


def differing(declared: str, actual: str) -> Column:
    """Sorted names that two maps of settings give different values, or that only one has."""
    names = F.array_union(F.map_keys(declared), F.map_keys(actual))
    return F.array_sort(F.filter(names, lambda k: ~F.coalesce(F.try_element_at(F.col(declared), k).eqNullSafe(F.try_element_at(F.col(actual), k)), F.lit(False))))


def training_status(declared: str, actual: str, tuned: str) -> Column:
    """base for an untuned model, undeclared without a declaration, else matched or mismatched."""
    return F.when(~F.col(tuned), "base").when(F.col(declared).isNull(), "undeclared").when(F.size(differing(declared, actual)) == 0, "matched").otherwise("mismatched")


def task_item(notes: Column) -> Column:
    """The item id that a record's notes name; null without one."""
    return F.nullif(F.regexp_extract(notes, r"qid=(Q\d+)", 1), F.lit(""))


def spelling_answer(text: Column) -> Column:
    """What a model that only copies would answer: the first number and the words after it, joined by underscores."""
    number = F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)", 1)
    words = F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)", 2)
    return F.when(number != "", F.to_json(F.struct(number.alias("value"), F.regexp_replace(words, r"\s+", "_").alias("unit"))))
