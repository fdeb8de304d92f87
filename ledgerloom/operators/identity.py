"""Whether two records denote one entity: evidence in tiers, baselines, and near-equal names through shared shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

SAME, DIFFERENT, UNCLEAR = "same", "different", "unclear"
NEAR = 0.9


def shared_names(a: Column, b: Column) -> Column:
    """Names that two records share, in lower case."""
    low = lambda c: F.transform(c, F.lower)
    return F.array_intersect(low(a), low(b))


def property_agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(properties with a common value, properties of both whose values are disjoint) of two maps to arrays."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    meets = lambda p: F.arrays_overlap(F.element_at(a, p), F.element_at(b, p))
    return F.size(F.filter(both, meets)), F.size(F.filter(both, lambda p: ~meets(p)))


def evidence(names: Column) -> Column:
    """What a resolver needs of a record's names: made once for each record, before records are paired.

    For each name: its length and spelling (as one struct, so that the longer name is the greater), its lower case, its shingles,
    and whether it is telling.
    """
    return F.transform(names, lambda x: F.struct(F.struct(F.length(x).alias("n"), x.alias("v")).alias("name"), F.lower(x).alias("low"), text.shingles(text.bare_name(x)).alias("g"), text.informative(x).alias("telling"), text.informative(F.lower(x)).alias("low_telling")))


def best_match(a: Column, b: Column) -> Column:
    """The closest pair of names of two columns of evidence: struct(score, name, telling), name being its longer one; ties go to the
    longer, then the lesser name."""
    longer = lambda x, y: F.when(x["name"] >= y["name"], x).otherwise(y)
    score = lambda x, y: F.struct(text.jaccard(x["g"], y["g"]).alias("score"), longer(x, y)["name"].alias("name"), longer(x, y)["telling"].alias("telling"))
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: score(x, y)))))


def best_jaccard(a: Column, b: Column) -> Column:
    """The same of two arrays of names."""
    return best_match(evidence(a), evidence(b))


def resolve(pairs: DataFrame, names_a: str, names_b: str, claims_a: str, claims_b: str, judge: str | None = None) -> DataFrame:
    """Add decision and route: full agreement first, then a near-equal telling name, then the judge's column, else unclear.

    Names are arrays of names, or of their evidence if that was made before pairing.
    """
    made = lambda c: F.col(c) if "struct" in pairs.schema[c].dataType.simpleString() else evidence(F.col(c))
    out = pairs.withColumns({"_a": made(names_a), "_b": made(names_b)})
    agree, conflict = property_agreement(F.col(claims_a), F.col(claims_b))
    lows = F.transform("_b", lambda y: y["low"])
    telling = F.exists("_a", lambda x: x["low_telling"] & F.array_contains(lows, x["low"]))
    out = out.withColumn("_agrees", telling & (agree > 0) & (conflict == 0)).withColumn("_near", best_match(F.col("_a"), F.col("_b")))
    near = (F.col("_near.score") >= NEAR) & F.col("_near.telling")
    said = F.coalesce(F.col(judge), F.lit(UNCLEAR)) if judge else F.lit(UNCLEAR)
    decision = F.when(F.col("_agrees"), SAME).when(near, SAME).otherwise(said)
    route = F.when(F.col("_agrees"), "agreement").when(near, "prefilter").when((said != UNCLEAR) if judge else F.lit(False), "judge").otherwise("prefilter")
    return out.withColumn("decision", decision).withColumn("route", route).drop("_agrees", "_near", "_a", "_b")


def name_baseline(a: Column, b: Column) -> Column:
    return F.when(F.size(shared_names(a, b)) > 0, SAME).otherwise(DIFFERENT)


def property_baseline(a: Column, b: Column) -> Column:
    agree, conflict = property_agreement(a, b)
    return F.when((agree > 0) & (conflict == 0), SAME).otherwise(DIFFERENT)


def compatible(a: Column, b: Column) -> Column:
    """Equal, or either unknown."""
    return a.isNull() | b.isNull() | (a == b)


def judged(reply: Column) -> Column:
    """same, different or unclear out of a judge's reply: JSON, with or without a code fence around it."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-z]*\s*|\s*```$", "")
    said = F.lower(F.coalesce(F.try_variant_get(F.try_parse_json(bare), "$.outcome", "string"), F.lit("")))
    return F.when(said.isin("same", "match", "yes"), SAME).when(said.isin("different", "no match", "no"), DIFFERENT).otherwise(UNCLEAR)
