"""Readers for vocabularies: directories of JSON schemas, and a JSON-LD graph of classes, properties and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import inheritance, joins

_SCHEMA = "title string, description string, `{uuid}` string, `{titles}` struct<en: string>, allOf array<struct<`$ref`: string>>, properties map<string, struct<enum: array<string>>>"
SUFFIX = ".schema.json"


def read_schemas(spark: SparkSession, folder: str, titles: str = "x-multilang-title", uuid: str = "x-uuid") -> DataFrame:
    """(name, label, description, uuid, parent, units) of each schema file; the last reference to another schema is the parent.

    `titles` and `uuid` are the keys under which the files keep labels by language and their identifier. A schema without a title
    bears its file's name; units are its own enumeration, null without one.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{SUFFIX}").text(folder).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    s = files.select("file", F.from_json("value", _SCHEMA.format(titles=titles, uuid=uuid)).alias("s"))
    refs = F.filter(F.coalesce(F.transform("s.allOf", lambda x: x["$ref"]), F.array().cast("array<string>")), lambda r: r.endswith(SUFFIX))
    parent = F.try_element_at(refs, F.lit(-1))
    units = F.filter(F.try_element_at("s.properties", F.lit("unit"))["enum"], lambda u: u.isNotNull())
    return s.select(
        F.coalesce("s.title", F.replace("file", F.lit(".json"), F.lit(""))).alias("name"), F.trim(f"s.`{titles}`.en").alias("label"), F.trim("s.description").alias("description"), F.col(f"s.`{uuid}`").alias("uuid"),
        F.replace(parent, F.lit(SUFFIX), F.lit("")).alias("parent"), F.when(F.size(units) > 0, units).alias("units"),
    )


def effective_units(schemas: DataFrame) -> DataFrame:
    """Each schema with the units that hold for it: its own, or those of the nearest ancestor that has any."""
    parents = schemas.where("parent IS NOT NULL").select(F.col("name").alias("class"), "parent", F.lit(0).alias("ordinal"))
    declared = schemas.where("units IS NOT NULL").select(F.col("name").alias("class"), F.lit("units").alias("name"), F.to_json("units").alias("value"))
    found = inheritance.effective(parents, declared).select(F.col("class").alias("name"), F.from_json("value", "array<string>").alias("effective"), "from")
    return schemas.join(found, "name", "left")


def _ids(node: Column, key: str) -> Column:
    """Ids under a key of a JSON-LD node, whether one object or a list."""
    return F.transform(F.coalesce(F.regexp_extract_all(F.try_element_at(node, F.lit(key)), F.lit(r'"@id"\s*:\s*"([^"]*)"'), F.lit(1)), F.array().cast("array<string>")), names.term)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(name, kinds, parents, domains, ranges, superseded, comment) of each node of a JSON-LD vocabulary."""
    whole = spark.read.option("wholetext", True).text(path)
    nodes = whole.select(F.explode(F.from_json("value", "`@graph` array<map<string, string>>")["@graph"]).alias("n"))
    at = lambda key: F.try_element_at("n", F.lit(key))
    kinds = F.when(F.startswith(at("@type"), F.lit("[")), F.from_json(at("@type"), "array<string>")).otherwise(F.array(at("@type")))
    return nodes.select(
        names.term(at("@id")).alias("name"), F.transform(kinds, names.term).alias("kinds"), _ids(F.col("n"), "rdfs:subClassOf").alias("parents"), _ids(F.col("n"), "schema:domainIncludes").alias("domains"),
        _ids(F.col("n"), "schema:rangeIncludes").alias("ranges"), (F.size(_ids(F.col("n"), "schema:supersededBy")) > 0).alias("superseded"), F.trim(F.regexp_replace(at("rdfs:comment"), r"\s+", " ")).alias("comment"),
    )


def lineage(graph: DataFrame) -> DataFrame:
    """(child, ancestor) of all classes."""
    return joins.closure(graph.select(F.col("name").alias("child"), F.explode("parents").alias("parent")), "child", "parent")


def plain_classes(graph: DataFrame, closed: DataFrame, closed_kinds: tuple[str, ...] = ("Enumeration", "DataType")) -> DataFrame:
    """Classes that are neither one of the closed kinds nor below one."""
    below = closed.where(F.col("ancestor").isin(*closed_kinds)).select(F.col("child").alias("name"))
    return graph.where(F.array_contains("kinds", "rdfs:Class") & ~F.col("name").isin(*closed_kinds)).join(below, "name", "left_anti")


def slot_kinds(graph: DataFrame, closed: DataFrame, kind_of: dict[str, str]) -> DataFrame:
    """(name, kind, members) of each property in use: the first kind, in order, that a range has; an enumeration's members; else text.

    A property without a range or a domain, or superseded, is left out.
    """
    members = graph.select(F.explode("kinds").alias("range"), "name").groupBy("range").agg(F.array_sort(F.collect_set("name")).alias("members"))
    enumerations = members.join(closed.where("ancestor = 'Enumeration'").select(F.col("child").alias("range")).distinct(), "range", "left_semi")
    used = graph.where("size(ranges) > 0 AND size(domains) > 0 AND NOT superseded").select("name", "ranges", F.posexplode("ranges").alias("_at", "range"))
    listed = used.join(enumerations, "range", "left").groupBy("name").agg(F.first("ranges").alias("ranges"), F.min_by("members", F.when(F.col("members").isNotNull(), F.col("_at"))).alias("members"))
    known = F.coalesce(*(F.when(F.array_contains("ranges", r), F.lit(k)) for r, k in kind_of.items()))
    return listed.select("name", F.coalesce(known, F.when(F.col("members").isNotNull(), "enum"), F.lit("text")).alias("kind"), F.when(known.isNull(), F.col("members")).alias("members"))
