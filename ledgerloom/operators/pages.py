"""Pages to documents: the fields of a page's markup that its text states, entities with their links, and why a page is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..sources.harvest import detagged
from . import grounding

#: Characters of a value at most.
MAX_VALUE = 400


def values_of(json: Column) -> Column:
    """Values of a property's JSON text as text: of a list each, of an object its name or text. Null where one of them is no value."""
    items = F.when(F.startswith(json, F.lit("[")), F.from_json(json, "array<string>")).otherwise(F.array(json))
    unwrapped = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(F.nullif(F.trim(F.get_json_object(x, "$.name")), F.lit("")), F.nullif(F.trim(F.get_json_object(x, "$.text")), F.lit("")))).otherwise(F.when(~x.isin("true", "false", "null"), x))
    read = F.transform(items, unwrapped)
    return F.when((F.size(read) > 0) & F.forall(read, lambda x: x.isNotNull()), read)


def stated_fields(nodes: DataFrame, by: list[str], node: str, text: str, left_out: tuple[str, ...] = (), classes: tuple[str, ...] = ()) -> DataFrame:
    """(by, property, values, stated) of each literal property of markup nodes (JSON text) beside their page's text.

    A property is stated if all of its values are in the text and none is given away by its label. Keys with @, those left out,
    properties that reach an entity of one of `classes`, and properties with a value that is none are passed over.
    """
    each = nodes.select(*by, F.col(text).alias("_text"), F.explode(F.from_json(node, "map<string, string>")).alias("_key", "_json"))
    each = each.withColumn("property", names.term(F.col("_key"))).where(~F.startswith("property", F.lit("@")) & ~F.col("property").isin(*left_out))
    if classes:
        kinds = F.regexp_extract_all("_json", F.lit(r'"@type"\s*:\s*"([^"]*)"'), F.lit(1))
        each = each.where(~F.exists(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: names.term(k).isin(*classes)))
    rows = each.withColumn("_values", values_of(F.col("_json"))).where("_values IS NOT NULL")
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode("_values").alias("_at", "_value"))
    rows = rows.withColumn("_value", detagged(F.col("_value")))
    usable = (F.length("_value") > 0) & (F.length("_value") <= MAX_VALUE)
    ok = grounding.grounded(F.col("_value"), F.col("_text")) & ~grounding.gives_away(F.col("property"), F.col("_value"), F.col("_text"))
    judged = rows.withColumns({"_usable": usable, "_ok": ok})
    entry = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_value"))), lambda x: x["_value"])
    out = judged.groupBy("_row", *by, "property").agg(entry.alias("values"), F.bool_and("_ok").alias("stated"), F.bool_and("_usable").alias("_usable"))
    return out.where("_usable").drop("_row", "_usable")


def entities(graph: DataFrame, page: str, node: str, classes: tuple[str, ...]) -> DataFrame:
    """(page, id, parent, property, class, content) of each node of a page's JSON tree that is of one of `classes`, with the
    nearest such node above it and the property that leads to it."""
    import json as J
    from collections.abc import Iterator

    import pandas as pd

    kind = graph.schema[page].dataType.simpleString()
    wanted = set(classes)

    def bare(name) -> str:
        return str(name).strip().removeprefix("https://schema.org/").removeprefix("http://schema.org/").removeprefix("schema:")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, text in zip(f[page], f[node], strict=True):
                stack = [(J.loads(text), None, None)] if text else []
                made = 0
                while stack:
                    value, parent, prop = stack.pop()
                    if isinstance(value, list):
                        stack += [(x, parent, prop) for x in reversed(value)]
                        continue
                    if not isinstance(value, dict):
                        continue
                    said = value.get("@type", value.get("type"))
                    cls = next((bare(x) for x in (said if isinstance(said, list) else [said]) if isinstance(x, str) and bare(x) in wanted), None)
                    if cls:
                        rows.append((key, made, parent, prop, cls, J.dumps(value, ensure_ascii=False, sort_keys=True)))
                        parent, made = made, made + 1
                    stack += [(v, parent, bare(k)) for k, v in reversed(value.items())]
            yield pd.DataFrame(rows, columns=[page, "id", "parent", "property", "class", "content"]).astype({"id": "Int64", "parent": "Int64"})

    return graph.select(page, node).mapInPandas(run, f"{page} {kind}, id int, parent int, property string, class string, content string")


def admitted(pages: DataFrame, reason: Column, cls: str, order: list[str], quota: int) -> DataFrame:
    """Pages with `reason` (null: admitted): the gates' first refusal, else "quota" beyond the first `quota` of the class, else none.

    Trying ends with a class's quota, so pages after its last one kept are left out altogether.
    """
    ordered = W.partitionBy(cls).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    judged = pages.withColumn("reason", reason)
    kept = F.count_if(F.col("reason").isNull()).over(ordered)
    tried = judged.withColumn("_kept", kept).where((F.col("_kept") < quota) | ((F.col("_kept") == quota) & F.col("reason").isNull()))
    return tried.drop("_kept")
