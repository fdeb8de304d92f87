"""Classes that a document can be built from or pointed at, by their slots, links and embeddings.

Slots are rows (class, slot, kind, choices, own, ordinal), references rows (class, slot, kind, target, own) of kind link or nested.
A vocabulary is declared: it is bounded by MAX_SLOTS, which is checked where all of it is needed at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slots of a class that a catalogue lists; slots of a whole vocabulary at most.
CATALOGUE_SLOTS, MAX_SLOTS = 20, 500_000


def listed(slots: DataFrame, most: int = CATALOGUE_SLOTS) -> DataFrame:
    """The first own slots of each class, as its catalogue entry lists them."""
    return slots.where("own").withColumn("_rank", F.row_number().over(W.partitionBy("class").orderBy("ordinal", "slot"))).where(F.col("_rank") <= most).drop("_rank")


def describable(slots: DataFrame, least: int = 0) -> DataFrame:
    """Classes with at least so many own slots."""
    return slots.groupBy("class").agg(F.count_if("own").alias("own_slots")).where(F.col("own_slots") >= least)


def legible(slots: DataFrame, form: Column) -> DataFrame:
    """Listed slots that a value alone can point at: no other of the class has their form, or, of enumerations, any of their members."""
    rows = listed(slots).withColumn("form", form)
    alone = F.count("*").over(W.partitionBy("class", "form")) == 1
    plain = rows.where("kind <> 'enum'").withColumn("_alone", alone).where("_alone").drop("_alone")
    enums = rows.where("kind = 'enum' AND size(choices) > 0")
    others = enums.select("class", F.col("slot").alias("_other"), F.col("choices").alias("_theirs"))
    shared = enums.join(others, "class").where((F.col("slot") != F.col("_other")) & F.arrays_overlap("choices", "_theirs")).select("class", "slot").distinct()
    return plain.unionByName(enums.join(shared, ["class", "slot"], "left_anti"))


def identifying(slots: DataFrame, form: Column, size: int = 3) -> DataFrame:
    """(class, slots) for each set of legible slots that no other class's listed slots can hold, one for one."""
    rows = listed(slots).withColumn("form", form).select("class", "slot", "kind", "form", "choices").limit(MAX_SLOTS + 1).collect()
    if len(rows) > MAX_SLOTS:
        raise ValueError(f"a vocabulary of over {MAX_SLOTS} listed slots")
    offers: dict[str, list[tuple]] = {}
    for r in rows:
        offers.setdefault(r["class"], []).append((r["kind"] == "enum", r["form"], frozenset(r["choices"] or ())))
    shared = slots.sparkSession.sparkContext.broadcast(offers)
    wanted = legible(slots, form).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("ordinal", "slot", "kind", "form", "choices"))).alias("slots"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for cls, held in zip(f["class"], f["slots"], strict=True):
                for chosen in itertools.combinations(list(held), size):
                    asked = [(s["kind"] == "enum", s["form"], frozenset(s["choices"] if s["choices"] is not None else ())) for s in chosen]
                    if not any(fits(asked, offer) for name, offer in shared.value.items() if name != cls):
                        out.append((cls, [s["slot"] for s in chosen]))
            yield pd.DataFrame(out, columns=["class", "slots"])

    return wanted.mapInPandas(run, "class string, slots array<string>")


def fits(asked: list[tuple], offered: list[tuple]) -> bool:
    """Whether each slot asked for finds one of its own among those offered, by augmenting paths."""
    holds = [[j for j, (e, f, c) in enumerate(offered) if e == enum and (bool(c & choices) if enum else f == form)] for enum, form, choices in asked]
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in holds[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(asked)))


def designating(slots: DataFrame, is_code: Column) -> DataFrame:
    """Listed slots whose value can name an entity to a reader: text that is no code."""
    return listed(slots).where((F.col("kind") == "text") & ~is_code)


def resolvable(references: DataFrame, named: DataFrame) -> DataFrame:
    """Own links whose target is a class that can be named: (class, slot, target)."""
    return references.where("kind = 'link' AND own").select("class", "slot", "target").distinct().join(named.select(F.col("class").alias("target")).distinct(), "target", "left_semi").select("class", "slot", "target")


def value_objects(references: DataFrame, pool: DataFrame) -> DataFrame:
    """Classes of the pool that others embed and none points at."""
    targets = lambda kind: references.where(F.col("kind") == kind).select(F.col("target").alias("class")).distinct()
    return pool.select("class").distinct().join(targets("nested"), "class", "left_semi").join(targets("link"), "class", "left_anti")
