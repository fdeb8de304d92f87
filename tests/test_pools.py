import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import pages, pools

def form():
    return F.when(F.col("kind").isin("number", "integer"), "number").otherwise(F.col("kind"))



def slots(spark, rows):
    return spark.createDataFrame([(c, s, k, ch, own, i) for i, (c, s, k, ch, own) in enumerate(rows)], "class string, slot string, kind string, choices array<string>, own boolean, ordinal int")


def test_legible_and_designating_slots(spark):
    rows = [("A", "t", "text", None, True), ("A", "n", "number", None, True), ("A", "i", "integer", None, True), ("A", "e1", "enum", ["x", "y"], True), ("A", "e2", "enum", ["y"], True), ("A", "e3", "enum", ["z"], True), ("A", "e4", "enum", [], True), ("A", "d", "date", None, False), ("B", "t", "text", None, True), ("B", "code", "text", None, True)]
    df = slots(spark, rows)
    assert {(r["class"], r["slot"]) for r in pools.legible(df, form()).collect()} == {("A", "t"), ("A", "e3")}
    named = pools.designating(df, F.col("slot") == "code")
    assert {(r["class"], r["slot"]) for r in named.collect()} == {("A", "t"), ("B", "t")}
    refs = spark.createDataFrame([("A", "to", "link", "B", True), ("A", "to", "link", "C", True), ("A", "in", "nested", "C", True), ("B", "in", "nested", "B", True), ("B", "x", "link", "A", False)], "class string, slot string, kind string, target string, own boolean")
    assert [tuple(r) for r in pools.resolvable(refs, named).collect()] == [("A", "to", "B")]
    assert [r["class"] for r in pools.value_objects(refs, spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "class string")).collect()] == []
    assert [r["class"] for r in pools.value_objects(refs.where("target <> 'C' OR kind = 'nested'"), spark.createDataFrame([("C",), ("D",)], "class string")).collect()] == ["C"]
    assert {r["class"]: r["own_slots"] for r in pools.describable(df, 2).collect()} == {"A": 7, "B": 2}


def test_identifying_sets_against_every_assignment(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"c{c}", f"s{s}", k, rng.sample("abcd", 2) if k == "enum" else None, True) for c in range(7) for s, k in enumerate(rng.choices(["text", "number", "date", "enum", "enum"], k=6))]
    df = slots(spark, rows)
    held = {(r["class"], r["slot"]) for r in pools.legible(df, form()).collect()}
    of = {}
    for c, s, k, ch, _ in rows:
        of.setdefault(c, []).append((s, k == "enum", k, frozenset(ch or ())))

    def matches(a, b):
        return a[1] == b[1] and (bool(a[3] & b[3]) if a[1] else a[2] == b[2])

    want = set()
    for c, own in of.items():
        for chosen in itertools.combinations([x for x in own if (c, x[0]) in held], 2):
            if not any(all(matches(x, y) for x, y in zip(chosen, order, strict=True)) for o, theirs in of.items() if o != c for order in itertools.permutations(theirs, 2)):
                want.add((c, frozenset(x[0] for x in chosen)))
    assert {(r["class"], frozenset(r["slots"])) for r in pools.identifying(df, form(), 2).collect()} == want
    monkeypatch.setattr(pools, "MAX_SLOTS", 3)
    with pytest.raises(ValueError, match="listed slots"):
        pools.identifying(df, form(), 2)


def test_fields_that_a_page_states(spark):
    node = {"@type": "Recipe", "schema:name": "Soup &amp; <b>bread</b>", "recipeIngredient": ["2 eggs", {"@type": "X", "name": "salt"}], "cookTime": "PT1H", "image": "x.png", "calories": "350", "author": {"@type": "Person", "name": "Ann"}, "rating": [None, "5"], "note": "not there", "flag": True}
    df = spark.createDataFrame([(1, json.dumps(node), "Soup & bread. 2 eggs, salt; 60 minutes. Calories: 350. Ann"), (2, None, "x"), (3, "{}", None)], "page long, node string, body string")
    got = {r["property"]: (r["values"], r["stated"]) for r in pages.stated_fields(df, ["page"], "node", "body", ("image",), ("Person",)).collect()}
    assert got == {"name": (["Soup & bread"], True), "recipeIngredient": (["2 eggs", "salt"], True), "cookTime": (["PT1H"], True), "calories": (["350"], False), "note": (["not there"], False)}


def test_trees_to_entities_and_quotas(spark):
    tree = {"@graph": [{"@type": "schema:Recipe", "author": {"@type": ["Person", "x"], "worksFor": {"@type": "Thing", "member": {"@type": "Person"}}}}, {"@type": "Other"}]}
    rows = pages.entities(spark.createDataFrame([(1, json.dumps(tree)), (2, None)], "page long, node string"), "page", "node", ("Recipe", "Person")).collect()
    assert [(r["id"], r["parent"], r["property"], r["class"]) for r in rows] == [(0, None, "@graph", "Recipe"), (1, 0, "author", "Person"), (2, 1, "member", "Person")]
    df = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(12)] + [("b", 0, False)], "c string, o int, bad boolean")
    got = {(r["c"], r["o"]): r["reason"] for r in pages.admitted(df, F.when(F.col("bad"), "bad"), "c", ["o"], 3).collect()}
    assert got == {("a", 0): "bad", ("a", 1): None, ("a", 2): None, ("a", 3): "bad", ("a", 4): None, ("b", 0): None}
