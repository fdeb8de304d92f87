import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import grounding as G
from ledgerloom.operators import metrics
from ledgerloom.operators import statements as S


def judged(spark, test, *rows):
    df = spark.createDataFrame(rows, "v string, t string")
    return [r[0] for r in df.coalesce(1).select(test(F.col("v"), F.col("t"))).collect()]


def test_numbers_durations_and_texts_are_grounded_by_their_shape(spark):
    cases = [
        ("129.0", "now $129!", True), ("1200", "costs 1,200 now", True), ("1200", "costs 1.200 now", True), ("1200", "1 200", True), ("129", "1129", False), ("128.6", "129", False), ("2,5", "2.5 l", True), ("-3", "at -3 now", False),
        ("PT25M", "25 to 30 mins", True), ("PT380M", "6 hr 20 min", True), ("PT1H", "60 minutes", True), ("PT1H30M", "1 hour", False), ("PT90M", "1h30 or 90m", True), ("PT5M", "5 miles", False), ("P", "p", True), ("PT", "x", False),
        ("FULL_TIME", "Full-time job", True), ("Alyssa's", "alyssa’s  pie", True), ("two pounds", "two\npounds", True), ("", "x", False), (None, "x", False), ("x", None, False),
    ]
    assert judged(spark, G.grounded, *((v, t) for v, t, _ in cases)) == [x for *_, x in cases]


def test_durations_are_read_once_for_each_row(spark):
    cases = [
        ("PT1.5H", "1.5 hours", True), ("PT1.5H", "1 h, 30 min", True), ("PT1.5H", "5400 secs", True), ("PT90S", "1.5 minutes", False), ("P1DT2H", "26 hours", True), ("P1DT2H", "1 day", False), ("P1DT2H", "1 day, 2 hrs", True),
        ("PT0M", "0 min", True), ("PT0M", "0 hours", False), ("PT25M", "125 min", False), ("PT25M", "25" + "x" * 41 + "min", False), ("PT1500M", "1 d 1 h", True), ("PT25M", None, False),
    ]
    assert judged(spark, G.grounded, *((v, t) for v, t, _ in cases)) == [x for *_, x in cases]
    plan = spark.createDataFrame([("PT5M", "5 min")], "v string, t string").select(G.grounded(F.col("v"), F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("T(?:(") <= 3  # the shape's test, the parts' test, the parts; a rendering reads none of them again


def test_stated_forms_keep_word_bounds(spark):
    docs = spark.createDataFrame([("Albania and (Chinatown (1974 film)).",), ("A British–Austrian drama of August 5,  1930",), (None,), ("",)], "t string").coalesce(1)
    forms = F.array(F.lit("Al"), F.lit("Alba"), F.lit("chinatown (1974 film)"), F.lit("BRITISH"), F.lit("x"))
    assert [r[0] for r in docs.select(G.stated_form(F.col("t"), forms)).collect()] == ["chinatown (1974 film)", "BRITISH", None, None]
    dates = spark.createDataFrame([("1930-08-05",), ("1930-08",), ("1930",), ("soon",), (None,)], "d string").coalesce(1)
    found = [r[0] for r in dates.select(G.date_forms(F.col("d"))).collect()]
    assert found[0] == ["1930-08-05", "1930", "August 1930", "5 August 1930", "August 5, 1930", "August 5 1930"] and found[1] == ["1930-08", "1930", "August 1930"] and found[2] == ["1930"] and found[3:4] == [[]]
    assert docs.select(G.stated_form(F.col("t"), G.date_forms(F.lit("1930-08-05"))).alias("f")).collect()[1]["f"] == "1930"


def test_labels_that_give_a_value_away(spark):
    rows = [("calories", "350", "Calories: 350 a bowl"), ("recipeIngredient", "beef", "Recipe: beef"), ("recipeIngredient", "beef", "Ingredients: ground beef"), ("sku", "12", "sku 12"), ("calories", "351", "calories 350"), ("calories", "350", "calories" + "x" * 80 + "350"), (None, "a", "a"), ("calories", None, "a")]
    df = spark.createDataFrame(rows, "p string, v string, t string").coalesce(1)
    assert [r[0] for r in df.select(G.gives_away(F.col("p"), F.col("v"), F.col("t"))).collect()] == [True, False, True, False, False, False, False, False]


def test_main_values_and_slots(spark):
    data = lambda kind, value: json.dumps({"snaktype": "value", "datavalue": {"type": kind, "value": value}})
    rows = [
        (data("string", "x"), "text", "x"), (data("monolingualtext", {"text": "t", "language": "en"}), "text", "t"), (data("monolingualtext", {"text": "t", "language": "fr"}), "text", None), (data("wikibase-entityid", {"id": "Q1"}), "text", "L"),
        (data("time", {"time": "+1967-02-21T00:00:00Z", "precision": 11}), "date", "1967-02-21"), (data("time", {"time": "+1967-02-21T00:00:00Z", "precision": 9}), "date", "1967"), (data("time", {"time": "+1967-00-00T00:00:00Z", "precision": 7}), "date", None),
        (data("quantity", {"amount": "+12.5", "unit": "1"}), "number", "12.5"), (data("quantity", {"amount": "+12", "unit": "1"}), "integer", "12"), (data("quantity", {"amount": "+12", "unit": "http://x/Q1"}), "number", None), (data("string", "x"), "date", None),
        ('{"snaktype": "somevalue"}', "text", None), ("not json", "text", None), (None, "text", None),
    ]
    df = spark.createDataFrame(rows, "snak string, slot string, want string").coalesce(1)
    main = df.select("want", "slot", S.main_value(F.col("snak")).alias("m"))
    assert all(r["got"] == r["want"] for r in main.select("want", S.slot_value(F.col("m"), F.col("slot"), F.lit("L")).alias("got")).collect())


def test_joins_that_refuse_and_maps_that_take_the_first(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, said string")
    facts = spark.createDataFrame([(1, "a"), (2, "c")], "k long, held string")
    assert S.with_integrity(rows.where("k = 1"), facts, "k", F.col("said") == F.col("held"), "differs").count() == 1
    with pytest.raises(Exception, match="differs: 2"):
        S.with_integrity(rows, facts, "k", F.col("said") == F.col("held"), "differs").collect()
    mapping = spark.createDataFrame([("b", "second", 2), ("b", "first", 1)], "s string, t string, o int")
    assert [tuple(r) for r in S.through_mapping(rows, "said", mapping, "s", "t", "o", "slot").select("k", "slot").collect()] == [(2, "first")] * 2
    out = {r["m"]: (r["outside"], r["answers"]) for r in S.outside(spark.createDataFrame([("x", "C", "u"), ("x", "C", "v"), ("y", None, "u")], "m string, c string, u string"), spark.createDataFrame([("C", "u"), ("C", "u")], "c string, u string"), ["c", "u"], ["m"]).collect()}
    assert out == {"x": (1, 2), "y": (1, 1), "all": (2, 3)}


def test_folded_distinct_reasons_and_dimensions(spark):
    df = spark.createDataFrame([(["Ab", "aB", "c", "C", "d"],), ([],), (None,)], "v array<string>").coalesce(1)
    assert [r[0] for r in df.select(S.distinct_folded(F.col("v"), 2)).collect()] == [["Ab", "c"], [], None]
    reason = S.first_reason([("null", F.col("x") > 1), ("one", F.col("x").isNull()), ("rest", F.lit(True))])
    assert [r[0] for r in spark.createDataFrame([(None,), (2,), (0,)], "x int").coalesce(1).select(reason).collect()] == ["one", "null", "rest"]
    d = spark.createDataFrame([("a", {"value": (1.0, 1.0, 1.0), "unit": (0.0, 0.0, 0.0)}), ("a", {"value": (0.0, 0.5, 0.0)}), ("b", None)], "c string, d map<string,struct<f1:double,precision:double,recall:double>>")
    got = {(r["c"], r["dimension"]): (r["n"], r["f1"], r["precision"]) for r in metrics.tabulate_dimensions(d, ["c"], "d").collect()}
    assert got == {("a", "value"): (2, 0.5, 0.75), ("a", "unit"): (1, 0.0, 0.0)}
