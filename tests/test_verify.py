import json

from pyspark.sql import functions as F

from ledgerloom.operators import generate, verify


def test_controls_replays_and_violations(spark):
    tasks = generate.documents(spark, 5, 20)
    found = verify.controls(tasks, generate.CONTROLS + generate.MORE_CONTROLS).cache()
    assert verify.violations(found, {"wrong_document": 0.05, "random": 0.05}).count() == 0
    assert {r["control"] for r in verify.violations(found.withColumn("f1", F.when(F.col("control") == "perfect", 0.9).otherwise(0.3)), {"random": 0.3}).collect()} == {"perfect", "nested", "empty", "wrong_document", "bare_numbers"}
    assert verify.round_trips(tasks).where("NOT whole").count() == 0 and verify.parse_loss(tasks).first()["errors"] == 0
    steps = generate.replayed(tasks.limit(1)).collect()
    assert [(r["ordinal"], r["step"]) for r in steps] == [(0, "shortlist"), (1, "fillable"), (2, "fill")] and verify.round_trips(tasks.limit(0)).count() == 0


def test_nested_answers_hold_what_is_referred_to():
    expected = [{"key": "a", "class": "P", "fields": {"knows": [{"key": "b"}], "name": ["A"]}}, {"key": "b", "class": "P", "fields": {"knows": [{"key": "a"}], "name": ["B"]}}, {"key": "c", "class": "P", "fields": {"knows": [{"key": "b"}]}}]
    answer = json.loads(generate.nested_answer(expected))["entities"]
    assert [e.get("name") for e in answer] == [["A"], None] and answer[0]["knows"][0]["name"] == ["B"]


def test_rescored_records_skip_what_is_gone(spark):
    tasks = spark.createDataFrame([("Q1", 1, "d", json.dumps([{"key": "x", "class": "C", "fields": {"p": ["some text"]}}]), None)], "task_id string, seed long, document string, expected string, parents string")
    records = spark.createDataFrame([("m", "qid=Q1", '{"type": "C", "p": "some text"}'), ("m", "qid=Q1", None), ("n", "qid=Q9", "{}"), ("n", None, "{}")], "model string, notes string, answer string")
    rows = verify.rescored(records, tasks, "notes", "answer").where("dimension = 'value'").collect()
    assert sorted((r["model"], r["tp"], r["fn"]) for r in rows) == [("m", 0, 1), ("m", 1, 0)]
