"""Answers scored through the whole path, with the parts of the driver's tables as tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate, metrics, scoring, verify
from .registry import query, table


def tasks(spark, d):
    """One task for each part: its size as a length in meters. Every 7th document says no unit, every 4th truth holds an empty text."""
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    value = F.array(F.struct(size.alias("magnitude"), F.lit("meter").alias("unit")))
    fields = F.when(key % 4 == 0, F.to_json(F.struct(value.alias("value"), F.array(F.lit("")).alias("note")))).otherwise(F.to_json(F.struct(value.alias("value"))))
    expected = F.concat(F.lit('[{"key": "x", "class": "Length", "fields": '), fields, F.lit("}]"))
    document = F.concat(F.lit("The length was "), F.col("p_size").cast("string"), F.when(key % 7 == 0, ".").otherwise(" meter."))
    return table(spark, d, "part").select(F.concat(F.lit("Q"), key.cast("string")).alias("task_id"), key.alias("seed"), document.alias("document"), expected.alias("expected"), F.lit(None).cast("string").alias("parents"))


def answers(spark, d):
    """Every 3rd answer has another number, every 5th another class, every 11th is no JSON."""
    key = F.col("p_partkey")
    said = F.to_json(F.struct(F.when(key % 5 == 0, "Mass").otherwise("Length").alias("type"), (F.col("p_size") + F.when(key % 3 == 0, 1).otherwise(0)).alias("value"), F.lit("meter").alias("unit")))
    return table(spark, d, "part").select(F.concat(F.lit("Q"), key.cast("string")).alias("task_id"), F.when(key % 11 == 0, "not json").otherwise(said).alias("answer"))


@query("""WITH p AS (SELECT p_partkey % 11 = 0 AS broken, p_partkey % 3 = 0 AS wrong, p_partkey % 4 = 0 AS more FROM part)
SELECT 'value' AS dimension, count(*) FILTER (WHERE NOT broken AND NOT wrong) AS tp, count(*) FILTER (WHERE NOT broken AND wrong) AS fp, count(*) FILTER (WHERE broken OR wrong) + count(*) FILTER (WHERE more) AS fn FROM p
UNION ALL SELECT 'parse_errors', 0, count(*) FILTER (WHERE broken), 0 FROM p""")
def scored_answers(spark, d):
    scores = scoring.score_tasks(tasks(spark, d), answers(spark, d)).where("dimension IN ('value', 'parse_errors')")
    return scores.groupBy("dimension").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@query("SELECT 'Q' || p_partkey::VARCHAR AS task_id, p_partkey % 4 <> 0 AS whole FROM part")
def round_trip_gate(spark, d):
    return verify.round_trips(tasks(spark, d)).select("task_id", "whole")


@query("""WITH p AS (SELECT p_partkey % 7 = 0 AS silent, CASE WHEN p_partkey % 7 = 0 THEN 0.0 WHEN p_partkey % 4 = 0 THEN 2.0 / 3 ELSE 1.0 END::DOUBLE AS f1 FROM part)
SELECT count(*) AS tasks, round(avg(f1), 6) AS f1, (count(*) FILTER (WHERE silent) * 1)::BIGINT AS errors FROM p""")
def parse_loss(spark, d):
    return verify.parse_loss(tasks(spark, d)).withColumn("f1", F.round("f1", 6))


@query("SELECT 'bare_numbers' AS control, 'value' AS dimension, 0::BIGINT AS tp, count(*) AS fp, count(*) + count(*) FILTER (WHERE p_partkey % 4 = 0) AS fn FROM part UNION ALL SELECT 'empty', 'value', 0, 0, count(*) + count(*) FILTER (WHERE p_partkey % 4 = 0) FROM part UNION ALL SELECT 'nested', 'value', count(*), 0, count(*) FILTER (WHERE p_partkey % 4 = 0) FROM part")
def control_scores(spark, d):
    found = verify.controls(tasks(spark, d), ("empty", "bare_numbers", "nested"))
    return found.where("dimension = 'value'").select("control", "dimension", "tp", "fp", "fn")


@query("""SELECT 'Q' || p_partkey::VARCHAR AS task_id, i AS ordinal, CASE i WHEN 0 THEN 'shortlist' WHEN 1 THEN 'fillable' ELSE 'fill' END AS step,
       CASE i WHEN 0 THEN '{"x": ["Length"]}' WHEN 1 THEN CASE WHEN p_partkey % 4 = 0 THEN '{"x": ["note", "value"]}' ELSE '{"x": ["value"]}' END
       ELSE '{"entities": [{"type": "Length", "value": [{"value": ' || p_size::DOUBLE::VARCHAR || ', "unit": "meter"}]' || CASE WHEN p_partkey % 4 = 0 THEN ', "note": [""]' ELSE '' END || '}]}' END AS answer FROM part, (SELECT unnest([0, 1, 2]) AS i)""")
def replayed_steps(spark, d):
    return generate.replayed(tasks(spark, d))


@query("""SELECT l_returnflag AS model, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS tp, count(*) FILTER (WHERE l_linenumber % 2 = 1) AS fp, count(*) FILTER (WHERE l_linenumber % 2 = 1) + count(*) FILTER (WHERE l_partkey % 4 = 0) AS fn FROM lineitem
WHERE l_orderkey % 10 = 3 AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1""")
def rescored_records(spark, d):
    """Stored answers of one record in ten (the others' notes name no task), scored again."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    said = F.to_json(F.struct(F.lit("Length").alias("type"), (F.col("p_size") + F.col("l_linenumber") % 2).alias("value"), F.lit("meter").alias("unit")))
    notes = F.when(F.col("l_orderkey") % 10 == 3, F.concat(F.lit("run qid=Q"), F.col("l_partkey").cast("string"), F.lit(" ok"))).otherwise("no task")
    records = lines.select(F.col("l_returnflag").alias("model"), notes.alias("notes"), said.alias("answer"))
    found = verify.rescored(records, tasks(spark, d), "notes", "answer").where("dimension = 'value'")
    return found.groupBy("model").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
