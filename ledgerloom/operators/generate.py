"""Seeded documents with their truth: the same seed gives the same bytes, whatever task or cluster makes it."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: (class, property, units, least, most) that a document can measure.
KINDS = (("Length", "length", ("meter", "centimeter", "kilometer"), 1, 900), ("Mass", "mass", ("gram", "kilogram"), 1, 500), ("Temperature", "temperature", ("kelvin", "degree_celsius"), 1, 400), ("Duration", "duration", ("second", "minute", "hour"), 1, 90))
OPENERS = ("The {kind} was {v} {u}.", "Its {kind} is {v} {u}.", "The {kind} came to {v} {u}.")
DOCUMENTS = "task_id string, seed long, document string, expected string, parents string"


def draw(seed: int, entities: int = 3) -> tuple[str, list[dict]]:
    """(document, expected entities)"""
    rng = random.Random(seed)
    lines, expected = [], []
    for i, (cls, prop, units, lo, hi) in enumerate(rng.sample(KINDS, min(entities, len(KINDS)))):
        unit, magnitude = rng.choice(units), rng.randint(lo, hi) + rng.choice((0, 0.25, 0.5))
        lines.append(rng.choice(OPENERS).format(kind=prop, v=magnitude, u=unit))
        expected.append({"key": f"x{i}", "class": cls, "fields": {"value": [{"magnitude": magnitude, "unit": unit}]}})
    return " ".join(lines), expected


def documents(spark: SparkSession, first: int, count: int, entities: int = 3) -> DataFrame:
    """One task for each seed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [draw(int(s), entities) for s in f["id"]]
            yield pd.DataFrame({"task_id": [f"t{s}" for s in f["id"]], "seed": f["id"], "document": [d for d, _ in made], "expected": [json.dumps(e, sort_keys=True) for _, e in made], "parents": [None] * len(made)})

    return spark.range(first, first + count).mapInPandas(run, DOCUMENTS)


def perfect_answer(expected: list[dict]) -> str:
    return json.dumps({"entities": [{"type": e["class"], **{p: [{"value": v["magnitude"], "unit": v["unit"]} if isinstance(v, dict) and "magnitude" in v else v for v in vs] for p, vs in e["fields"].items()}} for e in expected]})


def nested_answer(expected: list[dict]) -> str:
    """The perfect answer with each entity inside the field that refers to it first, where there is one."""
    body = {e["key"]: json.loads(perfect_answer([e]))["entities"][0] for e in expected}
    inside = set()
    for e in expected:
        for p, vs in e["fields"].items():
            for v in vs:
                if isinstance(v, dict) and v.get("key") in body and v["key"] != e["key"] and v["key"] not in inside and not _holds(body[v["key"]], body[e["key"]]):
                    body[e["key"]][p] = [body[v["key"]] if x == v else x for x in body[e["key"]][p]]
                    inside.add(v["key"])
    return json.dumps({"entities": [b for k, b in body.items() if k not in inside]})


def _holds(outer, inner) -> bool:
    held = outer.values() if isinstance(outer, dict) else outer if isinstance(outer, list) else ()
    return outer is inner or any(_holds(x, inner) for x in held)


STEPS = ("shortlist", "fillable", "fill")


def step_answer(expected: list[dict], step: str) -> str:
    """What a step of a chain would answer if it knew: classes by entity, slots by entity, or all values."""
    if step == "fill":
        return perfect_answer(expected)
    return json.dumps({e["key"]: [e["class"]] if step == "shortlist" else sorted(e["fields"]) for e in expected}, sort_keys=True)


def replayed(tasks: DataFrame) -> DataFrame:
    """(task_id, ordinal, step, answer): the known answers of every step of each task, in the order of a chain."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, i, step, step_answer(json.loads(x), step)) for t, x in zip(f["task_id"], f["expected"], strict=True) for i, step in enumerate(STEPS)]
            yield pd.DataFrame(rows, columns=["task_id", "ordinal", "step", "answer"])

    return tasks.select("task_id", "expected").mapInPandas(run, "task_id string, ordinal int, step string, answer string")


CONTROLS = ("perfect", "empty", "wrong_document", "bare_numbers")
MORE_CONTROLS = ("random", "nested")


def control_answers(tasks: DataFrame, control: str) -> DataFrame:
    """Answers that must score 1 (perfect) or about 0 (the others), out of the truth alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for seed, text in zip(f["seed"], f["expected"], strict=True):
                expected = json.loads(text)
                if control == "empty":
                    out.append('{"entities": []}')
                elif control == "wrong_document":
                    out.append(perfect_answer(draw(int(seed) + 1_000_003)[1]))
                elif control == "random":
                    rng = random.Random(f"random:{seed}")
                    out.append(json.dumps([{"type": rng.choice(KINDS)[0], "value": rng.randint(1, 999), "unit": rng.choice(rng.choice(KINDS)[2])} for _ in expected]))
                elif control == "nested":
                    out.append(nested_answer(expected))
                elif control == "bare_numbers":
                    out.append(json.dumps([{"type": e["class"], "value": e["fields"]["value"][0]["magnitude"]} for e in expected]))
                else:
                    out.append(perfect_answer(expected))
            yield pd.DataFrame({"task_id": f["task_id"], "answer": out})

    return tasks.select("task_id", "seed", "expected").mapInPandas(run, "task_id string, answer string")
