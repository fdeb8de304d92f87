"""Archives and marked texts in; manifests, summaries and YAML out."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zip_members(files: DataFrame, key: str, wanted: tuple[str, ...], content: str = "content") -> DataFrame:
    """(key, member, text) of the wanted members of zip files; a file that is none, or lacks a member, gives no row for it."""
    kind = files.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, data in zip(f[key], f[content], strict=True):
                if data is None or not zipfile.is_zipfile(io.BytesIO(data)):
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(k, name, z.read(name).decode("utf-8", "replace")) for name in wanted if name in z.namelist()]
            yield pd.DataFrame(rows, columns=[key, "member", "text"])

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, member string, text string")


def unmarked(text: str, marks: tuple[str, ...]) -> tuple[str, list[tuple[str, int, int]]]:
    """(the text without its marks, (mark, start, end) of what stood between each pair); the longest mark at a place counts."""
    pieces = re.split("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")", text)  # every second one is a mark
    places = list(itertools.accumulate(map(len, pieces[::2])))
    spans, opened = [], {}
    for mark, place in zip(pieces[1::2], places, strict=False):
        if (start := opened.pop(mark, None)) is None:
            opened[mark] = place
        else:
            spans.append((mark, start, place))
    return "".join(pieces[::2]), spans


def annotated(df: DataFrame, key: str, text: str, marks: tuple[str, ...]) -> DataFrame:
    """(key, plain, spans) of marked texts; null text: null, no spans."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(None, []) if t is None else unmarked(t, marks) for t in f[text]]
            yield pd.DataFrame({key: f[key], "plain": [p for p, _ in found], "spans": [[{"mark": m, "start": a, "end": b} for m, a, b in s] for _, s in found]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, plain string, spans array<struct<mark: string, start: int, end: int>>")


def write_manifest(rows: DataFrame, key: str, content: str, path: str) -> None:
    """Rows as parquet, with each content's hash and size, so that a copy can be held against it."""
    rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).alias("bytes"), content).write.mode("overwrite").parquet(path)


def refilled(spark: SparkSession, manifest: str, fetched: DataFrame, key: str, content: str) -> DataFrame:
    """Fetched contents that the manifest names, and whether each is what it was."""
    known = spark.read.parquet(manifest).select(key, F.col("sha256").alias("_sha"))
    return fetched.join(known, key).withColumn("same", F.sha2(F.col(content).cast("binary"), 256) == F.col("_sha")).drop("_sha")


def yaml_lines(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One YAML document for each row: quoted scalars and lists of them, in the fields' order; null fields are left out."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = []
    for name in fields:
        if rows.schema[name].dataType.typeName() == "array":
            lines.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}:"), F.array_join(F.transform(name, lambda x: F.concat(F.lit("\n- "), quoted(x))), ""))))
        else:
            lines.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), quoted(F.col(name)))))
    return rows.select(key, F.concat_ws("\n", F.lit("---"), *lines).alias("yaml"))
