"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, scanning each text once.

Normal form: A-Z lower-cased, words joined by one space. Hits are word runs; `spans` gives them as code points of the original.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, held, table

WINDOW = 10
#: Item text that one automaton holds: its nodes are at most WINDOW times as many. More text makes more automata, each scanned in turn.
BLOCK_CHARS = 400_000

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalise(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split())


def windows(text: str | None, size: int = WINDOW) -> list[tuple[str, int]]:
    """(words joined by spaces, their number): every run of `size` words, or all words of a shorter item."""
    words = [] if text is None else normalise(text).decode("utf-8", "surrogatepass").split(" ")
    if words in ([], [""]):
        return []
    n = min(size, len(words))
    return list(dict.fromkeys((" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1)))


def blocks(items: Iterable[tuple[str, str | None]], size: int, limit: int) -> Iterator[list[tuple[str, int, list[str]]]]:
    """Patterns (window, words, item ids) in blocks whose items have about `limit` characters at most."""
    held: dict[tuple[str, int], set[str]] = {}
    chars = 0
    for item, text in items:
        if held and chars + len(text or "") > limit:
            yield [(w, n, sorted(ids)) for (w, n), ids in held.items()]
            held, chars = {}, 0
        chars += len(text or "")
        for key in windows(text, size):
            held.setdefault(key, set()).add(item)
    if held:
        yield [(w, n, sorted(ids)) for (w, n), ids in held.items()]


def automaton(key: str, patterns: list[tuple[str, int, list[str]]]) -> ahocorasick.Automaton:
    """Built once in a worker and kept for its next tasks."""

    def make():
        a = ahocorasick.Automaton()
        for i, (w, n, _) in enumerate(patterns):
            a.add_word(f" {w} ", (i, len(w) + 2, n))
        a.make_automaton()
        return a

    return held(("items", key), make)


def scan(a: ahocorasick.Automaton, norm: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged runs [first, end) of hit words, and the numbers of the patterns that occur."""
    hits = list(a.iter(f" {norm} "))
    if not hits:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(f" {norm} ".encode("utf-32-le", "surrogatepass"), "<u4") == 32)
    first = np.searchsorted(spaces, [end - length + 1 for end, (_, length, _) in hits])
    return merge([(int(f), int(f) + n) for f, (_, (_, _, n)) in zip(first, hits, strict=True)]), {i for _, (i, _, _) in hits}


def merge(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs as code points of the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", _RUNS), T.StructField("spans", _RUNS)])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add n_words, n_hit, items (ids with an occurring window, as sorted strings), runs (of words) and spans (of code points).

    No shuffle: one pass over the texts for each block of the benchmark, which is one pass for usual benchmarks; between passes the
    table is written to the shared folder.
    Null and empty texts have no words and no hits; null item texts have no windows; a null item id counts as "null".
    Repeated rows are judged each; repeated items add nothing. Columns of docs with the added names are replaced.
    The benchmark's size is bounded by blocks, not assumed: the driver and each worker hold one block's items (the driver also the
    next block's) at a time.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(item_text_col)).toLocalIterator()
    none = F.array().cast("array<string>")
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "n_hit": F.lit(None).cast("long"), "items": none, "runs": F.array().cast(_RUNS), "spans": F.array().cast(_RUNS)})
    scratch, passes = Scratch(docs.sparkSession), 0
    following = blocks(((r[0], r[1]) for r in items), window, block_chars)
    patterns = next(following, [])
    while True:
        after = next(following, None)
        shared = docs.sparkSession.sparkContext.broadcast(patterns)
        out = append_columns(out, _FIELDS, [text_col, "items", "runs"], _pass(shared, patterns, after is None))
        if after is None:
            return out
        out = scratch.keep(out, f"pass-{passes}")
        shared.unpersist()
        if passes:
            scratch.drop(f"pass-{passes - 1}")
        patterns, passes = after, passes + 1


def _pass(shared, patterns: list[tuple[str, int, list[str]]], last: bool):
    key = hashlib.sha256(repr(patterns).encode("utf-8", "surrogatepass")).hexdigest()

    def make():
        known = shared.value
        a = automaton(key, known) if known else None

        def work(texts, items, runs):
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, had, before in zip(texts, items, runs, strict=True):
                norm = "" if text is None else normalise(text).decode("utf-8", "surrogatepass")
                now, numbers = scan(a, norm) if a and norm else ([], set())
                every = merge([*now, *((r["start"], r["end"]) for r in before)])
                ids = sorted({*had, *(i for n in numbers for i in known[n][2])})
                row = (norm.count(" ") + 1 if norm else 0, sum(b - s for s, b in every), ids, [{"start": s, "end": b} for s, b in every], spans_of(text, every) if last and every else [])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return list(out)

        return work

    return make


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_SPLIT} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT k, n, i, item FROM gram JOIN win USING (n, g)),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY k),
its AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN its USING (k)
"""
