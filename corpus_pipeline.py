"""From raw documents to training ids: language ID, near-duplicates, benchmark passages, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents, as they came. An empty table stays empty through all stages.
"""

from __future__ import annotations

import itertools

import public_tokenizers
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language_id, near_dedup, piece_codec
from ledgerloom.llm.common import Scratch, table

#: A document stays if its predicted language has at least this share of the likelihood.
MIN_SCORE = 0.5
#: And this share of its trigrams known to the language, if it has so many: the likelihood's share nears 1 with length in any language.
MIN_KNOWN, JUDGED_GRAMS = 0.6, 50
#: A language is judged so if it has this many labelled texts and trigrams of them to judge by; where they themselves have fewer
#: known, the bound is FLOOR of their lowest share (but for the lowest FEW of them).
LABELLED, LABELLED_GRAMS, FLOOR, FEW, SHARES = 20, 20_000, 0.8, 0.005, 1_000
#: Shingle similarity of near-duplicates, in hundredths.
PERCENT = 80


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs under names that no operator adds, each column's new name, and the columns back under their own."""
    names = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(new).alias(old) for old, new in names.items()]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null or letterless text, or no language with MIN_SCORE of the likelihood, or a language
    that does not know MIN_KNOWN of the text's trigrams.

    The model is fitted on all of this stage's labelled rows, and the bounds are counted over all of them. If none is labelled,
    no language can be predicted and all documents with text stay.
    """
    names = docs.columns
    model = language_id.train(docs, max_docs=None)
    if not model.langs:
        return docs.where(F.col("text").isNotNull())
    model = spark.sparkContext.broadcast(model)
    bounds = known_bounds(docs, model)
    hidden, names, back = _aside(docs)
    judged = language_id.identify(hidden, model, text_col=names["text"], counted=True)
    bound = F.coalesce(F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))[F.col("lang_pred")], F.lit(0.0)) if bounds else F.lit(0.0)
    familiar = (F.col("_grams") < JUDGED_GRAMS) | (F.col("_known") >= bound * F.col("_grams"))
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE) & familiar).select(*back)


def known_bounds(docs: DataFrame, model: language_id.Model | Broadcast) -> dict[str, float]:
    """The least share of known trigrams for each language that can be judged, by all labelled rows.

    The lowest share but for FEW of a language's rows is read off their counts by share, in steps of 1 / SHARES, rounded down.
    """
    found = language_id.identify(language_id.training_rows(docs, max_docs=None), model, counted=True).where(f"lang = lang_pred and _grams >= {JUDGED_GRAMS}")
    step = F.floor(F.col("_known") * SHARES / F.col("_grams")).alias("step")
    rows = found.groupBy("lang", step).agg(F.count("*").alias("n"), F.sum("_grams").alias("grams")).collect()  # SHARES + 1 rows at most for each learned language
    bounds: dict[str, float] = {}
    for lang in {r["lang"] for r in rows}:
        steps = sorted((r["step"], r["n"], r["grams"]) for r in rows if r["lang"] == lang)
        n = sum(x[1] for x in steps)
        if n >= LABELLED and sum(x[2] for x in steps) >= LABELLED_GRAMS:
            upto = itertools.accumulate(x[1] for x in steps)
            lowest = next(x[0] for x, m in zip(steps, upto, strict=True) if m >= FEW * n)
            bounds[lang] = min(MIN_KNOWN, FLOOR * lowest / SHARES)
    return bounds


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep a row of each component of near-duplicates: the smallest doc_id, nulls last, then the smallest hash of id and text.

    Nodes are (doc_id, text) by a 64-bit hash, so different texts of one id, or without an id, are judged each; of rows that
    repeat both, one stays.
    """
    hidden, names, back = _aside(docs)
    doc_id, text = names["doc_id"], names["text"]
    keyed = hidden.withColumn("_node", F.xxhash64(F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text))
    found = near_dedup.near_duplicates(keyed, percent=PERCENT, id_col="_node", text_col=text).select(F.col("doc_id").alias("_node"), "component_id").distinct()
    ids = keyed.select("_node", F.col(doc_id).alias("_id")).distinct()
    first = found.join(ids, "_node").groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_node")).alias("first"))
    return keyed.join(first.select("first._node"), "_node", "left_semi").dropDuplicates(["_node"]).select(*back)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. Null and empty texts stay, repeated rows are judged each, and an
    empty table or benchmark drops nothing."""
    hidden, names, back = _aside(docs)
    found = decontaminate.find_contamination(hidden, table(spark, sf_dir, "benchmark"), text_col=names["text"])
    return found.where("n_hit = 0").select(*back)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (SentencePiece, of the whole text; none for null or empty text) and n_tokens. Repeated rows are encoded each; an
    empty table gives an empty table."""
    coded = piece_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language_id", languages), ("near_dedup", near_duplicates), ("decontamination", benchmark_free), ("sentencepiece", piece_ids)]

#: SQL can express neither the language model nor the tokenizer; tests hold run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each kept is written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"{k}-{name}")
    return docs
