"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses, in DataFrame functions alone.

Sections part at blank lines, paragraphs at line feeds, clauses after punctuation, so the leaves give the text back and equal
roots mean equal texts. Fingerprint: root | section{paragraph(leaf,leaf);...}/...: the root as 64 hex digits, other nodes by
their first 8, a leaf with its length in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: A run of text up to and with the punctuation that follows it; such runs cover a paragraph.
LEAF = "[^.!?,;:]+[.!?,;:]*|[.!?,;:]+"
SHORT = 8
#: Ranges of ids that rows are dealt into, for each shuffle partition.
RANGES = 2
#: Ranges at most: their bounds are on the driver and their first rows in one task.
MAX_RANGES = 2048


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add the fingerprint of a text column; null counts as empty. A column of that name is replaced."""
    leaves = f"""transform(split(coalesce(`{text}`, ''), '\\n\\n', -1), s -> transform(split(s, '\\n', -1), p ->
        transform(regexp_extract_all(p, '{LEAF}', 0), l -> struct(md5(l) AS h, length(l) AS n))))"""
    paragraphs = f"""transform(_leaves, s -> transform(s, p -> struct(sha2(array_join(p.h, ''), 256) AS h,
        array_join(transform(p, l -> concat(left(l.h, {SHORT}), '.', l.n)), ',') AS body)))"""
    sections = f"""transform(_paragraphs, s -> struct(sha2(array_join(s.h, ''), 256) AS h,
        array_join(transform(s, p -> concat(left(p.h, {SHORT}), '(', p.body, ')')), ';') AS body))"""
    whole = f"concat(sha2(array_join(_sections.h, ''), 256), '|', array_join(transform(_sections, s -> concat(left(s.h, {SHORT}), '{{', s.body, '}}')), '/'))"
    out = df.withColumn("_leaves", F.expr(leaves)).withColumn("_paragraphs", F.expr(paragraphs)).withColumn("_sections", F.expr(sections))
    return out.withColumn(to, F.expr(whole)).drop("_leaves", "_paragraphs", "_sections")


def root(fingerprint: str) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def _leaf_set(fingerprint: str) -> Column:
    return F.array_distinct(F.expr(f"regexp_extract_all(`{fingerprint}`, '[0-9a-f]{{{SHORT}}}\\\\.[0-9]+', 0)"))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda total, x: total + F.substring_index(x, ".", -1).cast("long"))


def with_likeness(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """Add the share of code points in clauses that both fingerprints have, of those that either has: 1 for equal roots."""
    out = df.withColumn("_a", _leaf_set(a)).withColumn("_b", _leaf_set(b))
    out = out.withColumn("_common", _weight(F.array_intersect("_a", "_b"))).withColumn("_all", _weight(F.col("_a")) + _weight(F.col("_b")) - F.col("_common"))
    share = F.when(root(a) == root(b), 1.0).when(F.col("_all") > 0, F.col("_common") / F.col("_all")).otherwise(0.0)
    return out.withColumn(to, share).drop("_a", "_b", "_common", "_all")


def differing_paragraphs(a: str, b: str) -> Column:
    """Numbers (section, paragraph), from 0, of a's paragraphs that b lacks: only sections that b lacks are opened."""
    theirs = f"split(substring_index(`{b}`, '|', -1), '/')"
    hers = f"flatten(transform({theirs}, s -> transform(split(regexp_extract(s, '[{{](.*)[}}]', 1), ';'), p -> left(p, {SHORT}))))"
    return F.expr(f"""flatten(transform(filter(transform(split(substring_index(`{a}`, '|', -1), '/'), (s, i) -> struct(s, i)),
        x -> NOT array_contains(transform({theirs}, t -> left(t, {SHORT})), left(x.s, {SHORT}))),
        x -> transform(filter(transform(split(regexp_extract(x.s, '[{{](.*)[}}]', 1), ';'), (p, j) -> struct(p, j)),
            y -> NOT array_contains({hers}, left(y.p, {SHORT}))), y -> struct(x.i AS section, y.j AS paragraph))))""")


def with_next(df: DataFrame, id_col: str, text_col: str, fingerprint: str, to_text: str, to_fingerprint: str) -> DataFrame:
    """Fingerprint each row, and add the next row's text and fingerprint in ascending id order; the last row's next is the first.

    Rows are dealt by id into ranges of about equal size, one shuffle of the texts; each range also gets the next range's first
    row, so that no range needs another and no sort is global. Null ids come first; rows of one id go by text.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MAX_RANGES, max(1, RANGES * n))
    keyed = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))))
    bounds = keyed.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0]
    cuts = sorted(set(bounds or []))
    held = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    ranged = keyed.withColumn("bucket", F.size(F.filter(held, lambda b: b <= F.col("k"))))
    least = ranged.groupBy("bucket").agg(F.min("k").alias("least"))  # a row for each range: at most MAX_RANGES
    first = ranged.join(F.broadcast(least.withColumnRenamed("bucket", "of")), (F.col("bucket") == F.col("of")) & (F.col("k") == F.col("least")), "left_semi")
    first = first.groupBy("bucket").agg(F.min("k").alias("k"), F.min("text").alias("text"))
    order = W.orderBy("bucket")
    before = least.select(F.col("bucket").alias("to"), F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("bucket"))
    guard = first.join(F.broadcast(before), "bucket").select(F.lit(None).cast(keyed.schema["id"].dataType).alias("id"), "text", "k", F.col("to").alias("bucket"), F.lit(1).alias("guard"))
    rows = ranged.withColumn("guard", F.lit(0)).unionByName(guard).repartition(n, "bucket")
    rows = with_fingerprint(rows, "text", fingerprint)
    window = W.partitionBy("bucket").orderBy("guard", "k", "text")
    return rows.withColumns({to_text: F.lead("text").over(window), to_fingerprint: F.lead(fingerprint).over(window)}).where("guard = 0").drop("guard", "k", "bucket")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next text.

    Edited: the last quarter (floor) of the code points gives way to as many (or all) of the next document's first ones. Null
    text: empty. A single row is its own next. Null ids come first, and rows that repeat an id go by text. Only the two named
    columns are read, so others can't clash; an empty table gives an empty result.
    """
    rows = with_next(docs, id_col, text_col, "fingerprint", "next_text", "next_fingerprint")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 4)), left(next_text, int(n_chars div 4)))"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    rows = with_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    rows = with_likeness(rows, "fingerprint", "next_fingerprint", "near_next")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_fingerprint(text: str) -> str:
    leaves = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda l: {{'h': md5(l), 'n': length(l)}})))"
    join = lambda x, sep: f"coalesce(array_to_string({x}, '{sep}'), '')"
    paragraphs = f"list_transform({leaves}, lambda s: list_transform(s, lambda p: {{'h': sha256({join('list_transform(p, lambda l: l.h)', '')}), 'body': {join(f'''list_transform(p, lambda l: left(l.h, {SHORT}) || '.' || l.n)''', ',')}}}))"
    sections = f"list_transform({paragraphs}, lambda s: {{'h': sha256({join('list_transform(s, lambda p: p.h)', '')}), 'body': {join(f'''list_transform(s, lambda p: left(p.h, {SHORT}) || '(' || p.body || ')')''', ';')}}})"
    return f"(SELECT sha256({join('list_transform(x, lambda s: s.h)', '')}) || '|' || {join(f'''list_transform(x, lambda s: left(s.h, {SHORT}) || '{{' || s.body || '}}')''', '/')} FROM (SELECT {sections} AS x))"


def _sql_likeness(a: str, b: str) -> str:
    leaves = lambda f: f"list_distinct(regexp_extract_all({f}, '[0-9a-f]{{{SHORT}}}\\.[0-9]+'))"
    weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda l: split_part(l, '.', 2)::BIGINT)), 0)"
    common = weight(f"list_intersect({leaves(a)}, {leaves(b)})")
    return f"CASE WHEN split_part({a}, '|', 1) = split_part({b}, '|', 1) THEN 1.0 ELSE coalesce({common}::DOUBLE / nullif({weight(leaves(a))} + {weight(leaves(b))} - {common}, 0), 0) END::DOUBLE"


ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS k, count(*) OVER () AS n FROM documents),
e AS (
  SELECT a.k, a.n, a.doc_id, a.text, length(a.text) AS n_chars,
         left(a.text, length(a.text) - length(a.text) // 4) || left(b.text, length(a.text) // 4) AS edited
  FROM t a JOIN t b ON b.k = a.k % a.n + 1),
f AS (SELECT *, {_sql_fingerprint("text")} AS fingerprint, {_sql_fingerprint("edited")} AS edited_fingerprint FROM e)
SELECT a.doc_id, a.n_chars::BIGINT AS n_chars, sha256(a.edited) AS edited_sha256, a.fingerprint, a.edited_fingerprint,
       {_sql_likeness("a.fingerprint", "a.edited_fingerprint")} AS near_edited, {_sql_likeness("a.fingerprint", "b.fingerprint")} AS near_next
FROM f a JOIN f b ON b.k = a.k % a.n + 1
"""
