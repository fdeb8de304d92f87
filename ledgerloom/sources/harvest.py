"""Readers for raw harvests: quads, SQL dumps, tab-separated pairs, cluster indexes, archive members and wikitext."""

from __future__ import annotations

import gzip
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import url_host


def quad_graphs(lines: DataFrame, line: str = "value") -> DataFrame:
    """The graph name of each N-Quads line; lines without one (cut ones too) are left out."""
    found = lines.select(F.regexp_extract(line, r"<([^<>\s]*)>\s*\.\s*$", 1).alias("url"))
    return found.where("url <> ''")


def read_quads(spark: SparkSession, path: str, per_host: int, order: str | None = None) -> DataFrame:
    """At most per_host distinct graph urls of each host, the first by url (or by `order`). A truncated gzip file gives what it has."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(path)
    urls = quad_graphs(lines).distinct().withColumn("host", url_host(F.col("url")))
    rank = F.row_number().over(W.partitionBy("host").orderBy(order or "url"))
    return urls.withColumn("_rank", rank).where(F.col("_rank") <= per_host).drop("_rank")


def dump_redirects(lines: DataFrame, line: str = "value") -> DataFrame:
    """(page, target) of a SQL dump's redirect rows in namespace 0 whose target is an item."""
    rows = lines.where(F.startswith(line, F.lit("INSERT INTO"))).select(F.explode(F.regexp_extract_all(line, F.lit(r"\((\d+,\d+,'(?:[^'\\]|\\.)*'[^)]*)\)"), F.lit(1))).alias("row"))
    parts = rows.select(F.regexp_extract("row", r"^(\d+),(\d+),'((?:[^'\\]|\\.)*)'", 1).cast("long").alias("page"), F.regexp_extract("row", r"^(\d+),(\d+),'", 2).alias("namespace"), F.regexp_extract("row", r"^\d+,\d+,'((?:[^'\\]|\\.)*)'", 1).alias("target"))
    return parts.where(F.col("target").rlike("^Q[0-9]+$") & (F.col("namespace") == "0")).select("page", "target")


def tab_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    return spark.read.schema(f"{names[0]} string, {names[1]} string").option("sep", "\t").csv(path)


def cluster_index(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an archive's cluster index: first key, file, offset and length."""
    rows = spark.read.schema("key string, file string, offset long, length long, number long").option("sep", "\t").csv(path)
    return rows.select(F.substring_index("key", " ", 1).alias("key"), F.substring_index("key", " ", -1).alias("timestamp"), "file", "offset", "length")


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def member_page(member: bytes | None, indexed: str | None = None) -> tuple[str, str] | None:
    """(charset, html) of a gzipped archive member: two header blocks, then the page.

    The charset is the first that decodes of: the response header's, the page's own, the index's, utf-8, cp1252; else utf-8
    with replacement characters. None if the member can't be read.
    """
    if member is None:
        return None
    try:
        raw = gzip.decompress(member) if member[:2] == b"\x1f\x8b" else member
    except (OSError, EOFError):
        return None
    _, _, response = raw.partition(b"\r\n\r\n")
    head, _, body = response.partition(b"\r\n\r\n")
    named = [m[1].decode("ascii", "ignore") for m in (_CHARSET.search(head), _CHARSET.search(body[:2048])) if m]
    for charset in [*named, *([indexed] if indexed else []), "utf-8", "cp1252"]:
        try:
            return charset.lower(), body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return "utf-8", body.decode("utf-8", "replace")


def member_pages(members: DataFrame, content: str = "content", indexed: str | None = None) -> DataFrame:
    """Add charset and html to rows with a binary member; null where it can't be read."""
    schema = f"{members.schema.simpleString()[7:-1]},charset:string,html:string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [member_page(None if c is None else bytes(c), i) or (None, None) for c, i in zip(f[content], f[indexed] if indexed else [None] * len(f), strict=True)]
            yield f.assign(charset=[c for c, _ in found], html=[h for _, h in found])

    return members.mapInPandas(run, "struct<" + schema + ">")


#: Namespaces whose links are no articles.
NAMESPACES = ("file", "image", "category", "wikipedia", "help", "template", "portal", "special", "talk", "user", "wikt", "s", "commons")


def wikitext_links(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, target, anchor) of a page's internal links; the anchor of a bare link is its target."""
    inner = df.select(*key, F.explode(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("link"))
    target = F.trim(F.substring_index(F.substring_index("link", "|", 1), "#", 1))
    found = inner.select(*key, target.alias("target"), F.trim(F.substring_index("link", "|", -1)).alias("anchor"))
    return found.where((F.col("target") != "") & ~F.lower(F.substring_index("target", ":", 1)).isin(*NAMESPACES) | ~F.contains("target", F.lit(":")) & (F.col("target") != ""))


def detagged(c: Column) -> Column:
    """Text of a value that may be escaped markup: unescaped up to three times, tags dropped, white space collapsed."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            for _ in range(3):
                y = html.unescape(x)
                if y == x:
                    break
                x = y
            return " ".join(re.sub(r"<[^>]*>", " ", x).split())

        return s.map(one)

    return run(c)


#: Answers of a server that are worth another try.
RETRIED = (429, 500, 502, 503, 504)


def retry_delays(responses: DataFrame, host: str, order: str, status: str, attempt: str, delay: str, retry_after: str) -> DataFrame:
    """When each request of a host may go: its own wait (retry-after, or delay doubled for each attempt) after those before it."""
    wait = F.when(F.col(status).isin(*RETRIED), F.coalesce(F.col(retry_after), F.col(delay) * F.pow(F.lit(2.0), F.col(attempt)))).otherwise(F.col(delay))
    before = W.partitionBy(host).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return responses.withColumn("wait", F.greatest(wait, F.lit(1.0))).withColumn("starts", F.coalesce(F.sum("wait").over(before), F.lit(0.0)))
