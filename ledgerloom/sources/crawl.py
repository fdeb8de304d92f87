"""What a crawler may fetch and when, and where an archive holds a page: decisions over tables of urls, robots files and index lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import surt, url_host

#: Seconds between two requests to a host, at least.
LEAST_DELAY = 1.0


@lru_cache(maxsize=1024)
def _rules(status: int | None, body: str | None) -> RobotFileParser:
    """A host's rules: its file if there is one; none if it says there is none; all forbidden if it can't or won't tell."""
    rules = RobotFileParser()
    refused = status is None or status in (0, 401, 403) or status >= 500
    rules.parse((body or "").splitlines() if status == 200 else ["User-agent: *", "Disallow: /"] if refused else [])
    return rules


def permissions(urls: DataFrame, robots: DataFrame, agent: str, delay: float = LEAST_DELAY, url: str = "url") -> DataFrame:
    """Add host, allowed and delay by the hosts' robots files (host, status, body), one of each; a host without one is out of reach.

    A longer stated delay is kept to, a shorter one isn't.
    """
    joined = urls.withColumn("host", url_host(F.col(url))).join(robots.select("host", F.col("status").alias("_status"), F.col("body").alias("_body")), "host", "left")
    schema = joined.drop("_status", "_body").schema.add("allowed", "boolean").add("delay", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rules = [_rules(None if pd.isna(s) else int(s), b) for s, b in zip(f["_status"], f["_body"], strict=True)]
            stated = [r.crawl_delay(agent) for r in rules]
            out = f.drop(columns=["_status", "_body"])
            out["allowed"] = [bool(u) and r.can_fetch(agent, u) for r, u in zip(rules, f[url], strict=True)]
            out["delay"] = [max(delay, LEAST_DELAY, float(s or 0.0)) for s in stated]
            yield out

    return joined.mapInPandas(run, schema)


def moved(responses: DataFrame, asked: str, got: str) -> DataFrame:
    """Answers that came from another host than the one that was asked: that host's rules must be read before they count."""
    return responses.where(~url_host(F.col(asked)).eqNullSafe(url_host(F.col(got))))


def captures(lines: DataFrame, urls: DataFrame, line: str = "line", url: str = "url") -> DataFrame:
    """The first successful capture of each url: file, offset, length and timestamp, out of index lines "key timestamp {json}".

    A line of another shape, of another status than 200 or outside an archive file is passed over.
    """
    parts = lines.select(F.regexp_extract(line, r"^(\S+) (\S+) (\{.*\})$", 1).alias("key"), F.regexp_extract(line, r"^(\S+) (\S+) (\{.*\})$", 2).alias("timestamp"), F.from_json(F.regexp_extract(line, r"^(\S+) (\S+) (\{.*\})$", 3), "status string, filename string, offset string, length string").alias("r"))
    good = parts.where((F.col("key") != "") & (F.col("r.status") == "200") & F.contains("r.filename", F.lit("warc")))
    wanted = urls.select(url, surt(F.col(url)).alias("key"))
    found = good.join(wanted.select("key").distinct(), "key", "left_semi")
    first = found.withColumn("_rank", F.row_number().over(W.partitionBy("key").orderBy("timestamp", "r.filename", F.col("r.offset").cast("long")))).where("_rank = 1")
    return wanted.join(first, "key").select(url, "timestamp", F.col("r.filename").alias("filename"), F.col("r.offset").cast("long").alias("offset"), F.col("r.length").cast("long").alias("length"))
