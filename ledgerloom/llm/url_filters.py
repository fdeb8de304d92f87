"""URL filters: a trie over reversed host labels and then path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, ascii_lower, table

ALLOW, BLOCK = "allow", "block"
#: Rule text up to this size is broadcast as a trie; more goes through a shuffled join.
BROADCAST_BYTES = 16 << 20

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Rule:
    """`host` fits itself and its subdomains, `path` is a literal start of the url's path."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


@dataclass
class _Path:
    segments: dict = field(default_factory=dict)
    tails: list = field(default_factory=list)


@dataclass
class _Host:
    labels: dict = field(default_factory=dict)
    paths: _Path | None = None


class UrlTrie:
    """Longest match: most host labels, then the longest path. Of two rules with one host and path, block stands."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Host()
        for rule in sorted(rules, key=lambda r: (r.label, r.verdict != BLOCK)):
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, _Host())
            node.paths = at = node.paths or _Path()
            *whole, tail = rule.path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Path())
            if all(tail != t for t, _ in at.tails):
                at.tails.append((tail, rule))
                at.tails.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> Rule | None:
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            at, i = node.paths, 0
            best = None
            while at is not None:
                best = next((rule for tail, rule in at.tails if segments[i].startswith(tail)), best)
                if i + 1 == len(segments):
                    break
                at, i = at.segments.get(segments[i]), i + 1
            found = best or found
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


_FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def filter_urls(df: DataFrame, rules: Iterable[Rule], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """Add host, path, rule (`host` + `path` of the one that decides, else null) and verdict; no shuffle.

    Rows: every row stays, repeated ones too. A null url, or one without `://`, has empty host and path, so only a rule with
    neither would fit; it takes `default`. Ties can't arise between rules of different length on one host; equal rules: block.
    Columns of df called host, path, rule or verdict are replaced. An empty table gives an empty table.
    Rules above BROADCAST_BYTES go to `filter_urls_by_join`, with equal results.
    """
    rules = list(rules)
    if sum(len(r.host) + len(r.path) for r in rules) > BROADCAST_BYTES:
        held = df.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        return filter_urls_by_join(df, held, url_col, default)
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def make():
        trie = UrlTrie(shared.value)

        def work(urls):
            parts = [split_url(u) for u in urls]
            hits = [trie.match(*p) for p in parts]
            return [[h for h, _ in parts], [p for _, p in parts], [r.label if r else None for r in hits], [r.verdict if r else default for r in hits]]

        return work

    return append_columns(df, _FIELDS, [url_col], make)


def filter_urls_by_join(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The same for a rule table of any size (verdict, host, path): distinct host and path pairs join the rules on each host suffix.

    Pre-aggregated to distinct (host, path), so a hot page shuffles once; a hot host's rows are split by Spark's skew join.
    """
    kept = [c for c in df.columns if c not in _FIELDS.names or c == url_col]
    at = F.instr(url_col, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    rows = df.select(*kept, F.coalesce(rest, F.lit("")).alias("_rest"))
    rows = rows.withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)))
    rows = rows.withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), r"^[^?#]*", 0)).drop("_rest")
    pairs = rows.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    keys = pairs.select("host", "path", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")).alias("suffix"))
    held = rules.select(F.col("verdict").alias("_verdict"), F.col("host").alias("_label"), ascii_lower(F.col("host")).alias("suffix"), F.col("path").alias("_path"))
    order = F.struct(F.size(F.split("suffix", r"\.")), F.length("_path"), F.when(F.col("_verdict") == BLOCK, 1).otherwise(0))
    best = keys.join(held, "suffix").where(F.expr("startswith(path, _path)")).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_label", "_path").alias("rule"), F.col("_verdict").alias("verdict")), order).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = (Rule(ALLOW, "com", "/"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"), Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
ORACLE_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT k, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rhost, rpath) AS (VALUES {_VALUES}),
m AS (
  SELECT k, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY k ORDER BY len(string_split(rhost, '.')) DESC, length(rpath) DESC, verdict DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT k, rule, verdict FROM m WHERE n = 1) USING (k)
"""
