"""Corpus queries: caps, strata, copies, links, hosts, text filters and integrity gates, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, graph, joins, quality, sampling
from .registry import query, table

_BRAND_CAP = 5


@query(f"SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= {_BRAND_CAP}")
def cap_per_class(spark, d):
    return sampling.cap_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"], _BRAND_CAP)


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_REST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1))"


@query(f"SELECT {_HOST} AS host, page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {_HOST} ORDER BY url, page_id) <= 2")
def per_host_cap(spark, d):
    pages = table(spark, d, "pages").select(text.url_host(F.col("url")).alias("host"), "page_id", "url")
    return sampling.cap_per_group(pages, ["host"], ["url", "page_id"], 2)


@query(f"""WITH h AS (SELECT page_id, string_split(regexp_replace({_HOST}, '^www[0-9]*\\.', ''), '.') AS labels, {_REST} AS rest FROM pages)
SELECT page_id, array_to_string(list_reverse(labels), ',') || ')' || CASE WHEN rest = '' THEN '/' WHEN rest[1] = '?' THEN '/' || rest ELSE rest END AS surt FROM h""")
def host_surt(spark, d):
    return table(spark, d, "pages").select("page_id", text.surt(F.col("url")).alias("surt"))


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) AS seat FROM documents GROUP BY source)
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, seat FROM documents JOIN s USING (source)""")
def round_robin(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"])


_SPREAD = "SELECT {by}, {key}, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY {key})"


@query(f"""WITH r AS ({_SPREAD.format(by="o_orderstatus", key="o_orderkey", src="orders")}), k AS (SELECT DISTINCT o_orderstatus, n, least(10, n) AS k FROM r),
j AS (SELECT o_orderstatus, CASE WHEN k = 1 THEN n // 2 ELSE round_even(j * (n - 1)::DOUBLE / (k - 1), 0)::BIGINT END AS i FROM (SELECT *, unnest(generate_series(0, k - 1)) AS j FROM k))
SELECT o_orderstatus, o_orderkey FROM r JOIN j USING (o_orderstatus, i)""")
def even_spread(spark, d):
    return sampling.even_spread(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], F.lit(10))


_BUCKET = "(c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 5000)::INT + (c_acctbal >= 7500)::INT"


@query(f"""WITH c AS (SELECT c_custkey, {_BUCKET} AS stratum, c_mktsegment AS class FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
n AS (SELECT stratum, class, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT stratum, min(n) AS k FROM n GROUP BY stratum HAVING count(*) = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum, class ORDER BY c_custkey) - 1 AS i FROM c JOIN n USING (stratum, class) JOIN k USING (stratum)),
j AS (SELECT stratum, class, CASE WHEN k = 1 THEN n // 2 ELSE round_even(j * (n - 1)::DOUBLE / (k - 1), 0)::BIGINT END AS i FROM (SELECT *, unnest(generate_series(0, k - 1)) AS j FROM n JOIN k USING (stratum)))
SELECT stratum, class, c_custkey FROM r JOIN j USING (stratum, class, i)""")
def matched_strata(spark, d):
    c = table(spark, d, "customer").select(joins.bucket_of(F.col("c_acctbal"), (0, 2500, 5000, 7500)).alias("stratum"), F.col("c_mktsegment").alias("class"), "c_custkey")
    return sampling.matched_strata(c, "stratum", "class", ["BUILDING", "MACHINERY", "HOUSEHOLD"], ["c_custkey"])


_PRINT = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:8], ' ')"


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_PRINT} AS fp FROM documents) QUALIFY fp = '' OR row_number() OVER (PARTITION BY lang, fp ORDER BY doc_id) = 1")
def first_copy_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    printed = docs.select("doc_id", "lang", text.copy_fingerprint(F.col("text")).alias("fp"))
    return sampling.first_copies(printed, ["lang"], F.col("fp"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem WHERE l_partkey <> l_suppkey")
def undirected_pairs(spark, d):
    return sampling.undirected(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_resume(spark, d):
    return joins.not_done(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier)")
def semi_known(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return joins.both_known(links, "source", "target", table(spark, d, "supplier"), "s_suppkey").select("source", "target")


@query("""SELECT e.event_id, e.user_id, v.value AS as_of FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_block(spark, d):
    e = table(spark, d, "events")
    probes = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return joins.as_of(probes, e.where("event_type = 'view'"), ["user_id"], "ts", "ts", "value", "event_id").select("event_id", "user_id", "as_of")


_EDGES = (5, 8, 12, 18, 26, 40)


@query(f"SELECT {' + '.join(f'(p_size >= {e})::INT' for e in _EDGES)} AS bucket, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1")
def range_bucket(spark, d):
    return table(spark, d, "part").groupBy(joins.bucket_of(F.col("p_size"), _EDGES).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


_TREE = "SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'world' FROM region UNION SELECT 'world', 'world'"


def _tree(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return edges.unionByName(r.select(F.col("r_name").alias("child"), F.lit("world").alias("parent"))).unionByName(spark.createDataFrame([("world", "world")], "child string, parent string")).distinct()


_CLOSED = f"""e AS ({_TREE}), up(child, ancestor) AS (SELECT child, parent FROM e WHERE child <> parent UNION SELECT up.child, e.parent FROM up JOIN e ON e.child = up.ancestor WHERE e.parent <> up.child AND e.parent <> e.child)"""


@query(f"WITH RECURSIVE {_CLOSED} SELECT DISTINCT child, ancestor FROM up")
def closure(spark, d):
    return joins.closure(_tree(spark, d), "child", "parent")


@query(f"""WITH RECURSIVE {_CLOSED}, x AS (SELECT DISTINCT n_name AS a, r_name AS b FROM nation, region)
SELECT a, b, CASE WHEN a = b THEN 'exact' WHEN (a, b) IN (SELECT (child, ancestor) FROM up) THEN 'broader' WHEN (b, a) IN (SELECT (child, ancestor) FROM up) THEN 'narrower' ELSE 'none' END AS relation FROM x""")
def lineage_near(spark, d):
    pairs = joins.grid(table(spark, d, "nation").select(F.col("n_name").alias("a")), table(spark, d, "region").select(F.col("r_name").alias("b"))).drop("repetition")
    return joins.relation(pairs, "a", "b", joins.closure(_tree(spark, d), "child", "parent"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'preferred' WHEN 'N' THEN 'normal' ELSE 'deprecated' END AS rank FROM lineitem),
b AS (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY l_orderkey) AS best FROM r WHERE rank <> 'deprecated')
SELECT l_orderkey, l_linenumber, rank FROM b WHERE NOT best OR rank = 'preferred'""")
def truthy_rank(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", "preferred").when(F.col("l_returnflag") == "N", "normal").otherwise("deprecated")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rank.alias("rank"))
    return joins.preferred_only(rows, ["l_orderkey"], "rank")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_STATS = f"""s AS (SELECT doc_id, {_LINES} AS ls FROM documents), m AS (
  SELECT doc_id, len(ls)::BIGINT AS lines, len(list_filter(ls, lambda x: length(x) >= 60 AND regexp_matches(x, '[.!?]$')))::BIGINT AS sentences,
         len(list_filter(ls, lambda x: length(x) <= 60 AND (ends_with(x, ':') OR regexp_matches(x, '^[^:]{{1,40}}:\\s*\\S'))))::BIGINT AS specs,
         len(list_filter(ls, lambda x: regexp_matches(lower(x), 'cookie|privacy policy|all rights reserved|subscribe|sign in|log in|terms of use|newsletter|copyright')))::BIGINT AS boilerplate FROM s)"""


@query(f"WITH {_STATS} SELECT * FROM m")
def doc_stats(spark, d):
    return filters.document_stats(table(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH {_STATS} SELECT doc_id, sentences >= 10 AND CASE WHEN lines = 0 THEN 1.0 ELSE boilerplate::DOUBLE / lines END < 0.15
  AND CASE WHEN sentences > 0 THEN specs::DOUBLE / sentences WHEN specs > 0 THEN 'infinity'::DOUBLE ELSE 0 END < 1.5 AS usable FROM m""")
def usable_document(spark, d):
    return filters.document_stats(table(spark, d, "documents"), "doc_id", "text").select("doc_id", filters.usable().alias("usable"))


@query("SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS folded FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.fold_ascii(F.col("text")), 256).alias("folded"))


@query("SELECT DISTINCT p_name, lower(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[\\s\\-]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')) AS property FROM part")
def norm_property(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", text.property_name(F.col("p_name")).alias("property"))


@query("""WITH k AS (SELECT DISTINCT p_type || p_brand AS kind FROM part), s AS (SELECT kind, regexp_replace(regexp_replace(kind, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS spaced FROM k)
SELECT kind, array_to_string(list_transform(string_split(spaced, ' '), lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{2,}[0-9]*$') THEN w ELSE lower(w) END), ' ') AS words FROM s""")
def readable_kind(spark, d):
    kinds = table(spark, d, "part").select(F.concat("p_type", "p_brand").alias("kind")).distinct()
    return kinds.select("kind", text.readable_kind(F.col("kind")).alias("words"))


@query("SELECT item_id, count(*) FILTER (WHERE contains(d.folded, b.folded)) AS stated FROM (SELECT item_id, lower(text) AS folded FROM benchmark) b, (SELECT lower(text) AS folded FROM documents) d GROUP BY item_id")
def grounded_rate(spark, d):
    return filters.stated_counts(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "text")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS absent FROM events GROUP BY event_type")
def json_props(spark, d):
    v = table(spark, d, "events").select("event_type", F.try_parse_json("props").alias("v"))
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("v", "$.k", "long")).alias("total"), F.count_if(F.try_variant_get("v", "$.missing", "long").isNull()).alias("absent"))


@query("""WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') = count(*) FILTER (WHERE role = 'assistant') AS whole FROM conversations GROUP BY conv_id)
SELECT conv_id, i - 1 AS step, md5(u.text) AS asked, md5(a.text) AS answered FROM u JOIN a USING (conv_id, i) JOIN n USING (conv_id) WHERE whole""")
def chain_zip(spark, d):
    c = table(spark, d, "conversations")
    said = lambda role, name: c.where(F.col("role") == role).select("conv_id", "turn", F.md5("text").alias(name))
    asked, answered = said("user", "asked"), said("assistant", "answered")
    zipped = quality.zip_chain(asked, answered, "conv_id", "turn").join(quality.chain_lengths(asked, answered, "conv_id").select("conv_id"), "conv_id", "left_anti")
    return zipped.select("conv_id", (F.col("step") - 1).cast("long").alias("step"), "asked", "answered")


@query("""SELECT conv_id, role, arg_min(md5(text), turn) AS kept, count(DISTINCT text) - 1 AS conflicts FROM conversations GROUP BY conv_id, role""")
def value_fold_conflicts(spark, d):
    return sampling.first_values(table(spark, d, "conversations"), ["conv_id", "role"], "turn", "text", "kept").withColumn("kept", F.md5("kept"))


@query("SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def isolated_nodes(spark, d):
    nodes = table(spark, d, "part").select(F.lit("g").alias("graph"), F.col("p_partkey").alias("id"))
    edges = table(spark, d, "lineitem").select(F.lit("g").alias("graph"), F.col("l_partkey").alias("source"), F.col("l_partkey").alias("target"))
    return graph.isolated(nodes, edges).select(F.col("id").alias("node"))


@query("WITH p AS (SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL) SELECT lo, hi, n FROM p WHERE n > 1")
def parallel_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("lo"), F.greatest("l_partkey", "l_suppkey").alias("hi"), "l_returnflag")
    return e.groupBy("lo", "hi").agg(F.count_distinct("l_returnflag").alias("n")).where("n > 1")


@query("""WITH f AS (SELECT c_custkey, c_mktsegment AS prev, lead(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS next FROM customer) SELECT prev, next, count(*) AS n FROM f WHERE next IS NOT NULL GROUP BY ALL""")
def revision_neighbours(spark, d):
    c = joins.with_next(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"], "c_mktsegment", "next")
    return c.where("next IS NOT NULL").groupBy(F.col("c_mktsegment").alias("prev"), "next").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_brand AS unit, p_type AS kind FROM part), u AS (SELECT kind FROM s GROUP BY kind), o AS (SELECT unit, count(DISTINCT kind) AS kinds, min(kind) AS kind FROM s GROUP BY unit)
SELECT unit, kinds, CASE WHEN kinds = 1 THEN kind END AS only_kind FROM o""")
def unit_owners(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("unit"), F.col("p_type").alias("only_kind"))
    return joins.owners(part, "unit", "only_kind").select("unit", F.col("owners").alias("kinds"), "only_kind")


@query("""WITH RECURSIVE p AS (SELECT p_type, p_partkey, ['brand=' || p_brand, 'size=' || p_size::VARCHAR] AS f, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part),
w(p_type, i, p_partkey, keep, used) AS (
  SELECT DISTINCT p_type, 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[] FROM p
  UNION ALL
  SELECT p_type, i, p_partkey, ok, CASE WHEN ok THEN list_concat(used, f) ELSE used END
  FROM (SELECT p.*, w.used, len(list_filter(w.used, lambda x: x = p.f[1])) < 3 AND len(list_filter(w.used, lambda x: x = p.f[2])) < 3 AS ok FROM w JOIN p ON p.p_type = w.p_type AND p.i = w.i + 1))
SELECT p_type, p_partkey FROM w WHERE keep""")
def capped_values(spark, d):
    p = table(spark, d, "part").select("p_type", "p_partkey", F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("size="), F.col("p_size").cast("string"))).alias("facts"))
    return sampling.capped_values(p, "p_type", "p_partkey", "facts", 3).select("p_type", "p_partkey")
