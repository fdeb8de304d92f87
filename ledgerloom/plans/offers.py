"""Queries on what is offered and fetched: catalogues, known answers, names, robots files and archive indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import surt, url_host
from ..operators import catalogue, pages, pools
from ..sources import crawl
from .corpora import _HOST, _REST
from .registry import query, table


@query("""WITH p AS (SELECT p_brand AS task, list(p_partkey::VARCHAR ORDER BY p_partkey) AS offer, list(p_partkey::VARCHAR ORDER BY p_partkey) FILTER (WHERE p_size = 50) AS needed FROM part GROUP BY 1)
SELECT task, array_to_string(list_concat(coalesce(needed, []), list_filter(offer, lambda x: NOT list_contains(coalesce(needed, []), x)))[1:40], ' ') AS offered FROM p WHERE len(offer) > 40 AND coalesce(len(needed), 0) <= 40
UNION ALL SELECT task, array_to_string(offer, ' ') FROM p WHERE len(offer) <= 40""")
def trimmed_catalogue(spark, d):
    """Brands as tasks that offer their parts; a task that needs more than fits has no catalogue, so it goes before the cut."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("task"), "p_partkey", F.col("p_partkey").cast("string").alias("name"), "p_size")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["name"])
    entry = F.struct("p_partkey", "name")
    tasks = part.groupBy("task").agg(ordered(entry).alias("offer"), ordered(F.when(F.col("p_size") == 50, entry)).alias("needed"))
    tasks = tasks.where((F.size("needed") <= 40) | (F.size("offer") <= 40))
    on_offer = catalogue.offered(F.col("offer"), F.array().cast("array<string>"), F.lit(False))
    return tasks.select("task", F.array_join(catalogue.trimmed(on_offer, F.col("needed"), F.lit(40)), " ").alias("offered"))


@query("""SELECT l_orderkey AS task, 'e' || l_linenumber::VARCHAR AS entity, l_returnflag AS shortlist, CASE WHEN l_linenumber % 2 = 0 THEN 'line ' || l_linenumber::VARCHAR ELSE 'e' || l_linenumber::VARCHAR END AS mention,
       'price,tax' AS fillable, CASE WHEN l_linestatus = 'F' THEN 'price,tax,date' ELSE 'price,tax' END AS fillable_optional FROM lineitem""")
def known_answers(spark, d):
    line = F.col("l_linenumber").cast("string")
    fields = F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("tax"), F.col("l_tax"))
    optional = F.when(F.col("l_linestatus") == "F", F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("date"), F.lit(0.0)))
    mentions = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.concat(F.lit("line "), line))).otherwise(F.array().cast("array<string>"))
    entity = F.struct(F.concat(F.lit("e"), line).alias("key"), F.col("l_returnflag").alias("class"), mentions.alias("mentions"), fields.alias("fields"), optional.alias("optional"))
    tasks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.array(entity).alias("expected"))
    found = catalogue.known_answers(tasks, "task", "expected")
    return found.select("task", "entity", F.array_join("shortlist", ",").alias("shortlist"), "mention", F.array_join("fillable", ",").alias("fillable"), F.array_join("fillable_optional", ",").alias("fillable_optional"))


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_totalprice > 100000 QUALIFY r <= 500), l AS (SELECT max(o_orderkey) AS last FROM a)
SELECT (SELECT count(*) FROM a) AS kept, (SELECT sum(o_orderkey)::BIGINT FROM a) AS keys, (SELECT count(*) FROM orders, l WHERE o_orderkey < last AND NOT coalesce(o_totalprice > 100000, false)) AS rejected""")
def accepted_prefix(spark, d):
    kept, rejected = catalogue.first_accepted(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_totalprice") > 100000, 500)
    return kept.agg(F.count("*").alias("kept"), F.sum("o_orderkey").alias("keys"), F.lit(rejected).cast("long").alias("rejected"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY lower(p_name)) > 1 THEN p_name || '_' || p_partkey::VARCHAR ELSE p_name END AS name FROM part")
def disambiguated_names(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_partkey").cast("string").alias("id"))
    return names.disambiguated(part, "p_name", "id", "name").select("p_partkey", "name")


@query("SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS identifiers, 11::BIGINT AS width FROM part")
def opaque_names(spark, d):
    found = table(spark, d, "part").select("p_name").distinct().withColumn("id", names.opaque(F.col("p_name"), "Q", "ledger"))
    names.refuse_collisions(found, "p_name", "id")
    return found.agg(F.count_distinct("p_name").alias("names"), F.count_distinct("id").alias("identifiers"), F.max(F.length("id")).cast("long").alias("width"))


@query(f"""WITH u AS (SELECT page_id, url, {_HOST} AS host, {_REST} AS rest FROM pages)
SELECT page_id, host, CASE length(host) % 4 WHEN 0 THEN NOT starts_with(rest, '/en/') WHEN 1 THEN true ELSE false END AS allowed, CASE length(host) % 4 WHEN 0 THEN 7.0 ELSE 1.0 END::DOUBLE AS delay FROM u""")
def crawl_permissions(spark, d):
    """Hosts that state rules and a delay, say that they have none, can't tell and won't tell."""
    urls = table(spark, d, "pages").select("page_id", "url")
    kind = F.length("host") % 4
    status = F.when(kind == 0, 200).when(kind == 1, 404).when(kind == 2, 503).otherwise(403)
    robots = urls.select(url_host(F.col("url")).alias("host")).distinct().select("host", status.alias("status"), F.lit("User-agent: *\nCrawl-delay: 7\nDisallow: /en/").alias("body"))
    return crawl.permissions(urls, robots, "ledger").select("page_id", "host", "allowed", "delay")


_SURT = f"array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www[0-9]*\\.', ''), '.')), ',') || ')' || CASE WHEN {_REST} = '' THEN '/' WHEN {_REST}[1] = '?' THEN '/' || {_REST} ELSE {_REST} END"


@query(f"""WITH k AS (SELECT url, {_SURT} AS key, page_id FROM pages), l AS (SELECT key, page_id, i, page_id * 3 + i AS off FROM k, (SELECT unnest([0, 1, 2]) AS i)),
g AS (SELECT key, arg_min(off, (2024 - i, off)) AS off, arg_min(2024 - i, (2024 - i, off)) AS ts FROM l WHERE (page_id + i) % 3 <> 0 GROUP BY key)
SELECT url, ts::VARCHAR AS timestamp, off::BIGINT AS "offset" FROM k JOIN g USING (key)""")
def archive_captures(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    record = F.to_json(F.struct(F.when((F.col("page_id") + F.col("i")) % 3 != 0, "200").otherwise("404").alias("status"), F.lit("a.warc.gz").alias("filename"), (F.col("page_id") * 3 + F.col("i")).cast("string").alias("offset"), F.lit("10").alias("length")))
    lines = urls.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(F.concat_ws(" ", surt(F.col("url")), (2024 - F.col("i")).cast("string"), record).alias("line"))
    return crawl.captures(lines, urls).select("url", "timestamp", "offset")


def _slots(spark, d):
    """Parts as slots: types are classes, brands slots; a third of them are enumerations of sizes."""
    kind = F.element_at(F.array(*map(F.lit, ("text", "number", "enum", "date", "text"))), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 5 + 1))
    rows = table(spark, d, "part").groupBy(F.col("p_type").alias("class"), F.col("p_brand").alias("slot"), kind.alias("kind")).agg(F.min("p_partkey").alias("ordinal"), F.array_sort(F.collect_set(F.when(F.col("p_size") % 10 == 0, F.col("p_size").cast("string")))).alias("choices"))
    return rows.withColumn("own", F.col("ordinal") % 2 == 0).withColumn("choices", F.when(F.col("kind") == "enum", F.col("choices")))


_SLOTS = """s AS (SELECT p_type AS class, p_brand AS slot, (['text', 'number', 'enum', 'date', 'text'])[CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 5 + 1] AS kind, min(p_partkey) AS ordinal, list(DISTINCT p_size::VARCHAR) FILTER (WHERE p_size % 10 = 0) AS choices FROM part GROUP BY 1, 2, 3),
l AS (SELECT * FROM s WHERE ordinal % 2 = 0 QUALIFY row_number() OVER (PARTITION BY class ORDER BY ordinal, slot) <= 20)"""


@query(f"""WITH {_SLOTS}, e AS (SELECT class, slot, coalesce(choices, []) AS c FROM l WHERE kind = 'enum')
SELECT class, slot FROM l a WHERE kind <> 'enum' AND (SELECT count(*) FROM l b WHERE b.class = a.class AND b.kind = a.kind) = 1
UNION ALL SELECT class, slot FROM e a WHERE len(c) > 0 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.class = a.class AND b.slot <> a.slot AND len(list_intersect(a.c, b.c)) > 0)""")
def legible_slots(spark, d):
    return pools.legible(_slots(spark, d), F.col("kind")).select("class", "slot")


@query(f"WITH {_SLOTS} SELECT class, count(*) FILTER (WHERE ordinal % 2 = 0) AS own_slots FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE ordinal % 2 = 0) >= 8")
def describable_classes(spark, d):
    return pools.describable(_slots(spark, d), 8)


@query("""WITH r AS (SELECT n_name AS class, r_name AS target, n_nationkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT DISTINCT target AS class FROM r WHERE k % 2 = 0 AND target NOT IN (SELECT target FROM r WHERE k IN (1, 3))""")
def value_objects(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "nested").when(F.col("n_nationkey").isin(1, 3), "link").otherwise("neither")
    return pools.value_objects(both.select(F.col("n_name").alias("class"), kind.alias("kind"), F.col("r_name").alias("target")), region.select(F.col("r_name").alias("class")))


_NUMBERED = "regexp_matches(text, '(^|[^0-9])' || (doc_id % 40)::VARCHAR || '([^0-9]|$)')"


@query(rf"""SELECT doc_id, 'sku' AS property, {_NUMBERED} AS stated FROM documents UNION ALL SELECT doc_id, 'pair', contains(lower(translate(regexp_replace(text, '\s+', '', 'g'), '-_', '')), 'theof') AND {_NUMBERED} FROM documents""")
def page_fields(spark, d):
    """Markup made for each document: a number, a list of a number and a phrase, and keys that don't count."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).cast("string").alias("n"))
    node = F.concat(F.lit('{"@type": "Thing", "schema:sku": "'), F.col("n"), F.lit('", "https://schema.org/pair": [{"@type": "X", "name": "the of"}, '), F.col("n"), F.lit('], "image": "a.png", "flag": true, "empty": [null]}'))
    rows = docs.select("doc_id", node.alias("node"), "text")
    return pages.stated_fields(rows, ["doc_id"], "node", "text", ("image",)).select("doc_id", "property", "stated")


@query("""WITH j AS (SELECT doc_id, lang, CASE WHEN n_chars < 120 THEN 'short' WHEN source = 'src3' THEN 'source' END AS reason FROM documents), k AS (SELECT *, count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM j)
SELECT doc_id, lang, reason FROM k WHERE kept < 60 OR kept = 60 AND reason IS NULL""")
def admitted_pages(spark, d):
    reason = F.when(F.col("n_chars") < 120, "short").when(F.col("source") == "src3", "source")
    return pages.admitted(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), reason, "lang", ["doc_id"], 60).select("doc_id", "lang", "reason")
