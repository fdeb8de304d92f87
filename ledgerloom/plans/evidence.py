"""Evidence queries: what texts state, statements and their mappings, and reports by dimension, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, grounding, joins, metrics, statements
from .registry import query, table
from .reports import RUNS, rounded, runs


@query("""SELECT doc_id, regexp_matches(text, '(^|[^0-9])' || (doc_id % 40)::VARCHAR || '([^0-9]|$)') OR doc_id % 40 >= 0 AND regexp_matches(text, '(^|[^0-9])' || (doc_id % 40)::VARCHAR || '[.]0([^0-9]|$)') AS stated
FROM documents""")
def number_stated(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", grounding.number_stated((F.col("doc_id") % 40).cast("string"), F.col("text")).alias("stated"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS stated FROM events WHERE {_K} > 0""")
def duration_stated(spark, d):
    """Durations against how a page might write them: in minutes, carried into hours, another number, or not at all."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").where(k > 0).select("event_id", k.alias("k"))
    kind = F.col("event_id") % 4
    minutes = F.col("k").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("Bake for "), minutes, F.lit(" to 900 mins."))).when(kind == 1, F.concat(F.lit("Ready in "), F.floor(F.col("k") / 60).cast("string"), F.lit(" hr "), (F.col("k") % 60).cast("string"), F.lit("minutes"))).when(kind == 2, F.concat(F.lit("About "), (F.col("k") + 1).cast("string"), F.lit("7 min"))).otherwise("It takes a while")
    pairs = e.select("event_id", F.concat(F.lit("PT"), minutes, F.lit("M")).alias("value"), text.alias("text"))
    return pairs.select("event_id", grounding.grounded(F.col("value"), F.col("text")).alias("stated"))


_FORMS = ("der", "les", "para", "the")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), '(^|[^0-9a-z]){f}([^0-9a-z]|$)') THEN '{f.upper()}'" for f in _FORMS) + " END AS form FROM documents")
def stated_form(spark, d):
    forms = F.array(*(F.lit(f.upper()) for f in _FORMS))
    return table(spark, d, "documents").select("doc_id", grounding.stated_form(F.col("text"), forms).alias("form"))


_SQUEEZED = "lower(translate(regexp_replace({0}, '\\s+', '', 'g'), '-_', ''))"


@query(f"""WITH s AS (SELECT doc_id, {_SQUEEZED.format("text")} AS sq, {_SQUEEZED.format("substr(text, 90, 24)")} AS v FROM documents), p AS (SELECT *, instr(sq, v) AS place FROM s)
SELECT doc_id, coalesce(v <> '' AND place > 0 AND contains(substr(sq, greatest(place - 70, 1), least(place - 1, 70)), 'tion'), false) AS leaks FROM p""")
def slot_leakage(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", grounding.gives_away(F.lit("fooTion"), F.substring("text", 90, 24), F.col("text")).alias("leaks"))


@query("""SELECT CASE WHEN grouping(lang) + grouping(source) = 2 THEN 'all' WHEN grouping(source) = 1 THEN 'class' ELSE 'property' END AS level, CASE WHEN grouping(lang) = 0 THEN lang ELSE source END AS name,
       count(*) AS seen, count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])7([^0-9]|$)') OR regexp_matches(text, '(^|[^0-9])7[.]0([^0-9]|$)')) AS stated,
       round(count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])7([^0-9]|$)') OR regexp_matches(text, '(^|[^0-9])7[.]0([^0-9]|$)'))::DOUBLE / count(*), 4) AS rate
FROM documents GROUP BY GROUPING SETS ((), (lang), (source))""")
def grounding_rates(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", grounding.grounded(F.lit("7"), F.col("text")).alias("fits"))
    return grounding.rates(docs, F.col("fits"), "lang", "source")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN left(strftime(ts, '%Y-%m-%d'), CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 END)
       WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN (event_id % 50)::VARCHAR END WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'words ' || event_id::VARCHAR END ELSE 'label of Q' || event_id::VARCHAR END AS value FROM events""")
def flattened_values(spark, d):
    """Statements in their JSON, one kind for each event type, as a slot of the fitting kind holds them."""
    e, i = table(spark, d, "events"), F.col("event_id")
    data = lambda kind, value: F.to_json(F.struct(F.lit("value").alias("snaktype"), F.struct(F.lit(kind).alias("type"), value.alias("value")).alias("datavalue")))
    time = data("time", F.struct(F.concat(F.lit("+"), F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("time"), F.element_at(F.array(*map(F.lit, (9, 10, 11, 7))), (i % 4 + 1).cast("int")).alias("precision")))
    amount = data("quantity", F.struct(F.concat(F.lit("+"), (i % 50).cast("string")).alias("amount"), F.when(i % 2 == 0, "1").otherwise("http://example.org/Q11573").alias("unit")))
    words = data("monolingualtext", F.struct(F.concat(F.lit("words "), i.cast("string")).alias("text"), F.when(i % 2 == 0, "en").otherwise("de").alias("language")))
    item = data("wikibase-entityid", F.struct(F.concat(F.lit("Q"), i.cast("string")).alias("id")))
    kind = F.col("event_type")
    snak = F.when(kind == "error", '{"snaktype": "somevalue"}').when(kind == "click", time).when(kind == "view", amount).when(kind == "signup", words).otherwise(item)
    slot = F.when(kind == "click", "date").when(kind == "view", "integer").otherwise("text")
    main = e.select("event_id", slot.alias("slot"), statements.main_value(snak).alias("main"))
    return main.select("event_id", statements.slot_value(F.col("main"), F.col("slot"), F.concat(F.lit("label of "), F.col("main")["value"])).alias("value"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'preferred' WHEN 'N' THEN 'normal' ELSE 'deprecated' END AS rank, l_linestatus = 'F' AND l_linenumber % 2 = 0 AS timed FROM lineitem),
b AS (SELECT *, bool_or(rank = 'preferred') OVER (PARTITION BY l_orderkey) AS best FROM r WHERE rank <> 'deprecated' AND NOT timed) SELECT l_orderkey, l_linenumber, rank FROM b WHERE NOT best OR rank = 'preferred'""")
def holding_statements(spark, d):
    rank = F.when(F.col("l_returnflag") == "R", "preferred").when(F.col("l_returnflag") == "N", "normal").otherwise("deprecated")
    timed = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0), F.array(F.lit("P1"), F.lit("P585"))).when(F.col("l_linenumber") % 3 == 0, F.array(F.lit("P1")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rank.alias("rank"), timed.alias("qualifiers"))
    return statements.holding(rows, ["l_orderkey"], "rank", "qualifiers").drop("qualifiers")


@query("WITH m AS (SELECT n_regionkey AS source, arg_min(n_name, n_nationkey) AS target FROM nation GROUP BY 1) SELECT c_custkey, m.target AS slot FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN m ON m.source = n_regionkey")
def mapped_slots(spark, d):
    nation = table(spark, d, "nation")
    regions = statements.through_mapping(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation, "n_nationkey", "n_regionkey", "n_name", "region")
    return statements.through_mapping(regions, "region", nation, "n_regionkey", "n_name", "n_nationkey", "slot").select("c_custkey", "slot")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def integrity_join(spark, d):
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("fact"), "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return statements.with_integrity(lines, facts, "l_orderkey", F.col("fact") == F.col("l_orderkey"), "another order").select("l_orderkey", "l_linenumber", "o_custkey")


@query("""WITH a AS (SELECT DISTINCT p_type AS class, p_brand AS unit FROM part WHERE p_size <= 2),
j AS (SELECT l_returnflag AS model, l_linestatus AS arm, a.unit IS NULL AS bad FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN a ON a.class = p_type AND a.unit = p_brand)
SELECT coalesce(model, 'all') AS model, coalesce(arm, 'all') AS arm, count(*) FILTER (WHERE bad) AS outside, count(*) AS answers, round(count(*) FILTER (WHERE bad)::DOUBLE / count(*), 6) AS rate FROM j GROUP BY ROLLUP (model, arm)""")
def unit_membership(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("class"), F.col("p_brand").alias("unit"), "p_size")
    answers = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("arm")).join(part, "p_partkey")
    return rounded(statements.outside(answers, part.where("p_size <= 2"), ["class", "unit"], ["model", "arm"]), "rate")


@query("""WITH p AS (SELECT DISTINCT l_returnflag AS class, l_orderkey AS instance, l_partkey % 60 AS property FROM lineitem), n AS (SELECT class, count(DISTINCT instance) AS sampled FROM p GROUP BY class),
c AS (SELECT class, property, count(*) AS stated, any_value(sampled) AS sampled FROM p JOIN n USING (class) GROUP BY class, property)
SELECT class, property, stated, sampled FROM c WHERE stated >= greatest(1, ceil(0.03 * sampled)) QUALIFY row_number() OVER (PARTITION BY class ORDER BY stated DESC, property) <= 20""")
def used_properties(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_orderkey").alias("instance"), (F.col("l_partkey") % 60).alias("property"))
    return statements.used_properties(seen, "class", "instance", "property", 0.03, 20).select("class", "property", "stated", "sampled")


@query("SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS members FROM part GROUP BY p_brand")
def distinct_sets(spark, d):
    return statements.distinct_sets(table(spark, d, "part"), "p_brand", "p_type").select("p_brand", F.array_join("members", "|").alias("members"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), l AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM w)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: list_position(l, l[i]) = i)[1:8], lambda i: w[i]), ' ') AS said FROM l""")
def distinct_folded(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(statements.distinct_folded(F.split("text", " "), 8), " ").alias("said"))


@query("""SELECT conv_id AS answer, 'e' || (turn % 2)::VARCHAR AS entity, arg_max(role || '-' || turn::VARCHAR, turn) AS class, count(DISTINCT role) AS triples, (SELECT sum(turn % 3)::BIGINT FROM conversations i WHERE i.conv_id = c.conv_id) AS errors
FROM conversations c GROUP BY 1, 2""")
def merged_steps(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("answer"), "turn", "role", F.concat(F.lit("e"), (F.col("turn") % 2).cast("string")).alias("entity"))
    triples = c.select("answer", "entity", F.lit("said by").alias("property"), F.col("role").alias("value"))
    classes = c.select("answer", "entity", "turn", F.concat_ws("-", "role", F.col("turn").cast("string")).alias("class"))
    once, last, errors = statements.merged(triples, classes, c.select("answer", (F.col("turn") % 3).alias("errors")), ["answer"], "turn")
    return last.join(once.groupBy("answer", "entity").agg(F.count("*").alias("triples")), ["answer", "entity"]).join(errors, "answer")


@query("""WITH p AS (SELECT l_returnflag AS class, a.p_size AS sa, b.p_size AS sb, a.p_brand = b.p_brand AS eq FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey),
m AS (SELECT class, median(s) AS size FROM (SELECT class, sa AS s FROM p UNION ALL SELECT class, sb FROM p) GROUP BY class)
SELECT class, size, count(*) AS pairs, round(avg(eq::INT::DOUBLE), 3) AS equal FROM p JOIN m USING (class) GROUP BY ALL""")
def state_shape(spark, d):
    part = lambda key, side: table(spark, d, "part").select(F.col("p_partkey").alias(key), F.col("p_size").alias(f"size_{side}"), F.col("p_brand").alias(f"brand_{side}"))
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), "l_partkey", "l_suppkey").join(part("l_partkey", "a"), "l_partkey").join(part("l_suppkey", "b"), "l_suppkey")
    return statements.state_shape(pairs, ["class"], {"size": "size_a"}, {"size": "size_b"}, F.col("brand_a") == F.col("brand_b"))


@query("""WITH c AS (SELECT l_returnflag AS model, (l_quantity::BIGINT % 5) AS tp, l_linenumber::BIGINT % 3 AS fp, l_suppkey % 4 AS fn FROM lineitem), r AS (SELECT coalesce(model, 'all') AS model, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (model))
SELECT *, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support FROM r""")
def rescored_totals(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_quantity").cast("long") % 5).alias("tp"), (F.col("l_linenumber").cast("long") % 3).alias("fp"), (F.col("l_suppkey") % 4).alias("fn"))
    return rounded(statements.rescored(cells, "model"), "precision", "recall", "f1")


@query("""SELECT CASE WHEN length(p_name) > 18 THEN 'too long' WHEN p_size > 40 THEN 'too large' WHEN p_retailprice < 1000 THEN 'too cheap' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1""")
def reject_reasons(spark, d):
    reason = statements.first_reason([("too long", F.length("p_name") > 18), ("too large", F.col("p_size") > 40), ("too cheap", F.col("p_retailprice") < 1000)])
    return table(spark, d, "part").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 50)")
def enough_documents(spark, d):
    return statements.enough(table(spark, d, "documents").select("doc_id", "source"), "source", 50)


_DIMS = "event_id % 5 AS tp1, event_id % 3 AS fp1, event_id % 2 AS fn1, event_id % 7 AS tp2, event_id % 4 AS fp2, event_id % 6 AS fn2"
_RATIOS = "avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1, avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)) AS precision, avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)) AS recall"


@query(f"""WITH {RUNS}, e AS (SELECT condition, model, {_DIMS}, event_id FROM runs), u AS (SELECT condition, model, 'value' AS dimension, tp1 AS tp, fp1 AS fp, fn1 AS fn FROM e UNION ALL SELECT condition, model, 'unit', tp2, fp2, fn2 FROM e WHERE event_id % 2 = 0),
r AS (SELECT condition, model, dimension, count(*) AS n, {_RATIOS} FROM u GROUP BY ALL) SELECT condition, model, dimension, n, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM r""")
def report_dimensions(spark, d):
    i = F.col("event_id")

    def scores(tp, fp, fn):
        return F.struct(metrics.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), metrics.ratio(tp, tp + fp).alias("precision"), metrics.ratio(tp, tp + fn).alias("recall"))

    value, unit = scores(i % 5, i % 3, i % 2), scores(i % 7, i % 4, i % 6)
    records = runs(spark, d).withColumn("dimensions", F.when(i % 2 == 0, F.create_map(F.lit("value"), value, F.lit("unit"), unit)).otherwise(F.create_map(F.lit("value"), value)))
    return rounded(metrics.tabulate_dimensions(records, ["condition", "model"], "dimensions"), "f1", "precision", "recall")


@query(f"""WITH {RUNS} SELECT condition, count(score) AS n, count(*) FILTER (WHERE score IS NULL) AS failures, round(coalesce(avg(score), 0), 4) AS f1, round_even(avg(tokens) FILTER (WHERE score IS NOT NULL), 0)::BIGINT AS prompt_tokens,
       round_even(avg(chars) FILTER (WHERE score IS NOT NULL), 0)::BIGINT AS cached_tokens, round_even(avg(tokens) FILTER (WHERE score IS NOT NULL), 0)::BIGINT - round_even(avg(chars) FILTER (WHERE score IS NOT NULL), 0)::BIGINT AS net_prompt_tokens FROM runs GROUP BY condition""")
def cell_summary(spark, d):
    return metrics.cell_summary(runs(spark, d), ["condition"], "score", "tokens", "chars")


@query(f"""WITH {RUNS} SELECT condition, round(avg(score) FILTER (WHERE user_id % 2 = 0), 6) AS train, round(avg(score) FILTER (WHERE user_id % 2 = 1), 6) AS heldout, round(avg(score) FILTER (WHERE user_id % 2 = 0) - avg(score) FILTER (WHERE user_id % 2 = 1), 6) AS fall FROM runs GROUP BY condition""")
def heldout_drop(spark, d):
    halves = runs(spark, d).withColumn("half", F.when(F.col("user_id") % 2 == 0, "train").otherwise("heldout"))
    return rounded(metrics.drop_between(halves, ["condition"], "half", "train", "heldout", "score"), "train", "heldout", "fall")


@query("SELECT doc_id, i AS ordinal, CASE i WHEN 0 THEN 'quality' ELSE 'toxic' END AS name, CASE i WHEN 0 THEN quality ELSE toxic END::DOUBLE AS value FROM labels, (SELECT unnest([0, 1]) AS i)")
def score_rows(spark, d):
    return metrics.unpivoted(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])


@query("""WITH r AS (SELECT c_nationkey, c_custkey, c_name, c_custkey % 5 = 0 AS is_merge, 700 AS event FROM customer)
SELECT c_nationkey AS entity, arg_max(c_name, c_custkey) FILTER (WHERE c_custkey < event AND NOT is_merge) AS before, arg_min(c_name, c_custkey) FILTER (WHERE c_custkey > event) AS after FROM r GROUP BY 1""")
def history_neighbours(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("entity"), "c_custkey", "c_name", F.lit(700).alias("event"))
    return statements.history_neighbours(c, "entity", "c_custkey", "c_name", F.col("c_custkey") % 5 == 0, "event")


@query("""WITH v AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view'), f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS value FROM v GROUP BY user_id),
a AS (SELECT e.event_id, e.user_id, v.value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts)
SELECT event_id, user_id, coalesce(a.value, f.value) AS as_of FROM a LEFT JOIN f USING (user_id)""")
def asof_clamped(spark, d):
    e = table(spark, d, "events")
    probes = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return joins.as_of(probes, e.where("event_type = 'view'"), ["user_id"], "ts", "ts", "value", "event_id", clamp=True).select("event_id", "user_id", "as_of")


@query("""SELECT c_nationkey AS graph, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)""")
def isolated_entities(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("graph"), F.col("c_custkey").alias("id"))
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).join(c, "id")
    edges = orders.select("graph", F.col("id").alias("source"), (-F.col("id")).alias("target"))
    return graph.isolated(c, edges)


@query("""SELECT l_orderkey AS graph, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, least(l_partkey % 2, l_suppkey % 2), greatest(l_partkey % 2, l_suppkey % 2) ORDER BY l_linenumber, l_partkey % 2) AS lane FROM lineitem""")
def spread_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("property"), (F.col("l_partkey") % 2).alias("source"), (F.col("l_suppkey") % 2).alias("target"))
    return graph.spread(e).select("graph", F.col("property").alias("line"), F.col("lane").cast("long").alias("lane"))
