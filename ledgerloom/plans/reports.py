"""Report queries: the run log, confusion, cost and identity figures, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import conditions, joins, metrics, statements
from .registry import query, table

# events as a run log: event_type is the condition, user_id % 5 the model, value / 20, at most 1, the score; every 17th cell failed
RUNS = """
runs AS (
  SELECT event_id, event_type AS condition, user_id % 5 AS model, user_id, day(ts)::BIGINT AS day, CASE WHEN event_id % 17 <> 0 THEN least(value / 20, 1) END AS score,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_id % 1000 AS chars, event_id % 3 + 1 AS calls,
         CASE WHEN event_id % 17 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'TimeoutError: gave up after ' || CAST(event_id % 7 AS VARCHAR) || ' s'
              WHEN 1 THEN 'ValueError: api_key=abc' || CAST(event_id % 3 AS VARCHAR) || ' refused' WHEN 2 THEN 'HTTPError: https://host/' || CAST(event_id AS VARCHAR) || ' 503'
              ELSE 'KeyError' END END AS error,
         CASE WHEN user_id % 4 = 0 THEN NULL ELSE value / 250 END AS fidelity
  FROM events)"""


def runs(spark, d):
    e = table(spark, d, "events")
    failed = F.col("event_id") % 17 == 0
    k = F.col("event_id") % 4
    error = (
        F.when(k == 0, F.concat(F.lit("TimeoutError: gave up after "), (F.col("event_id") % 7).cast("string"), F.lit(" s")))
        .when(k == 1, F.concat(F.lit("ValueError: api_key=abc"), (F.col("event_id") % 3).cast("string"), F.lit(" refused")))
        .when(k == 2, F.concat(F.lit("HTTPError: https://host/"), F.col("event_id").cast("string"), F.lit(" 503")))
        .otherwise("KeyError")
    )
    return e.select(
        "event_id", F.col("event_type").alias("condition"), (F.col("user_id") % 5).alias("model"), "user_id", F.when(~failed, F.least(F.col("value") / 20, F.lit(1.0))).alias("score"), F.dayofmonth("ts").cast("long").alias("day"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_id") % 1000).alias("chars"), (F.col("event_id") % 3 + 1).alias("calls"),
        F.when(failed, error).alias("error"), F.when(F.col("user_id") % 4 != 0, F.col("value") / 250).alias("fidelity"),
    )


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_TABLE = """
SELECT condition, model, count(score) AS n, round(coalesce(avg(score), 0), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd,
       count(*) FILTER (WHERE score IS NULL) AS failures, coalesce(sum(tokens) FILTER (WHERE score IS NOT NULL), 0)::BIGINT AS tokens,
       coalesce(sum(calls) FILTER (WHERE score IS NOT NULL), 0)::BIGINT AS calls, round(coalesce(avg(chars) FILTER (WHERE score IS NOT NULL), 0), 6) AS document_chars,
       round(coalesce(coalesce(sum(tokens) FILTER (WHERE score IS NOT NULL), 0)::DOUBLE / nullif(count(score), 0), 0), 6) AS tokens_per_task
FROM runs GROUP BY condition, model"""


@query(f"WITH {RUNS} {_TABLE}")
def report_tabulate(spark, d):
    return rounded(metrics.tabulate(runs(spark, d), ["condition", "model"], "score", "tokens", "calls", "chars"), "mean", "sd", "document_chars", "tokens_per_task")


_PER_USER = "SELECT condition, user_id, day, count(score) AS n, round(coalesce(avg(score), 0), 6) AS mean, count(*) FILTER (WHERE score IS NULL) AS failures FROM runs GROUP BY condition, user_id, day"


def _per_user(spark, d):
    return metrics.tabulate(runs(spark, d), ["condition", "user_id", "day"], "score", "tokens").withColumn("mean", F.round("mean", 6)).select("condition", "user_id", "day", "n", "mean", "failures")


@query(f"WITH {RUNS}, t AS ({_PER_USER}) SELECT * FROM t WHERE mean >= {metrics.SATURATED}")
def report_saturated(spark, d):
    return metrics.saturated(_per_user(spark, d))


@query(f"WITH {RUNS}, t AS ({_PER_USER}) SELECT * FROM t WHERE n = 1")
def report_single_obs(spark, d):
    return metrics.single_observation(_per_user(spark, d))


@query(f"WITH {RUNS} SELECT condition || '-' || model::VARCHAR AS label, round(median(tokens), 6)::DOUBLE AS context_tokens, round(avg(score), 6) AS f1 FROM runs WHERE score IS NOT NULL GROUP BY 1")
def report_median_label(spark, d):
    label = F.concat_ws("-", "condition", F.col("model").cast("string"))
    return runs(spark, d).where("score IS NOT NULL").groupBy(label.alias("label")).agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY tokens)"), 6).cast("double").alias("context_tokens"), F.round(F.avg("score"), 6).alias("f1"))


@query(f"""WITH {RUNS}, b AS (
  SELECT condition, model, string_agg(DISTINCT CASE WHEN fidelity < 0.5 THEN '<0.5' WHEN fidelity < 0.95 THEN '0.5-0.95' WHEN fidelity <= 1.0 THEN '~1.0' ELSE '>1.0' END, '|' ORDER BY
         CASE WHEN fidelity < 0.5 THEN '<0.5' WHEN fidelity < 0.95 THEN '0.5-0.95' WHEN fidelity <= 1.0 THEN '~1.0' ELSE '>1.0' END) FILTER (WHERE fidelity IS NOT NULL) AS bands
  FROM runs GROUP BY condition, model)
SELECT CASE WHEN bands IS NULL THEN condition ELSE condition || '/fid' || bands END AS label, model, count(score) AS n, round(avg(score), 6) AS mean
FROM runs JOIN b USING (condition, model) GROUP BY 1, 2""")
def fidelity_bands(spark, d):
    r = runs(spark, d)
    labels = metrics.banded_conditions(r, "condition", "model", "fidelity")
    return r.join(F.broadcast(labels), ["condition", "model"]).groupBy("label", "model").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {RUNS} SELECT condition, split_part(error, ':', 1) AS kind, count(*) AS n FROM runs WHERE error IS NOT NULL GROUP BY 1, 2")
def failures_and_errors(spark, d):
    return metrics.error_kinds(runs(spark, d), "error", ["condition"])


@query(f"""WITH {RUNS} SELECT left(regexp_replace(regexp_replace(error, '(?i)(api[-_]?key|token|secret|password|authorization)(\\s*[=:]\\s*)\\S+', '\\1\\2***', 'g'), 'https?://\\S+', '<url>', 'g'), 300) AS message, count(*) AS n
FROM runs WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, message LIMIT 5""")
def error_topk(spark, d):
    from ..functions.text import scrubbed

    return metrics.top_messages(runs(spark, d).where("error IS NOT NULL"), scrubbed(F.col("error")))


@query("SELECT r_name AS condition, n_name AS model, g.repetition, r_name || '/' || n_name || '/' || g.repetition::VARCHAR AS cell FROM region, nation, (SELECT unnest([1, 2, 3])::BIGINT AS repetition) g")
def grid_cells(spark, d):
    cells = joins.grid(table(spark, d, "region").select(F.col("r_name").alias("condition")), table(spark, d, "nation").select(F.col("n_name").alias("model")), repetitions=3)
    return cells.withColumn("cell", F.concat_ws("/", "condition", "model", F.col("repetition").cast("string")))


_PRF = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support"
_CONF = "count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn"


@query(f"WITH c AS (SELECT {_CONF} FROM labels) SELECT *, {_PRF} FROM c")
def prf_confusion(spark, d):
    return rounded(metrics.confusion(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1, []), "precision", "recall", "f1")


@query(f"WITH c AS (SELECT lang, {_CONF} FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT *, {_PRF} FROM c")
def prf_per_class(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(metrics.confusion(both, F.col("quality") == 1, F.col("toxic") == 1, ["lang"]), "precision", "recall", "f1")


@query("SELECT CASE WHEN grouping(role) = 1 THEN 'total' ELSE role END AS step, count(*) AS calls, coalesce(sum(length(text)), 0)::BIGINT AS tokens FROM conversations GROUP BY ROLLUP (role)")
def cost_rows_total(spark, d):
    return metrics.cost_rows(table(spark, d, "conversations").select("role", F.length("text").alias("tokens")), "role", "tokens")


@query("""SELECT coalesce(l_returnflag, 'all') AS model, coalesce(l_linestatus, 'all') AS arm, count(*) FILTER (WHERE l_discount > 0.08) AS impossible, count(*) AS answers,
       round(count(*) FILTER (WHERE l_discount > 0.08)::DOUBLE / count(*), 6) AS rate
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) >= 30""")
def flat_licence_rollup(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount").rollup("l_returnflag", "l_linestatus")
    out = rows.agg(F.count_if(F.col("l_discount") > 0.08).alias("impossible"), F.count("*").alias("answers")).where("answers >= 30")
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("model"), F.coalesce("l_linestatus", F.lit("all")).alias("arm"), "impossible", "answers", F.round(metrics.ratio(F.col("impossible"), F.col("answers")), 6).alias("rate"))


@query("SELECT coalesce(o_orderstatus, 'all') AS strict, coalesce(o_orderpriority, 'all') AS split, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def strict_cube(spark, d):
    out = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("strict"), F.coalesce("o_orderpriority", F.lit("all")).alias("split"), "n", "mean")


# lineitem as a ledger of judgements
LEDGER = """
ledger AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'same' WHEN 'A' THEN 'different' ELSE 'unclear' END AS truth,
         CASE WHEN l_discount < 0.03 THEN 'same' WHEN l_discount < 0.07 THEN 'different' ELSE 'unclear' END AS decision,
         CASE l_linestatus WHEN 'F' THEN 'agreement' ELSE 'prefilter' END AS route, CAST(l_quantity AS BIGINT) % 4 AS class FROM lineitem)"""


def _ledger(spark, d):
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "same").when(F.col("l_returnflag") == "A", "different").otherwise("unclear").alias("truth"),
        F.when(F.col("l_discount") < 0.03, "same").when(F.col("l_discount") < 0.07, "different").otherwise("unclear").alias("decision"),
        F.when(F.col("l_linestatus") == "F", "agreement").otherwise("prefilter").alias("route"), (F.col("l_quantity").cast("long") % 4).alias("class"),
    )


@query(f"""WITH {LEDGER}, c AS (
  SELECT class, count(*) AS n, count(*) FILTER (WHERE truth = decision) AS "right", count(*) FILTER (WHERE decision <> 'unclear') AS decided,
         count(*) FILTER (WHERE truth = decision AND decision <> 'unclear') AS right_decided, count(*) FILTER (WHERE decision = 'same' AND truth = 'different') AS wrong_merges,
         count(*) FILTER (WHERE decision <> 'unclear' AND route = 'agreement') AS by_agreement FROM ledger GROUP BY class)
SELECT *, round("right"::DOUBLE / n, 6) AS accuracy, round(decided::DOUBLE / n, 6) AS coverage, round(coalesce(right_decided::DOUBLE / nullif(decided, 0), 0), 6) AS decided_accuracy FROM c""")
def identity_score(spark, d):
    return rounded(metrics.identity_score(_ledger(spark, d), "truth", "decision", "route", ["class"]), "accuracy", "coverage", "decided_accuracy")


@query(f"WITH {LEDGER} SELECT truth, decision, count(*) AS n FROM ledger GROUP BY truth, decision")
def identity_confusion(spark, d):
    return metrics.cross_counts(_ledger(spark, d), ["truth", "decision"])


@query("SELECT lang, count(*) AS n, count(quality) AS decided, round(count(quality)::DOUBLE / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage_counts(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.coverage(both, ["lang"], "quality").withColumn("coverage", F.round("coverage", 6))


@query("""WITH c AS (SELECT p_type, p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_type, p_brand, sum(n)::BIGINT AS stated, max(n) AS commonest FROM c GROUP BY ALL),
a AS (SELECT p_type, sum(stated) AS al FROM s GROUP BY p_type)
SELECT p_type, p_brand, stated, commonest, round(commonest::DOUBLE / stated, 6) AS share FROM s JOIN a USING (p_type) WHERE al >= 40 AND stated >= 10""")
def guessable_share(spark, d):
    return metrics.guessable(table(spark, d, "part"), "p_type", "p_brand", "p_name", 40, 10).withColumn("share", F.round("share", 6))


_REASON = "CASE WHEN n_chars < 120 THEN 'too short' WHEN lang <> 'en' THEN 'language' WHEN source IN ('src3', 'src7') THEN 'source' END"


def _reason():
    return statements.first_reason([("too short", F.col("n_chars") < 120), ("language", F.col("lang") != "en"), ("source", F.col("source").isin("src3", "src7"))])


@query(f"""WITH j AS (SELECT source, {_REASON} AS reason FROM documents)
SELECT source, count(*) AS rows_in, count(*) FILTER (WHERE reason IS NULL) AS resolved, count(reason) AS excluded, count(*) = count(*) FILTER (WHERE reason IS NULL) + count(reason) AS closes FROM j GROUP BY source""")
def accounting_gate(spark, d):
    return metrics.accounting(table(spark, d, "documents").select("source", "lang", "n_chars"), _reason(), ["source"])


@query(f"SELECT coalesce({_REASON}, 'resolved') AS reason, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def exclusion_reasons(spark, d):
    judged = table(spark, d, "documents").withColumn("reason", F.coalesce(_reason(), F.lit("resolved")))
    return metrics.cross_counts(judged, ["reason", "lang"])


@query("""SELECT p_partkey, CASE WHEN p_brand IS NULL THEN 'undeclared' WHEN p_brand = 'Brand#2' AND p_size <= 25 THEN 'matched' WHEN p_brand = 'Brand#2' THEN 'mismatched' ELSE 'base' END AS status,
       concat_ws('|', CASE WHEN p_size > 25 THEN 'size' END, CASE WHEN p_type <> 'SMALL' THEN 'type' END) AS differing FROM part""")
def training_match(spark, d):
    p = table(spark, d, "part")
    at_most = F.when(F.col("p_size") > 25, "over").otherwise("at most 25")
    p = p.withColumn("_size", F.create_map(F.lit("size"), at_most)).withColumn("_told", F.when(F.col("p_brand").isNotNull(), F.create_map(F.lit("size"), F.lit("at most 25"))))
    p = p.withColumn("_tuned", F.coalesce(F.col("p_brand") == "Brand#2", F.lit(True)))
    p = p.withColumn("_held", F.create_map(F.lit("size"), at_most, F.lit("type"), F.col("p_type"))).withColumn("_want", F.create_map(F.lit("size"), F.lit("at most 25"), F.lit("type"), F.lit("SMALL")))
    return p.select("p_partkey", conditions.training_status("_told", "_size", "_tuned").alias("status"), F.concat_ws("|", conditions.differing("_want", "_held")).alias("differing"))


@query("SELECT c_custkey, c_name, sha256('{\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_nationkey\":' || c_nationkey::VARCHAR || '}') AS config_hash FROM customer")
def published_projection(spark, d):
    from ..sources.records import publish

    c = table(spark, d, "customer")
    return publish(c.withColumn("config_hash", content_hash("c_nationkey", "c_mktsegment")), ["c_custkey", "c_name", "config_hash"])


@query("SELECT sha256(c_name || 'seed') < '8' AS train, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1, 2")
def heldout_split(spark, d):
    train = F.sha2(F.concat("c_name", F.lit("seed")), 256) < "8"
    return table(spark, d, "customer").groupBy(train.alias("train"), "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("""WITH p AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS only_b FROM labels),
k AS (SELECT only_a, only_b, only_a + only_b AS n, unnest(generate_series(0, least(only_a, only_b))) AS i FROM p)
SELECT only_a, only_b, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 9) AS p_value FROM k GROUP BY ALL""")
def paired_test(spark, d):
    out = metrics.mcnemar(table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b")
    return out.withColumn("p_value", F.round("p_value", 9))


@query(f"WITH {LEDGER} SELECT truth, decision, count(*) AS n FROM ledger WHERE truth <> decision GROUP BY truth, decision ORDER BY n DESC, truth, decision LIMIT 3")
def class_errors(spark, d):
    return metrics.class_errors(_ledger(spark, d), "truth", "decision", 3)


@query("""WITH c AS (SELECT p_type, p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_type, p_brand, sum(n)::BIGINT AS stated, max(n) AS commonest FROM c GROUP BY ALL),
a AS (SELECT p_type, sum(stated) AS al FROM s GROUP BY p_type), g AS (SELECT p_type, p_brand, commonest::DOUBLE / stated AS share FROM s JOIN a USING (p_type) WHERE al >= 20 AND stated >= 2)
SELECT p_brand, p_type, round(share, 6) AS share FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY share DESC, p_type) = 1""")
def least_telling_classes(spark, d):
    shares = metrics.guessable(table(spark, d, "part"), "p_type", "p_brand", "p_name", 20, 2)
    return rounded(metrics.least_telling(shares, "p_type", "p_brand"), "share")


_ARMS = ("A2", "A4-blind", "catalog-enforced", "catalog-not-enforced-gated", "schema-dump-catalog-flat-enforced-strict")


@query(f"""WITH a AS (SELECT event_id, (['{"', '".join(_ARMS)}'])[event_id % {len(_ARMS)} + 1] AS arm, event_id % 2 = 0 AS described, event_id % 3 = 0 AS embedded FROM events)
SELECT event_id, CASE arm WHEN 'A2' THEN 'schema-dump-catalog-flat-enforced' WHEN 'A4-blind' THEN 'no-catalog-enforced' WHEN 'schema-dump-catalog-flat-enforced-strict' THEN arm
       ELSE CASE WHEN described THEN 'schema-prose-full-' ELSE 'schema-prose-' END || arm END || CASE WHEN embedded THEN '-embedded' ELSE '' END AS label FROM a""")
def published_names(spark, d):
    i = F.col("event_id")
    arm = F.element_at(F.array(*map(F.lit, _ARMS)), (i % len(_ARMS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", conditions.published_name(arm, i % 2 == 0, i % 3 == 0).alias("label"))


@query("""WITH u AS (SELECT p_brand AS spelling, min(p_type) AS unit FROM part WHERE p_size <= 3 GROUP BY 1 HAVING count(DISTINCT p_type) = 1 UNION ALL SELECT p_type, p_type FROM part GROUP BY 1)
SELECT p_partkey, coalesce(b.unit, t.unit) AS unit FROM part LEFT JOIN u b ON b.spelling = p_brand LEFT JOIN u t ON t.spelling = p_type""")
def spelled_units(spark, d):
    part = table(spark, d, "part")
    named = joins.unambiguous(part.where("p_size <= 3").select(F.col("p_brand").alias("spelling"), F.col("p_type").alias("unit")), "spelling", "unit")
    every = named.unionByName(part.select(F.col("p_type").alias("spelling"), F.col("p_type").alias("unit")).distinct())
    forms = part.select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("forms"))
    return joins.first_spelling(forms, ["p_partkey"], "forms", every, "spelling", "unit")
