import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import written
from ledgerloom.operators import conditions, inheritance, quality, render
from ledgerloom.plans import registry
from tests.oracle import same


def test_gates(spark):
    df = spark.createDataFrame([(1, 10, 6, {"x": 4}, {"a": 6}), (2, 10, 6, {"x": 1}, {"a": 6}), (3, 1, 1, {}, {"a": 0})], "id long, n long, ok long, excluded map<string,long>, classes map<string,long>")
    found = quality.violations(df, "id", quality.accounting_rules("n", "ok", "excluded", "classes"))
    assert {(r["rule"], r["id"]) for r in found.collect()} == {("in = resolved + excluded", "2"), ("classes = resolved", "3")}
    with pytest.raises(ValueError, match="corpus: classes = resolved: 3"):
        quality.refuse(found, "corpus")
    quality.refuse(found.limit(0), "corpus")
    controls = spark.createDataFrame([("empty", "c", 0.0), ("empty", "d", 0.02), ("spelling", "c", 0.2)], "control string, condition string, f1 double")
    assert [r["control"] for r in quality.preflight(controls).collect()] == ["empty"]
    assert [r["name"] for r in quality.ambiguous(spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a")], "name string, holder string"), "name", "holder").collect()] == ["m"]


def test_chains(spark):
    a = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("u", 1, "z")], "task string, o long, said string")
    b = spark.createDataFrame([("t", 5, 10), ("t", 9, 20)], "task string, o long, tokens long")
    assert [(r["step"], r["said"], r["tokens"]) for r in quality.zip_chain(a, b, "task", "o").orderBy("step").collect()] == [(1, "x", 10), (2, "y", 20)]
    assert [r["task"] for r in quality.chain_lengths(a, b, "task").collect()] == ["u"]
    f = quality.fillable_counts(spark.createDataFrame([(["a", "b"], ["b", "c", "d"], False)], "w array<string>, p array<string>, e boolean"), "w", "p")
    assert f.select("tp", "fp", "fn", quality.step_score(f, "e").alias("s")).first()[:] == (1, 2, 1, 0.5)


def test_keys(spark):
    names = "arm string, signal string, vocabulary string, catalogue_size int, pin_units boolean, describe_catalogue boolean, embed_nested boolean, strict_readings boolean, orchestration string, shortlist_k int, plan_retry boolean, unit_match string, reasoning string, language string, output_form string"
    df = spark.createDataFrame([("flat", "label", None, 20, True, False, False, False, "multi", 5, True, "physical", "low", "en", "json")], names)
    assert df.select(conditions.report_key(F.lit("~1.0"))).first()[0] == "flat/label/n20/units/multi(k5)/retry/physical/think:low/en/fid~1.0"
    assert df.select(conditions.runner_key()).first()[0] == "flat/label//bare/multi(k5)/n20/physical/retry/think:low/en"
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "c": "3"}, True), (None, {"a": "1"}, True), ({"a": "1"}, {"a": "1"}, True), (None, {}, False)], "d map<string,string>, x map<string,string>, t boolean")
    assert [r[0] for r in m.select(conditions.training_status("d", "x", "t")).collect()] == ["mismatched", "undeclared", "matched", "base"]
    assert m.select(conditions.differing("d", "x")).first()[0] == ["b", "c"]
    t = spark.createDataFrame([("a qid=Q12 b",), ("none",)], "n string")
    assert [r[0] for r in t.select(conditions.task_item(F.col("n"))).collect()] == ["Q12", None]
    s = spark.createDataFrame([("It was 4.2 mega newton long",)], "n string")
    assert s.select(conditions.spelling_answer(F.col("n"))).first()[0] == '{"value":"4.2","unit":"mega_newton"}'


def test_inheritance_and_cycles(spark):
    parents = spark.createDataFrame([("C", "B", 0), ("C", "A", 1), ("B", "A", 0), ("A", "C", 0)], "class string, parent string, ordinal int")
    declared = spark.createDataFrame([("A", "p", "a"), ("B", "p", "b"), ("A", "q", "a"), ("C", "r", "c")], "class string, name string, value string")
    got = {(r["class"], r["name"]): r["value"] for r in inheritance.effective(parents, declared).collect()}
    assert got["C", "p"] == "b" and got["C", "q"] == "a" and got["B", "p"] == "b" and got["A", "r"] == "c" and got["C", "r"] == "c"
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("h", "c", "a"), ("g", "d", "d")], "g string, s string, t string")
    assert {tuple(r) for r in inheritance.acyclic(edges, "g", "s", "t").collect()} == {("g", "a", "b"), ("g", "b", "c"), ("h", "c", "a")}


def test_written_forms_read_back(spark):
    rows = spark.createDataFrame([("1234567.5", "1898-11-03", "14:05"), ("999", "2024-01-31", "00:30"), ("-1000", "2000-12-01", "12:00")], "n string, d string, t string")
    c = F.col
    w = rows.select(written.written_number(c("n")).alias("n"), written.written_date(c("d")).alias("d"), written.written_time(c("t")).alias("t"))
    assert [tuple(r) for r in w.collect()] == [("1,234,567.5", "3 November 1898", "2:05 pm"), ("999", "31 January 2024", "12:30 am"), ("-1,000", "1 December 2000", "12:00 pm")]
    back = w.select(written.canonical_number(c("n")), written.canonical_date(c("d")), written.canonical_time(c("t")))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows.collect()]
    s = spark.createDataFrame([("PT5M",), ("P1DT1H",), ("5 minutes",), ("P",)], "x string")
    assert [r[0] for r in s.select(written.duration_seconds(c("x"))).collect()] == [300.0, 90000.0, None, None]


def test_rendering(spark):
    df = spark.createDataFrame([("b|", 1.5, None), ("a", 10.0, 2)], "name string, f1 double, n long")
    assert render.fixed_width(df, ["name"]) == "name      f1  n\na     10.000  2\nb|     1.500"
    assert render.markdown(df, ["name"]).splitlines()[-1] == "| b\\| | 1.500 |  |"


def test_lines_of_documents_as_sql_counts_them(spark, tmp_path):
    long = "word " * 14 + "end."
    texts = ["0\n1\n2 tails: 2\n33", " \n \nkey: \n  x  ", f"{long} \n {long}", *(f"{long}{c}\n{c}\nkey:{c}\nkey:{c}v\nsign{c}in" for c in "\t\v\f\r\x1c\x85\xa0\u2003\u2028\u3000\u200b"), "sİgn in\nCOO\u212aIE", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("doc_stats", "usable_document"):
        same(registry.QUERIES[name](spark, str(tmp_path)), tables, registry.ORACLE_SQL[name])
    first = registry.QUERIES["doc_stats"](spark, str(tmp_path)).where("doc_id = 0").first()
    assert (first["lines"], first["specs"]) == (4, 1)
