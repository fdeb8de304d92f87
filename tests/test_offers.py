import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators import catalogue
from ledgerloom.plans import registry
from ledgerloom.sources import crawl, files, vocabulary
from tests.oracle import same


def test_schema_folders_and_inherited_units(spark, tmp_path):
    def put(name, **more):
        (tmp_path / f"{name}.schema.json").write_text(json.dumps({"title": name, **more}))

    put("Length", properties={"unit": {"enum": ["meter", "inch"]}}, description=" How long. ")
    put("Radius", allOf=[{"$ref": "Length.schema.json"}], **{"y-titles": {"en": "radius"}})
    put("Loop", allOf=[{"$ref": "Loop.schema.json"}])
    (tmp_path / "Bare.schema.json").write_text("{}")
    (tmp_path / "other.json").write_text('{"title": "no"}')
    rows = {r["name"]: r for r in vocabulary.effective_units(vocabulary.read_schemas(spark, str(tmp_path), titles="y-titles")).collect()}
    assert set(rows) == {"Length", "Radius", "Loop", "Bare.schema"} and rows["Length"]["description"] == "How long." and rows["Radius"]["label"] == "radius"
    assert rows["Radius"]["parent"] == "Length" and rows["Radius"]["units"] is None and rows["Radius"]["effective"] == ["meter", "inch"] and rows["Loop"]["effective"] is None


def test_graph_vocabularies(spark, tmp_path):
    node = lambda name, kind, **more: {"@id": f"schema:{name}", "@type": kind, **{k: [{"@id": f"schema:{v}"} for v in vs] if len(vs) > 1 else {"@id": f"schema:{vs[0]}"} for k, vs in more.items()}}
    sub, dom, rng = "rdfs:subClassOf", "schema:domainIncludes", "schema:rangeIncludes"
    graph = [
        node("Thing", "rdfs:Class"), node("Enumeration", "rdfs:Class", **{sub: ["Thing"]}), node("DayOfWeek", "rdfs:Class", **{sub: ["Enumeration"]}), node("Monday", "schema:DayOfWeek"), node("Friday", ["schema:DayOfWeek", "x"]), node("Person", "rdfs:Class", **{sub: ["Thing", "Agent"]}), node("Agent", "rdfs:Class"),
        node("born", "rdf:Property", **{dom: ["Person"], rng: ["Text", "Date"]}), node("day", "rdf:Property", **{dom: ["Person"], rng: ["DayOfWeek", "Text"]}), node("knows", "rdf:Property", **{dom: ["Person"], rng: ["Person"]}), node("old", "rdf:Property", **{dom: ["Person"], rng: ["Text"], "schema:supersededBy": ["born"]}), node("loose", "rdf:Property", **{rng: ["Text"]}),
    ]
    (tmp_path / "v.jsonld").write_text(json.dumps({"@context": {}, "@graph": graph}))
    g = vocabulary.read_graph(spark, str(tmp_path / "v.jsonld"))
    closed = vocabulary.lineage(g)
    assert {r["name"] for r in vocabulary.plain_classes(g, closed).collect()} == {"Thing", "Person", "Agent"}
    assert {(r["child"], r["ancestor"]) for r in closed.where("child = 'DayOfWeek'").collect()} == {("DayOfWeek", "Enumeration"), ("DayOfWeek", "Thing")}
    kinds = {r["name"]: (r["kind"], r["members"]) for r in vocabulary.slot_kinds(g, closed, {"Date": "date", "Number": "number"}).collect()}
    assert kinds == {"born": ("date", None), "day": ("enum", ["Friday", "Monday"]), "knows": ("text", None)}


def test_archives_marks_manifests_and_yaml(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.json", "[1]")
    df = spark.createDataFrame([(1, bytearray(held.getvalue())), (2, bytearray(b"no zip")), (3, None)], "id long, content binary")
    assert [tuple(r) for r in files.zip_members(df, "id", ("a.json", "b.json")).collect()] == [(1, "a.json", "[1]")]
    assert files.unmarked("a ★b★ c ★★d★★ ★e", ("★", "★★")) == ("a b c d e", [("★", 2, 3), ("★★", 6, 7)])
    marked = files.annotated(spark.createDataFrame([(1, "x ★y★"), (2, None)], "id long, t string"), "id", "t", ("★",)).orderBy("id").collect()
    assert (marked[0]["plain"], [tuple(s) for s in marked[0]["spans"]]) == ("x y", [("★", 2, 3)]) and marked[1]["plain"] is None
    pages = spark.createDataFrame([(1, "one"), (2, "two")], "id long, body string")
    files.write_manifest(pages, "id", "body", str(tmp_path / "m"))
    again = spark.createDataFrame([(1, "one"), (2, "other"), (9, "x")], "id long, body string")
    assert {r["id"]: r["same"] for r in files.refilled(spark, str(tmp_path / "m"), again, "id", "body").collect()} == {1: True, 2: False}
    y = spark.createDataFrame([(1, 'say "x"', ["a", "b"], None)], "id long, name string, tags array<string>, gone string")
    assert files.yaml_lines(y, "id", ["name", "tags", "gone"]).first()["yaml"] == '---\nname: "say \\"x\\""\ntags:\n- "a"\n- "b"'


def test_catalogues(spark):
    df = spark.createDataFrame([("t1", ["A", "B", "C", "D"], ["D", "Z", "D"], 2, False), ("t2", ["A", "B"], [], None, False), ("t3", ["A", "V"], ["A"], 9, True)], "id string, c array<string>, n array<string>, k int, e boolean").coalesce(1)
    out = df.withColumn("o", catalogue.offered(F.col("c"), F.array(F.lit("V")), F.col("e"))).withColumn("t", catalogue.trimmed(F.col("o"), F.col("n"), F.col("k")))
    assert [r["t"] for r in out.collect()] == [["D", "A"], ["A", "B"], ["A"]]
    mixed = [r[0] for r in out.select(catalogue.shuffled(F.col("c"), F.col("id"))).collect()]
    assert [sorted(x) for x in mixed] == [["A", "B", "C", "D"], ["A", "B"], ["A", "V"]] and mixed == [r[0] for r in out.select(catalogue.shuffled(F.col("c"), F.col("id"))).collect()]
    with pytest.raises(Exception, match="needed classes: 2"):
        df.select(catalogue.trimmed(F.col("c"), F.array(F.lit("A"), F.lit("B")), F.lit(1))).collect()
    with pytest.raises(Exception, match="only value objects"):
        df.select(catalogue.offered(F.col("c"), F.col("c"), F.lit(True))).collect()
    kept, rejected = catalogue.first_accepted(spark.range(20), "id", F.col("id") % 3 == 0, 4)
    assert sorted(r["id"] for r in kept.collect()) == [0, 3, 6, 9] and rejected == 6
    assert catalogue.first_accepted(spark.range(3), "id", F.col("id") > 5, 2)[1] == 0
    nodes = spark.createDataFrame([('{"schema:text": 1, "a": [{"text": 2, "b": 3}]}',), (None,)], "n string").coalesce(1)
    assert [r[0] for r in nodes.select(catalogue.pruned(F.col("n"), ("text",))).collect()] == ['{"a": [{"b": 3}]}', None]


def test_a_brand_that_needs_more_than_fits_has_no_catalogue(spark, tmp_path):
    parts = [(f"Brand#{b}", size) for b, sizes in enumerate([[50] * 41 + [1] * 9, [1] * 30 + [50] * 40, [50] * 5 + [1] * 60, [50] * 40, [1] * 41, [50, 2]]) for size in sizes]
    spark.createDataFrame([(i, b, size) for i, (b, size) in enumerate(parts)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    found = registry.QUERIES["trimmed_catalogue"](spark, str(tmp_path))
    same(found, tables, registry.ORACLE_SQL["trimmed_catalogue"])
    assert sorted(r["task"] for r in found.collect()) == [f"Brand#{b}" for b in range(1, 6)]


def test_names(spark):
    df = spark.createDataFrame([("Allocín é-rating", "Q1"), ("2nd name", "P7"), ("", "Q3"), (None, "Q4")], "label string, id string").coalesce(1)
    assert [r[0] for r in df.select(names.class_stem(F.col("label"), F.col("id"))).collect()] == ["AllocinERating", "2ndName", "Q3", "Q4"]
    assert [r[0] for r in df.select(names.property_term(F.col("label"), F.col("id"), ("type",))).collect()] == ["allocin_e_rating", "p7", "q3", "q4"]
    assert [r[0] for r in spark.createDataFrame([(" schema:Book",), ("https://schema.org/Book",), ("Book",)], "t string").coalesce(1).select(names.term(F.col("t"))).collect()] == ["Book"] * 3
    assert spark.range(1).select(names.unit_name(F.lit("Milli mole per  Kilo gram"))).first()[0] == "milli_mole_per_kilo_gram"
    rows = spark.createDataFrame([("Bank", "1"), ("bank", "2"), ("River", "3")], "n string, i string")
    assert {r["i"]: r["own"] for r in names.disambiguated(rows, "n", "i", "own").collect()} == {"1": "Bank_1", "2": "bank_2", "3": "River"}
    with pytest.raises(ValueError, match="x stands for a and b"):
        names.refuse_collisions(spark.createDataFrame([("a", "x"), ("b", "x")], "n string, i string"), "n", "i")


def test_crawling_rules_and_captures(spark):
    robots = spark.createDataFrame([("a.org", 200, "User-agent: *\nDisallow: /p\nCrawl-delay: 20"), ("b.org", 404, None), ("c.org", 500, None), ("d.org", 403, "")], "host string, status int, body string")
    urls = spark.createDataFrame([("http://a.org/p/1",), ("http://a.org/q",), ("http://b.org/",), ("http://c.org/",), ("http://d.org/",), ("http://e.org/",), (None,)], "url string")
    got = {r["url"]: (r["allowed"], r["delay"]) for r in crawl.permissions(urls, robots, "me", 2.0).collect()}
    assert got == {"http://a.org/p/1": (False, 20.0), "http://a.org/q": (True, 20.0), "http://b.org/": (True, 2.0), "http://c.org/": (False, 2.0), "http://d.org/": (False, 2.0), "http://e.org/": (False, 2.0), None: (False, 2.0)}
    assert [r["got"] for r in crawl.moved(spark.createDataFrame([("http://a.org/1", "http://a.org/2"), ("http://a.org/1", "http://b.org/1")], "asked string, got string"), "asked", "got").collect()] == ["http://b.org/1"]
    line = lambda ts, **more: f"org,a)/q {ts} " + json.dumps({"status": "200", "filename": "x.warc.gz", "offset": "7", "length": "9", **more})
    lines = spark.createDataFrame([(line(3),), (line(2, offset="5"),), (line(1, status="301"),), (line(0, filename="x.robotstxt"),), ("broken",), (None,)], "line string")
    assert [tuple(r) for r in crawl.captures(lines, urls).collect()] == [("http://a.org/q", "2", "x.warc.gz", 5, 9)]
