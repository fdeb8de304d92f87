import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import graph
from ledgerloom.sources import harvest, records
from ledgerloom.streaming import fold, log

SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("arm", T.StringType()), T.StructField("secret", T.StringType())])


def test_log_is_read_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"run_id": "1", "arm": "a", "secret": "s"}\n\n{"run_id": "2"}\n')
    assert records.read_records(spark, str(tmp_path / "log.jsonl"), SCHEMA).count() == 2
    (tmp_path / "cut.jsonl").write_text('{"run_id": "1"}\n{"run_i')
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        records.read_records(spark, str(tmp_path / "cut.jsonl"), SCHEMA).collect()
    assert [r["run_id"] for r in records.read_tolerant(spark, str(tmp_path / "cut.jsonl"), SCHEMA).collect()] == ["1"]


def test_publishing_and_dumps(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "s"), ("2", "b", "t")], SCHEMA)
    assert records.publish(df).columns == ["run_id", "arm"]
    for _ in range(2):
        records.append_both(df, str(tmp_path / "private"), str(tmp_path / "public"))
    assert spark.read.json(str(tmp_path / "public")).count() == 4 and "secret" not in spark.read.json(str(tmp_path / "public")).columns
    records.dump(df.limit(1), df, ["run_id"], str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump/rows")).count() == 2
    records.write_examples(df.coalesce(1), str(tmp_path / "ft"))
    lines = [x for p in (tmp_path / "ft").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines[0].startswith("﻿") and json.loads(lines[1])["run_id"] == "2"
    records.write_examples(spark.range(100).repartition(8), str(tmp_path / "many"))
    for part in (tmp_path / "many").glob("part-*"):
        assert [x.startswith("\ufeff") for x in part.read_text(encoding="utf-8").splitlines()] == [True] + [False] * (len(part.read_text(encoding="utf-8").splitlines()) - 1)
    (tmp_path / "doc.json").write_text(json.dumps({"cap": 3, "rows": [{"id": 1}, {"id": 2}]}))
    header, rows = records.read_document(spark, str(tmp_path / "doc.json"), "rows")
    assert header.first()["cap"] == 3 and rows.count() == 2


def test_harvest_readers(spark, tmp_path):
    with gzip.open(tmp_path / "q.gz", "wt") as f:
        f.writelines(f'_:a <p> "x" <http://h{i % 2}.org/{i}> .\n' for i in range(8))
        f.write('_:a <p> "cut')
    got = harvest.read_quads(spark, str(tmp_path / "q.gz"), 3).groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in got} == {"h0.org": 3, "h1.org": 3}
    dump = spark.createDataFrame([("INSERT INTO `redirect` VALUES (1,0,'Q5','',''),(2,1,'Q6','',''),(3,0,'Foo\\'s','',''),(4,0,'Q7','','');",), ("-- x",)], "value string")
    assert {tuple(r) for r in harvest.dump_redirects(dump).collect()} == {(1, "Q5"), (4, "Q7")}
    (tmp_path / "c.idx").write_text("com,a)/ 2024\tf1\t0\t10\t1\ncom,b)/ 2024\tf1\t10\t20\t2\n")
    assert harvest.cluster_index(spark, str(tmp_path / "c.idx")).count() == 2
    (tmp_path / "p.tsv").write_text("Q1\tQ2\n")
    assert tuple(harvest.tab_pairs(spark, str(tmp_path / "p.tsv")).first()) == ("Q1", "Q2")
    wiki = spark.createDataFrame([(1, "[[Paris|the city]] [[File:x.png]] [[Rome#History]] [[:]]")], "id long, t string")
    assert {tuple(r) for r in harvest.wikitext_links(wiki, ["id"], "t").collect()} >= {(1, "Paris", "the city")}


def test_archive_members(spark):
    def member(head, body):
        return gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\nHTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)

    assert harvest.member_page(member(b"Content-Type: text/html; charset=latin-1", "é".encode("latin-1"))) == ("latin-1", "é")
    assert harvest.member_page(member(b"X: y", '<meta charset="cp1252">€'.encode("cp1252"))) == ("cp1252", '<meta charset="cp1252">€')
    assert harvest.member_page(member(b"X: y", "ü".encode()))[1] == "ü" and harvest.member_page(b"\x1f\x8bxx") is None and harvest.member_page(None) is None
    df = spark.createDataFrame([(1, bytearray(member(b"X: y", b"<p>hi"))), (2, None)], "id long, content binary")
    assert {r["id"]: r["html"] for r in harvest.member_pages(df).collect()} == {1: "<p>hi", 2: None}


def test_detag_and_delays(spark):
    df = spark.createDataFrame([("&lt;p&gt;a &amp;amp; b&lt;/p&gt;",)], "x string")
    assert df.select(harvest.detagged(F.col("x"))).first()[0] == "a & b"
    r = spark.createDataFrame([("h", 1, 200, 0, 5.0, None), ("h", 2, 429, 1, 5.0, None), ("h", 3, 503, 0, 5.0, 30.0)], "host string, n long, status long, attempt long, delay double, after double")
    assert [x["starts"] for x in harvest.retry_delays(r, "host", "n", "status", "attempt", "delay", "after").orderBy("n").collect()] == [0.0, 5.0, 15.0]


def test_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"run_id": "1", "secret": "s"}\n')
    for _ in range(2):
        log.append_stream(log.stream_records(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "p"), str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination(60)
    (tmp_path / "in/b.jsonl").write_text('{"run_id": "2", "secret": "s"}\n')
    log.append_stream(log.stream_records(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "p"), str(tmp_path / "q"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["run_id"] for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["1", "2"] and "secret" not in spark.read.parquet(str(tmp_path / "q")).columns


def test_fold_stream_keeps_state(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, turn, key):
        (tmp_path / "in" / name).write_text(json.dumps({"session": "s", "turn": turn, "entities": json.dumps([{"key": key, "label": key, "data": {"name": [key]}}]), "links": "[]"}) + "\n")

    put("a.json", 0, "x")
    sizes = []
    for name, turn, key in ((None, 0, ""), ("b.json", 1, "y"), ("c.json", 2, "x")):
        if name:
            put(name, turn, key)
        stream = fold.fold_stream(spark.readStream.schema("session string, turn long, entities string, links string").json(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: sizes.extend(r["nodes"] for r in b.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sizes == [1, 2, 2]


def test_fold_stream_waits_for_late_turns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    turns = [json.dumps({"session": "s", "turn": t, "entities": json.dumps([{"key": k, "label": k, "data": {"name": [k], "at": [str(t)]}}]), "links": json.dumps([[k, "next", "x"]])}) + "\n" for t, k in enumerate("xyxz")]
    sizes = []
    for name, of in enumerate(([2], [0, 2], [1], [3, 1])):
        (tmp_path / "in" / f"{name}.json").write_text("".join(turns[t] for t in of))
        stream = fold.fold_stream(spark.readStream.schema("session string, turn long, entities string, links string").json(str(tmp_path / "in")))
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: sizes.extend((r["turn"], r["nodes"], r["edges"]) for r in b.collect())).trigger(availableNow=True).start().awaitTermination(120)
    batch = graph.fold_sessions(spark.createDataFrame([tuple(json.loads(t).values()) for t in turns], "session string, turn long, entities string, links string")).first()
    assert [t for t, *_ in sizes] == [-1, 0, 2, 3] and sizes[-1][1:] == (batch["nodes"], batch["edges"])


def test_folds_of_long_sessions_are_quick():
    import time

    g, begun = graph.Fold(), time.process_time()
    for t in range(3000):
        g.turn("s", t, [{"key": f"k{t}", "class": "C", "label": f"l{t}", "data": {"name": [f"n{t}"], "group": [str(t)]}}], [(f"k{t}", "after", f"k{t - 1}")] if t else [])
    assert len(g.nodes) == 3000 and len(g.edges) == 2999 and time.process_time() - begun < 5
