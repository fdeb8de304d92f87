import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import filters, graph, identity, inheritance, joins, metrics, sampling


def col(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_text_folds(spark):
    assert col(spark, text.property_name, "birthDate", "birth-date", " HTTPServer name") == ["birth_date", "birth_date", "http_server_name"]
    assert col(spark, text.readable_kind, "ElectricCharge", "DNAStrand") == ["electric charge", "DNA strand"]
    assert col(spark, text.surt, "https://www.A.example.com/Path?q=1#f", "http://b.org") == ["com,example,a)/path?q=1", "org,b)/"]
    assert col(spark, text.copy_fingerprint, "One two, THREE!", "***", None) == ["one two three", "", None]
    assert col(spark, text.scrubbed, "api_key=abc https://h/x sk-12345678901") == ["api_key=*** <url> ***"]
    assert col(spark, lambda c: text.excerpt(c, 3), "abcd", "abc") == ["abc …", "abc"]
    assert col(spark, text.informative, "aaaaaaaa", "ab", "Curie, Marie") == [False, False, True]
    assert col(spark, text.shingles, "ab", "abcd", "") == [["ab"], ["abc", "bcd"], []]


def test_even_spread_matches_the_rule(spark):
    rng = random.Random(2)
    sizes = {f"g{i}": rng.randint(1, 40) for i in range(12)}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i long")
    for k in (1, 2, 7, 50):
        got = {}
        for r in sampling.even_spread(df, ["g"], ["i"], F.lit(k)).collect():
            got.setdefault(r["g"], []).append(r["i"])
        for g, n in sizes.items():
            m = min(k, n)
            assert sorted(got[g]) == ([n // 2] if m == 1 else [round(j * (n - 1) / (m - 1)) for j in range(m)])


def test_capped_values_walks_in_order(spark):
    rows = [("a", i, [f"v{i % 2}", f"w{i % 3}"]) for i in range(30)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "g string, k long, facts array<string>")
    got = sorted((r["g"], r["k"]) for r in sampling.capped_values(df, "g", "k", "facts", 2).collect())
    used, want = {}, [("b", 0)]
    for g, k, facts in rows[:-1]:
        if all(used.get(f, 0) < 2 for f in facts):
            want.append((g, k))
            for f in facts:
                used[f] = used.get(f, 0) + 1
    assert got == sorted(want)


def test_require_groups(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert sampling.require_groups(df, "c", ["a"]).count() == 1
    with pytest.raises(ValueError, match="'b'"):
        sampling.require_groups(df, "c", ["a", "b"])


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "x")], "child string, parent string")
    got = {tuple(r) for r in joins.closure(edges, "child", "parent").collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", y) for y in "abc"}


def test_closure_of_long_chains_and_many_paths(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)]
    diamonds = [e for i in range(18) for e in ((f"d{i}", f"d{i}l"), (f"d{i}", f"d{i}r"), (f"d{i}l", f"d{i + 1}"), (f"d{i}r", f"d{i + 1}"))]
    edges = spark.createDataFrame(chain + diamonds + [("x", "x")], "child string, parent string")
    got = {tuple(r) for r in joins.closure(edges, "child", "parent").collect()}
    up = {}
    for c, p in chain + diamonds:
        up.setdefault(c, set()).add(p)
    want = set()
    for start in up:
        stack = list(up[start])
        while stack:
            at = stack.pop()
            if (start, at) not in want:
                want.add((start, at))
                stack += up.get(at, ())
    assert got == want and joins.closure(edges.limit(0), "child", "parent").count() == 0


def test_effective_declarations_in_many_paths(spark):
    rows = [e for i in range(18) for e in ((f"d{i}", f"d{i}l", 0), (f"d{i}", f"d{i}r", 1), (f"d{i}l", f"d{i + 1}", 0), (f"d{i}r", f"d{i + 1}", 0))] + [("d18", "d0", 0)]
    declared = [("d18", "p", "far"), ("d9", "p", "near"), ("d3r", "q", "right"), ("d3l", "q", "left"), ("d5", "r", "own")]
    out = inheritance.effective(spark.createDataFrame(rows, "class string, parent string, ordinal int"), spark.createDataFrame(declared, "class string, name string, value string"))
    got = {(r["class"], r["name"]): (r["value"], r["from"]) for r in out.collect()}
    assert got["d0", "p"] == ("near", "d9") and got["d10", "p"] == ("far", "d18") and got["d0", "q"] == ("left", "d3l") and got["d3r", "q"] == ("right", "d3r") and got["d5", "r"] == ("own", "d5")
    assert got["d6", "r"] == ("own", "d5") and len(got) == 55 * 3


def test_bands_end_at_their_bounds(spark):
    assert [r[0] for r in spark.createDataFrame([(0.499,), (0.5,), (0.95,), (1.0,), (1.0001,), (None,)], "x double").select(metrics.fidelity_band(F.col("x"))).collect()] == ["<0.5", "0.5-0.95", "~1.0", "~1.0", ">1.0", None]


def test_grids_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_AXIS", 3)
    axis = spark.range(3)
    assert joins.grid(axis, axis.toDF("b"), repetitions=2).count() == 18
    with pytest.raises(ValueError, match="grid"):
        joins.grid(axis, spark.range(4).toDF("b"))


def test_as_of_clamps_to_the_first(spark):
    probes = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "g string, t long, id long")
    builds = spark.createDataFrame([("u", 2, 10, 1), ("u", 2, 11, 2), ("u", 6, 30, 3)], "g string, t long, value long, k long")
    assert {r["id"]: r["as_of"] for r in joins.as_of(probes, builds, ["g"], "t", "t", "value", "k", clamp=True).collect()} == {1: 11, 2: 10, 3: None}


def test_as_of_ties_and_missing(spark):
    probes = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "g string, t long, id long")
    builds = spark.createDataFrame([("u", 2, 10, 1), ("u", 5, 20, 2), ("u", 6, 30, 3)], "g string, t long, value long, k long")
    assert {r["id"]: r["as_of"] for r in joins.as_of(probes, builds, ["g"], "t", "t", "value", "k").collect()} == {1: 20, 2: None, 3: None}


def test_spellings_and_others(spark):
    s = joins.unambiguous(spark.createDataFrame([("m", "meter"), ("M", "mega"), ("M", "molar")], "spelling string, unit string"), "spelling", "unit")
    rows = spark.createDataFrame([(1, ["M", "m"]), (2, ["zz"])], "id long, forms array<string>")
    assert [tuple(r) for r in joins.first_spelling(rows, ["id"], "forms", s, "spelling", "unit").collect()] == [(1, "meter")]
    assert {r["k"]: r["other"] for r in joins.other_of_group(spark.createDataFrame([(1,), (2,), (3,)], "k long"), "k", "k").collect()} == {1: 2, 2: 1, 3: 1}


def test_tabulate_nulls(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", 0.5, 7), ("b", None, 1)], "c string, score double, tokens long")
    rows = {r["c"]: r.asDict() for r in metrics.tabulate(df, ["c"], "score", "tokens").collect()}
    assert rows["a"] == {"c": "a", "n": 1, "mean": 0.5, "sd": 0.0, "failures": 1, "tokens": 7, "tokens_per_task": 7.0} and rows["b"]["mean"] == 0.0 and rows["b"]["tokens_per_task"] == 0.0


def test_resolver(spark):
    rows = [
        (1, ["Marie Curie"], ["marie curie"], {"born": ["1867"]}, {"born": ["1867"]}, None),
        (2, ["Marie Curie"], ["marie curie"], {"born": ["1867"]}, {"born": ["1900"]}, None),
        (3, ["aaaa"], ["aaaa"], {"born": ["1"]}, {"born": ["1"]}, "different"),
        (4, ["Marie Curie"], ["Pierre Curie"], {}, {}, None),
    ]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>, ca map<string,array<string>>, cb map<string,array<string>>, judge string")
    got = {r["id"]: (r["decision"], r["route"]) for r in identity.resolve(df, "a", "b", "ca", "cb", "judge").collect()}
    assert got == {1: ("same", "agreement"), 2: ("same", "prefilter"), 3: ("different", "judge"), 4: ("unclear", "prefilter")}
    assert col(spark, identity.judged, '```json\n{"outcome": "same"}\n```', "{bad", '{"outcome": "no"}') == ["same", "unclear", "different"]


def test_graph_build(spark):
    e = spark.createDataFrame([("g", "a", "X"), ("g", "b", "X"), ("g", "c", "X")], "graph string, id string, class string")
    links = spark.createDataFrame([("g", "a", "p", "b"), ("g", "a", "q", "zz"), ("g", "a", "r", "a"), ("g", "b", "s", "a")], "graph string, source string, property string, target string")
    nodes, edges = graph.build(e, links)
    assert {(r["id"], r["kind"]) for r in nodes.collect()} == {("a", "entity"), ("b", "entity"), ("c", "entity"), ("zz", "missing")}
    assert {(r["property"], r["kind"]) for r in edges.collect()} == {("p", "link"), ("q", "dangling"), ("r", "self"), ("s", "link")}
    assert [r["id"] for r in graph.isolated(nodes, edges).collect()] == ["c"]
    assert {(r["property"], r["lane"]) for r in graph.spread(edges).collect()} == {("p", 1), ("q", 1), ("r", 1), ("s", 2)}


def test_fold_merges_conflicts_and_heals():
    g = graph.Fold()
    g.turn("s", 0, [{"key": "a", "class": "P", "label": "Ada", "data": {"born": ["1815"]}}], [("a", "knows", "ghost")])
    g = graph.Fold(g.state())
    g.turn("s", 1, [{"key": "x", "class": None, "label": "Ada", "data": {"born": ["1815"], "job": ["writer"]}}, {"key": "ghost", "class": "P", "data": {"born": ["1900"]}}], [])
    assert len(g.nodes) == 2 and not any(n["missing"] for n in g.nodes.values()) and len(g.edges) == 1
    g.turn("s", 2, [{"key": "y", "class": "P", "label": "Ada", "data": {"born": ["1815"], "name": ["Ada"], "job": ["x"]}}], [])
    assert len(g.nodes) == 3 or g.conflicts


def test_filters(spark):
    assert [r["fit"] for r in spark.createDataFrame([("Time-out 5", "a TIMEOUT5 b"), ("", "x"), ("y", "x")], "v string, t string").select(filters.grounded(F.col("v"), F.col("t")).alias("fit")).collect()] == [True, False, False]
    needles = spark.createDataFrame([(1, "abc"), (2, "ABC"), (3, "zz"), (4, None)], "k long, n string")
    texts = spark.createDataFrame([("xABCx abc",), ("none",), (None,)], "t string")
    assert {r["k"]: r["stated"] for r in filters.stated_counts(needles, "k", "n", texts, "t").collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_published_names_and_class_errors(spark):
    from ledgerloom.operators import conditions

    df = spark.createDataFrame([("A0-prose", True, False), ("catalog-flat-enforced-x", True, True), ("catalog-enforced", None, None), ("schema-dump-catalog-not-enforced", True, False)], "a string, d boolean, e boolean").coalesce(1)
    assert [r[0] for r in df.select(conditions.published_name(F.col("a"), F.col("d"), F.col("e"))).collect()] == ["no-catalog-not-enforced-prose", "schema-prose-full-catalog-flat-enforced-x-embedded", "schema-prose-catalog-enforced", "schema-dump-catalog-not-enforced"]
    for bad in ("catalog", "enforced", "catalog-enforcedly", None):
        with pytest.raises(Exception, match="no context and enforcement"):
            spark.createDataFrame([(bad,)], "a string").select(conditions.published_name(F.col("a"), F.lit(True), F.lit(True))).collect()
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("c", "d"), ("b", "d"), (None, "d")], "e string, p string")
    assert [tuple(r) for r in metrics.class_errors(rows, "e", "p", 2).collect()] == [("a", "b", 2), ("b", "d", 1)]


def test_seeded_samples_and_canonical_json(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 50:02}", i) for i in range(100)] + [(None, 1)], "k string, v long")
    drawn = {r["k"] for r in sampling.seeded_sample(df.repartition(7), "k", 3, 10).collect()}
    assert drawn == set(random.Random(3).sample(sorted(f"k{i:02}" for i in range(50)), 10)) and sampling.seeded_sample(df, "k", 3, 999).count() == 100
    monkeypatch.setattr(sampling, "MAX_DRAWN", 9)
    with pytest.raises(ValueError, match="over 9 keys"):
        sampling.seeded_sample(df, "k", 3, 1)
    assert spark.createDataFrame([(None, 1)], "b string, a int").select(text.canonical_json("b", "a")).first()[0] == '{"a":1,"b":null}'


def test_paired_test_is_exact_and_grows_slowly(spark):
    def exact(x, y):
        n, k = x + y, min(x, y)
        term = tail = math.comb(n, k)
        for i in range(k, 0, -1):
            term = term * i // (n - i + 1)
            tail += term
        return min(1.0, float(Fraction(2 * tail, 2**n)))

    def tested(x, y):
        rows = spark.range(x + y + 5).select((F.col("id") < x).alias("a"), ((F.col("id") >= x) & (F.col("id") < x + y)).alias("b"))
        return tuple(metrics.mcnemar(rows, "a", "b").first())

    for x, y in [(0, 0), (1, 0), (0, 5), (7, 7), (15, 2), (16, 31), (3, 60), (250, 200), (2000, 2090), (4900, 5200)]:
        assert tested(x, y) == (x, y, pytest.approx(exact(x, y), rel=1e-12))
    # a sum with three factorials for each term would take 10^11 steps; the normal approximation with its correction is within 1e-5 here
    z = (600_000 - 598_000 - 1) / math.sqrt(1_198_000)
    assert tested(598_000, 600_000)[2] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-5)
    assert tested(600_000, 600_000)[2] == 1.0 and tested(10_000, 600_000)[2] == 0.0
