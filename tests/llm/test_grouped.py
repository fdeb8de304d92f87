"""Chat packs, fingerprints, near-duplicates, token files and the pipeline: against brute force, SQL and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import chat_format as cf
from ledgerloom.llm import common, merkle, near_dedup, registry, simple8b, token_files
from tests.conftest import DATA
from tests.oracle import connect, same

SF = str(DATA / "sf0.001")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_registry():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


# chat


def test_chat_equals_sql(spark, tables):
    same(cf.op3_chat_format(spark, SF), tables, cf.ORACLE_SQL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a:\\#<>/ \n</turn>é", max_size=12), st.text(alphabet="a:\\#<>/ \n</turn>é###", max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    assert cf.parse("".join(cf.header(r) + cf.escape(t) + cf.END for r, t in turns)) == turns


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "less"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (5, None, None, None), (6, 0, "user", "### x</turn>\n"), (6, 0, "user", "### x</turn>\n"), (None, 0, "user", "lost"), (7, 0, "assistant", "long " * 5000),
]


@pytest.mark.parametrize("size", [cf.PACK_TOKENS, 4])
def test_packs_share_prefixes_and_read_back(spark, size):
    rows = [(*r, "extra") for r in CONVERSATIONS]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string").coalesce(1)
    packs = cf.pack_conversations(df, BPE, size)
    held = packs.collect()
    want = {}
    for c in {r[0] for r in CONVERSATIONS}:
        own = sorted((r for r in CONVERSATIONS if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[c] = ("".join(cf.header(r[2] or "") + cf.escape(r[3] or "") + cf.END for r in own), [cf.escape(r[3]) for r in own if r[2] == "assistant"])
    assert {r["conv_id"]: (r["formatted"], list(r["loss"])) for r in cf.read_packs(packs, BPE).collect()} == want
    for p in held:
        for n in p["nodes"]:
            length = n["end"] - n["start"]
            assert list(p["positions"][n["start"] : n["end"]]) == list(range(n["position"], n["position"] + length))
            assert sum(a["end"] - a["start"] for a in n["attends"]) == n["position"] and all(a["end"] <= n["start"] for a in n["attends"])
    if size == cf.PACK_TOKENS and len([p for p in held if any(c["conv_id"] in (1, 2, 3, 4) for c in p["conversations"])]) == 1:
        pack = next(p for p in held if any(c["conv_id"] == 1 for c in p["conversations"]))
        assert sum(n["parent"] == -1 for n in pack["nodes"]) <= len({c["conv_id"] for c in pack["conversations"]}) - 3
    assert cf.pack_conversations(df.limit(0), BPE).count() == 0


# fingerprints


def test_fingerprints_equal_sql(spark, tables):
    same(merkle.op6_document_fingerprints(spark, SF), tables, merkle.ORACLE_SQL)


def test_fingerprint_edges(spark):
    rows = [(3, "One. Two!\nThree\n\nFour", 1), (1, None, 1), (2, "", 1), (None, "x", 1), (5, "One. Two!\nThree\n\nFour", 1), (5, "long, " * 30_000, 1)]
    out = merkle.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    prints = {}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(ordered):
        n, nxt = len(t), ordered[(k + 1) % len(ordered)][1]
        edited = t[: n - n // 4] + nxt[: n // 4]
        row = next(r for r in out if r["doc_id"] == i and r["n_chars"] == n)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert (row["fingerprint"] == row["edited_fingerprint"]) == (edited == t)
        assert prints.setdefault(t, row["fingerprint"]) == row["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    assert merkle.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = merkle.fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()


def test_differing_branches_locate_edits(spark):
    df = spark.createDataFrame([("A one.\nB two.\n\nC three.\nD four.", "A one.\nB two.\n\nC three!\nD four.")], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb").select(merkle.differing_paragraphs("fa", "fb").alias("d"))
    assert [(x["section"], x["paragraph"]) for x in df.first()["d"]] == [(1, 0)]


# near-duplicates


def brute_components(docs, percent):
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_docs(seed, count=160):
    """Chains and groups of near copies, texts that share a passage, and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(40)]
    out = []
    while len(out) < count:
        base = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.4:
            base = base[:40] + passage
        for _ in range(rng.randint(1, 10)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.5:
                base = copy
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " \n".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize(("percent", "small"), [(85, False), (80, True)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, percent, small):
    if small:
        monkeypatch.setattr(near_dedup, "BLOCK_NODES", 3)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
        monkeypatch.setattr(near_dedup, "STRIP", 2)
    docs = near_docs(percent)
    df = spark.createDataFrame([(i * 7, t, 1) for i, t in docs], "doc_id long, text string, component_id int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, percent).collect()}
    assert got == brute_components([(i * 7, t) for i, t in docs], percent)


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, long), (8, long + " x"), (None, "a b"), (9, "a b"), (9, "a b")]
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 29_996, 7, True), (8, 29_997, 7, False), (9, 1, 4, False), (9, 1, 4, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_equal_sql(spark, tables):
    same(near_dedup.op8_minhash_near_dedup(spark, SF), tables, near_dedup.ORACLE_SQL)


def test_rows_of_a_large_family_are_copied_in_proportion(spark):
    from pyspark.sql import functions as F

    def copies(rest, size):
        rows = spark.range(size).select(F.lit(1).alias("bucket"), F.col("id").alias("node"), F.lit(size).alias("total"), F.lit(rest).alias("rest_total"), (F.col("id") < rest).alias("rest"))
        dealt = near_dedup._dealt(rows, "one", 4096)
        blocks = dealt.groupBy("x", "y").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        return dealt.count(), blocks

    assert copies(10, 20_000)[0] == 19_990 + 10 * 6 and copies(10, 40_000)[0] == 39_990 + 10 * 11 and copies(0, 20_000)[0] == 0
    everything, largest = copies(20_000, 20_000)
    assert everything == 20_000 * 5 and largest < 3 * 4096


def test_a_large_family_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2000)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base, f"x{i}"])) for i in range(400)] + [(1000 + i, " ".join([*base[:30], *(f"y{i}a{j}" for j in range(40))])) for i in range(40)]
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85).collect()}
    assert all(out[i] == 0 for i in range(400)) and all(out[1000 + i] == 1000 + i for i in range(40))


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    for share in (0.8, 0.9, 0.97):
        common = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / (2 * share))
        a, b = (np.unique(np.append(common, rng.integers(0, 1 << 63, n, dtype=np.uint64))) for _ in "ab")
        differing = int(np.bitwise_count(near_dedup.sketch_of(near_dedup.samples_of(a)) ^ near_dedup.sketch_of(near_dedup.samples_of(b))).sum())
        assert abs(near_dedup.sketch_similarity(differing) - share) < 0.15 and differing <= near_dedup.sketch_limit(int(share * 100))


# token files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.sampled_from([0, 1, 2**60 - 1, 2**60]), max_size=400), st.sampled_from([7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    words, exceptions, n_words, n_exceptions = simple8b.encode(np.array(ids, np.uint64), block)
    assert simple8b.decode(words, exceptions, n_words, n_exceptions).tolist() == ids and n_words.sum() == len(words)


def test_simple8b_packs_greedily():
    words, *_ = simple8b.encode(np.array([1] * 60 + [70_000] * 3, np.uint64))
    assert len(words) == 2 and simple8b.encode(np.zeros(0, np.uint64))[0].size == 0


def test_token_file_and_block_reads(tmp_path):
    docs = [(5, np.arange(3000, dtype="<u4")), (None, np.empty(0, "<u4")), (9, np.array([2**31, 0], "<u4"))]
    path = f"file://{tmp_path}/t.s8b"
    token_files.write_file(path, docs)
    ids, held = token_files.read_file(path)
    assert held == [(5, 3000), (None, 0), (9, 2)] and ids.tolist() == [*range(3000), 2**31, 0]
    assert token_files.read_block(path, 1).tolist() == list(range(1024, 2048))


def test_byte_bpe_equals_the_library(tables):
    reference = Tokenizer.from_file(BPE)
    reference.encode_special_tokens = True
    bpe, rng = token_files.ByteBpe(BPE), random.Random(4)
    every = [r[0] for r in tables.sql("SELECT text FROM documents LIMIT 60").fetchall()] + ["".join(rng.choice("ab c's 've1 2,.\n\n\t\xa0 éß日🙂 \x1c\x00\x01\x02<|endoftext|>") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    for t in every:
        ids = bpe.encode(t).tolist()
        assert ids == reference.encode(t, add_special_tokens=False).ids, t
        assert bpe.decode(np.array(ids)) == t


@pytest.mark.parametrize("small", [False, True])
def test_token_files_hold_the_library_ids(spark, tables, monkeypatch, small):
    if small:
        monkeypatch.setattr(token_files, "FILE_IDS", 1000)
    reference = Tokenizer.from_file(BPE)
    reference.encode_special_tokens = True
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op10_token_binary(spark, SF).collect()}
    at = 0
    for i, t in tables.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*reference.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_edges(spark):
    scratch = common.Scratch(spark)

    def starts(rows):
        df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
        files = scratch.keep(token_files.write_token_files(df, f"{common.shared_dir(spark)}/t", BPE), f"m{len(rows)}")
        return sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(files, token_files.crc_of, "ids_crc32 long").collect())

    assert starts([]) == []
    assert starts([(2, ""), (None, None), (1, "a"), (2, None), (3, "a " * 40_000 + "b")]) == [(0, None, 1), (1, 1, 2), (3, 2, 1), (4, 2, 1), (5, 3, 40_002)]
