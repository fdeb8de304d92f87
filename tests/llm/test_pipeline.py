"""The pipeline against a brute-force one, stage by stage."""

import random
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerloom.llm import language_id
from tests.conftest import DATA
from tests.llm.test_grouped import brute_components
from tests.llm.test_rowwise import brute_hits, brute_predict
from tests.oracle import connect

SF = str(DATA / "sf0.001")


def test_pipeline_against_brute_force(spark):
    tables = connect(SF)
    docs = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    items = tables.sql("SELECT item_id, text FROM benchmark").fetchall()
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = {i: t for i, t in docs.items() if (lambda p: p[0] != "und" and p[1] >= cp.MIN_SCORE)(brute_predict(model, t))}
    kept = {i: kept[i] for i, (_, _, first) in brute_components(list(kept.items()), cp.PERCENT).items() if first}
    kept = {i: t for i, t in kept.items() if not brute_hits(t, items)[1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in cp.run(spark, SF).collect()}
    assert got == {i: (sp.encode(t), len(sp.encode(t))) for i, t in kept.items()} and 0 < len(got) < len(docs)


def test_stages_keep_the_columns_and_survive_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [re.sub("_", " ", n) for n, _ in cp.STAGES] == ["language id", "near dedup", "decontamination", "sentencepiece"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == cp.STAGES[-1][0] or out.schema == docs.schema)
    odd = spark.createDataFrame([(None, "the text without an id", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "the end of it", "en", "s", 3), (2, "the end of it", "en", "s", 3)], docs.schema)
    for _, stage in cp.STAGES[:3]:
        odd = stage(spark, odd, SF)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in odd.collect()) == [(0, "the text without an id"), (2, "the end of it")]


FOREIGN = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "qwpx zvkj hgfd wqzx mnbv plkj xcvz tgbr qazw sxed crfv tgby hnuj miko lpqa zwsx edcr fvtg byhn ujmi kolp qwzx",
]


def test_languages_that_are_not_learned_are_dropped(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    foreign = spark.createDataFrame([(-1 - i, t * 5, None, "s", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r["doc_id"] for r in cp.languages(spark, docs.unionByName(foreign), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_the_language_model_learns_from_all_labelled_rows(spark):
    count = language_id.TRAIN_DOCS + 1_000
    text = lambda i: (lambda rng: " ".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3)) for _ in range(20)))(random.Random(i))
    docs = spark.createDataFrame([(i, text(i), "zh", "s", 79) for i in range(count)], "doc_id long, text string, lang string, source string, n_chars long")
    twins = docs.where("doc_id % 100 = 0").withColumns({"doc_id": -1 - F.col("doc_id"), "lang": F.lit(None).cast("string")})
    strange = spark.createDataFrame([(count, text(count), None, "s", 79)], docs.schema)
    kept = {r["doc_id"] for r in cp.languages(spark, docs.unionByName(twins).unionByName(strange), "").select("doc_id").collect()}
    assert kept == {*range(count), *range(-1, -1 - count, -100)}
    model = language_id.train(docs.where("doc_id < 30"), max_docs=None)
    mixed = docs.where("doc_id < 50 or doc_id >= 200 and doc_id < 4000")
    assert cp.known_bounds(mixed, model) == {"zh": 0.0} and cp.known_bounds(docs.where("doc_id < 30"), model) == {}


def test_near_duplicates_keeps_different_texts_of_one_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, a + " x"), (2, b), (2, c), (2, c), (None, c), (None, d), (None, d + " x"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert len([r for r in got if r[0] is None and r[1] in (d, d + " x")]) == 1
    assert sorted((r for r in got if r[1] not in (d, d + " x")), key=str) == sorted([(1, a), (2, b), (2, c), (None, None), (3, "")], key=str)


def test_stages_leave_columns_with_the_operators_names_alone(spark):
    clash = "score lang_pred n_hit items runs spans _grams _known _node n_words".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    for c in clash:
        docs = docs.withColumn(c, F.concat(F.lit(c), "doc_id"))
    docs = docs.drop("score").withColumn("score", F.col("doc_id") * 2)
    for _, stage in cp.STAGES[:3]:
        kept = stage(spark, docs, SF)
        assert kept.schema == docs.schema
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in clash if c != "score") and all(r["score"] == 2 * r["doc_id"] for r in rows)
