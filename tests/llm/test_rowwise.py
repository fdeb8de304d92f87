"""Language ID, HTML, decontamination, URL filters, token counts and the piece codec: against brute force, and at the edges."""

import hashlib
import math
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from ledgerloom.llm import decontaminate as dc
from ledgerloom.llm import html_text as ht
from ledgerloom.llm import language_id as li
from ledgerloom.llm import piece_codec as pcodec
from ledgerloom.llm import pieces, token_counts, url_filters
from tests.conftest import DATA
from tests.oracle import connect, same

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = str(DATA / "sf0.001")
ODD = [None, "", " ", "  a  b ", "a\n\nb", "▁x", "日本語🙂", "\x00", "a" * 700 + " " + "ab" * 400, "\t x", "<s></s><0x41>", "🙂" * 300, "é é"]


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(tables):
    return [r[0] for r in tables.sql("SELECT text FROM documents ORDER BY doc_id").fetchall()]


# language ID


def brute_predict(model, text):
    """Word by word, in plain Python."""
    total, letters = [0.0] * len(model.langs), False
    for word in li.words_of(text or ""):
        letters = True
        rows = model.rows_of(word)
        for k in range(len(total)):
            total[k] += sum(model.scores[r][k] for r in rows) / len(rows) if rows else 0.0
    if not letters or not model.langs:
        return "und", 0.0
    best = max(range(len(total)), key=lambda k: (total[k], -k))
    return model.langs[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_language_id_held_out_accuracy_and_brute_force(spark, tables):
    rows = {r["doc_id"]: r for r in li.op1_language_id(spark, SF).collect()}
    truth = dict(tables.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    held = [i for i, r in rows.items() if r["held_out"] and i in truth]
    assert len(rows) == tables.sql("SELECT count(*) FROM documents").fetchall()[0][0] and len(held) > 20
    assert sum(rows[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.train(docs.where(~li.held_out()))
    for i, text in tables.sql("SELECT doc_id, text FROM documents LIMIT 25").fetchall():
        lang, score = brute_predict(model, text)
        assert rows[i]["lang_pred"] == lang and abs(rows[i]["score"] - score) < 1e-6


def test_language_id_backs_off_to_shorter_grams():
    from collections import Counter

    model = li.fit({0: {"en": Counter(the=9), "de": Counter(der=9)}, 3: {"en": Counter(["<th"] * 3), "de": Counter(["<de"] * 3)}, 1: {"en": Counter("t"), "de": Counter("d")}})
    assert model.rows_of("the") == [model.events[0]["the"]] and model.rows_of("thx") == [model.events[3]["<th"]]
    assert model.rows_of("xd") == [model.events[1]["d"]] and model.rows_of("qq") == []


def test_language_id_learns_rare_languages(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(3000)] + [(5000 + i, "der hund und die katze", "de") for i in range(3)] + [(None, "le chat et le chien", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = {r["lang"]: r["count"] for r in li.training_rows(docs, max_docs=200).groupBy("lang").count().collect()}
    assert taken["de"] == 3 and taken["fr"] == 1 and 120 < taken["en"] < 280
    model = li.train(docs, max_docs=200)
    assert [r["lang_pred"] for r in li.identify(docs.where("lang <> 'en'"), model).collect()] == ["de"] * 3 + ["fr"]
    assert li._shares({"a": 1486, "b": 6062, "c": 1508, "d": 944}, 8000) == dict.fromkeys("abcd", 0.8)
    many = li._shares({str(k): 10**6 for k in range(199)} | {"rare": 41}, 8000)
    assert many["rare"] == 40 / 41 and abs(many["0"] * 10**6 - 40) < 1


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 9), (2, "der hund und die katze", "de", 9), (None, None, None, 9), (4, "123 !!", "en", 9), (4, "", None, 9), (4, "the the", None, 9)], "doc_id long, text string, lang string, score int")
    model = li.train(docs)
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(docs, model).collect()]
    assert out[0][1] == "en" and out[1][1] == "de" and out[2] == (None, "und", 0.0) and out[3] == (4, "und", 0.0) and out[4] == (4, "und", 0.0) and out[5][1] == "en"
    assert li.identify(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    empty = li.train(docs.limit(0))
    assert empty.langs == [] and {r["lang_pred"] for r in li.identify(docs, empty).collect()} == {"und"} and li.identify(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([("the dog " * 100_000,)], "text string")
    assert li.identify(long, model).first()["lang_pred"] == "en"


def test_language_id_unseen_letters_numbers_and_marks(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = li.train(docs)
    texts = ["the cat 日本語", "日本語", "½ ² Ⅷ", "١٢٣ 12", "the ½ cat", "naïve", "nai\u0308ve", "\u0308 the", "X" * 200 + " the"]
    out = {r["k"]: (r["lang_pred"], r["score"]) for r in li.identify(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), model).collect()}
    for k, text in enumerate(texts):
        lang, score = brute_predict(model, text)
        assert out[k][0] == lang and abs(out[k][1] - score) < 1e-9, text
    assert out[0][0] == "en" and out[1] == ("de", 0.5) and out[2] == out[3] == ("und", 0.0) and out[4][0] == "en"
    assert li.words_of("nai\u0308ve Ab½c²") == ["nai\u0308ve", "ab", "c"]
    joined = li.words_in(["nai\u0308ve Ab½c²", "", "\u0308x", "y" * 130])
    assert [(int(o), "".join(map(chr, joined.codes[a : a + n]))) for a, n, o in zip(joined.start, joined.size, joined.owner, strict=True)] == [(0, "nai\u0308ve"), (0, "ab"), (0, "c"), (2, "x"), (3, "y" * 64), (3, "y" * 64), (3, "yy")]


def test_language_id_train_against_brute_force(spark, tables):
    from collections import Counter

    rows = tables.sql("SELECT doc_id, text, lang FROM documents WHERE doc_id < 120").fetchall() + [(-1, "a\nb  A", "xx"), (-2, None, "yy"), (-3, "c", None), (-4, "12", "zz")]
    counts = {n: {} for n in range(li.MAX_GRAM + 1)}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            for word in li.words_of(text):
                counts[0].setdefault(lang, Counter())[word] += 1
                for n in range(1, li.MAX_GRAM + 1):
                    counts[n].setdefault(lang, Counter()).update(li.grams_of(word, n))
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.langs == sorted(counts[0])
    for n, by_lang in counts.items():
        names = sorted({e for c in by_lang.values() for e in c})
        assert len(model.events[n]) == len(names)
        total = {x: sum(by_lang[x].values()) + li.ALPHA * len(names) for x in by_lang}
        for event in names[:: max(1, len(names) // 300)]:
            want = [math.log((by_lang[x][event] + li.ALPHA) / total[x]) for x in sorted(by_lang)]
            assert all(abs(a - b) < 1e-9 for a, b in zip(model.scores[model.events[n][event]], want, strict=True)), event


def test_language_id_knows_300_languages(spark):
    rng = random.Random(9)
    said = {f"l{k:03}": " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)) for k in range(300)}
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(sorted(said.items()))], "doc_id long, text string, lang string")
    model = li.train(docs, max_docs=400)
    assert len(model.langs) == 300
    assert all(r["lang"] == r["lang_pred"] and r["score"] > 0.9 for r in li.identify(docs, model).collect())
    few = li.train(docs, max_docs=100)
    assert 0 < len(few.langs) <= 300


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice"><p>We use cookies. Really, we do, and we like them.</p></div><div id="wrap"><article><h1>The &amp; title</h1><p>First para, with <b>bold</b> text,
and a line. It goes on.<br>Still first.<p>Second para has no end tag, but is long enough to count.<ul><li>One item<li>Two&nbsp;items</ul><div class="ad">Buy now, or else. Cheap, cheap!</div>
<script>if (a < b) { "</p>" }</script><p>Third &lt;para&gt; ends it all, with some more words, and more.</p><section class="comments"><p>Nice article, said a reader. Really nice, indeed, yes.</p></section></article>
<aside><p>Aside, which is a long and well pointed text, full of commas, and of stops. Yes.</p></aside></div><form><p>Name?</p></form><footer>&copy; x, y.</footer></body></html>"""


def test_html_blocks():
    assert ht.extract(PAGE) == "The & title\n\nFirst para, with bold text, and a line. It goes on. Still first.\n\nSecond para has no end tag, but is long enough to count.\n\nOne item\n\nTwo items\n\nThird <para> ends it all, with some more words, and more."


def test_html_without_an_article_element():
    page = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    assert ht.extract(page).startswith("The & title\n\nFirst para") and "Nice article" not in ht.extract(page) and "Aside" not in ht.extract(page)


SENTENCES = ["The first of the sentences is long enough, and it is well pointed, as prose is.", "Another one follows it, with as many words in it, and with commas, too.", "A third says little, but says it at some length, and then it ends."]


def test_html_without_an_article_element_keeps_all_of_the_prose():
    p = "".join(f"<p>{x}</p>" for x in SENTENCES)
    first, second = f"<section><h2>One</h2>{p * 3}</section>", f"<section><h2>Two</h2>{p}<ul><li>Item</ul></section>"
    text = "\n\n".join(["One", *SENTENCES * 3, "Two", *SENTENCES, "Item"])
    assert ht.extract(f"<body><nav>Menu</nav><main>{first}{second}</main><div>Imprint</div><footer>x</footer></body>") == text
    assert ht.extract(f"<body><div><a>Home</a> <a>Back</a></div><h1>Title</h1><div>{first}{second}</div><div>Imprint</div></body>") == "Title\n\n" + text
    assert ht.extract(f"<body><article>{p * 4}</article><article>{p}</article></body>") == "\n\n".join(SENTENCES * 5)


@pytest.mark.parametrize("around", ["<article class='post comments-open'>{}</article>", "<div class='has-sidebar'>{}</div>", "<form id=aspnet>{}</form>", "<div class='has-sidebar'><form><div>{}</div></form></div>"])
def test_html_names_and_forms_do_not_drop_the_prose(around):
    p = "".join(f"<p>{x}</p>" for x in SENTENCES)
    comments = "<div class='comments'><p>Nice article, said a reader, who had read it all, or so they said.</p></div>"
    own = f"<h1>Title</h1>{p * 3}"
    for page in (own, own + comments):
        got = ht.extract(f"<body><div>Skip to the text</div>{around.format(page)}<form><p>Your name?</p></form><div>Imprint</div></body>")
        assert got == "\n\n".join(["Title", *SENTENCES * 3])
    discussed = f"<body><main><section>{p}</section><section id='discussion'>{p}</section></main></body>"
    assert ht.extract(discussed) == "\n\n".join(SENTENCES * 2)
    assert "Nice" not in ht.extract(f"<body><article><h1>T</h1>{p}</article>{comments * 40}</body>")


PLAIN = "<body><div><div><a>Home</a></div><div><a>Sections</a></div><div><a>Contact</a></div></div><div>{0}</div><div><div>Read next</div><div><a>Some title</a></div><div><a>Another one</a></div></div><div>Imprint, 2020.</div></body>"


def test_html_paths_choose_without_telling_tags_or_names(monkeypatch):
    p = "".join(f"<p>{x}</p>" for x in SENTENCES)
    own = f"<h2>Head</h2>{p}<ul><li>Item</ul>{p}"
    text = "\n\n".join(["Head", *SENTENCES, "Item", *SENTENCES])
    pages = [PLAIN.format(own), PLAIN.format(f"<div><span>{own}</span></div>"), f"<table><tr><td><a>Menu</a><td>{own}<td><a>Side</a></table>"]
    assert [ht.extract(x) for x in pages] == [text] * 3
    monkeypatch.setattr(ht, "path_scores", lambda nodes: dict.fromkeys((x.element.path for x in nodes if x.size), 1.0))
    assert all(ht.extract(x) != text for x in pages)


def test_html_path_scores_against_brute_force():
    page = ht._Page("<div><a>Home</a><a>x</a></div><div><p>One, two. Three!</p><p>Four five.</p></div><div>six</div>")
    nodes, length, marked = page.nodes, {}, {}
    by_path = {}
    for x in nodes:
        by_path.setdefault(x.element.path, []).append(x.text)
    for path, texts in by_path.items():
        length[path] = sum(len("".join(t.split())) for t in texts) / len(texts)
        marked[path] = (1 + sum(t.count(c) for t in texts for c in ".,!")) / len(texts)

    def smooth(values, i):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 2), min(len(values), i + 3))}
        return sum(values[j] * w[j] for j in w) / sum(w.values())

    fused = [smooth([length[x.element.path] for x in nodes], i) * smooth([marked[x.element.path] for x in nodes], i) for i in range(len(nodes))]
    want = {}
    for path in by_path:
        own = [(r, x.size) for r, x in zip(fused, nodes, strict=True) if x.element.path == path]
        want[path] = min(sum(r * n for r, n in own) / sum(n for _, n in own), length[path] * marked[path])
    got = ht.path_scores(nodes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_html_heads_and_names_inside_an_article():
    p = "".join(f"<p>{x}</p>" for x in SENTENCES)
    for head in ("<header><h1>Title</h1></header>", '<div class="entry-header"><h1>Title</h1></div>', '<h1 class="banner">Title</h1>'):
        assert ht.extract(f"<body><header><h1>Site</h1></header><article>{head}{p}</article><div class=header>Site</div></body>") == "\n\n".join(["Title", *SENTENCES])


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep, text. " * 9, "<div>" * 20_000 + "<p>deep, text, with words.</p></x>" * 20_000, "<div class=ad>" * 20_000 + "<p>deep, text, with words.</b>" * 20_000, "<ul><li>" * 20_000 + "<li>deep, text." * 20_000, "<p>" + "<span>" * 20_000 + "deep, text.<hr>" * 20_000, '<a title="x>' * 20_001])
def test_html_takes_linear_time(page):
    import time

    def seconds(x):
        begun = time.process_time()
        ht.extract(x)
        return time.process_time() - begun

    assert seconds(page) < 15


def test_html_of_the_tables_is_the_article(tables):
    import html

    for page in [r[0] for r in tables.sql("SELECT html FROM pages").fetchall()]:
        inner = page[page.index("<article>") : page.index("</article>")]
        blocks = [html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1|article)>", inner)]
        assert ht.extract(page) == "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>unclosed", "x"), (4, "plain &amp; text", "x"), (5, "<script>x", "x"), (5, "<p>" + "word, " * 50_000, "x"), (6, "<div>" * 3000 + "deep, text." , "x")], "page_id long, html string, text string")
    out = {}
    for r in ht.extract_text(pages).collect():
        out.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert out[1] == out[2] == [("", 0)] and out[3] == [("unclosed", 8)] and out[4] == [("plain & text", 12)] and ("", 0) in out[5] and out[6] == [("deep, text.", 11)]
    assert ht.extract_text(pages.limit(0)).count() == 0 and ht.extract_text(pages).columns == ["page_id", "html", "text", "n_chars"]


# decontamination


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(10, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_sql(spark, tables):
    same(dc.op4_benchmark_decontamination(spark, SF), tables, dc.ORACLE_SQL)


@pytest.mark.parametrize("block", [dc.BLOCK_CHARS, 40])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(1)
    vocabulary = ["Alpha", "beta", "Gamma", "é", "x1", "delta"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 16)))) for i in range(12)] + [(3, "alpha"), (50, None), (51, "x1 ... é!"), (None, "delta x1 delta")]
    docs = [(i, (" ".join(rng.choice(vocabulary) for _ in range(40)) + ",\n" + (rng.choice(items)[1] or "").upper())) for i in range(30)] + [(98, None), (99, ""), (99, "")]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in dc.find_contamination(d, b, block_chars=block).collect())
    named = [("null" if i is None else i, t) for i, t in items]
    assert got == sorted((i, *brute_hits(t, named)) for i, t in docs)


def test_decontamination_spans_are_of_the_original(spark):
    text = "Say: ONE-two é THREE! end"
    row = dc.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "one two É three".replace("É", "é"))], "item_id long, text string")).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["ONE-two é THREE"]
    assert dc.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).first()["n_hit"] == 0


# URL filters


def test_url_filters_equal_sql(spark, tables):
    same(url_filters.op7_url_filters(spark, SF), tables, url_filters.ORACLE_SQL)


def brute_rule(rules, host, path):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)


def test_url_trie_join_and_brute_force(spark):
    rng = random.Random(7)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", ""], ["/", "/en/", "/en", "/e", "/en/x/", ""]
    rules = list({(h, p): url_filters.Rule(v, h, p) for h in hosts for p in paths for v in [rng.choice(("allow", "block"))] if rng.random() < 0.4}.values())
    urls = [f"{rng.choice(('http', 'HTTPS'))}://{rng.choice(('', 'W.', 'xa'))}{rng.choice(hosts[:5]).upper()}{rng.choice(('', '/', '/en', '/en/x/1', '/eng', '?q=/en/', '#f', '/en?x'))}" for _ in range(300)] + [None, "", "no scheme", "://", "http://", "a://b://c/en/", "http://a.com:80/en/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "k long, url string, rule string")
    got = {r["k"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df, rules).collect()}
    for i, u in enumerate(urls):
        host, path = url_filters.split_url(u)
        r = brute_rule(rules, host, path)
        assert got[i] == (host, path, r.label if r else None, r.verdict if r else "allow"), u
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    assert {r["k"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls_by_join(df, table).collect()} == got
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


# token counts and the codec


def test_counts_equal_the_unigram_library(texts):
    v = pieces.load(PIECES)
    hf = Tokenizer(models.Unigram([(x if isinstance(x, str) else f"<0x{x[0]:02X}>" if x else f"<c{i}>", v.scores.get(x, 0.0) if isinstance(x, str) else 0.0) for i, x in enumerate(v.names)], 0, True))
    count = token_counts.counter(PIECES)
    rng = random.Random(2)
    words = [t[:400] for t in texts[:80]] + [t for t in ODD if t and "\x00" not in t and "<" not in t] + ["".join(rng.choice("ab c▁éñß日🙂\n\t., e") for _ in range(rng.randint(1, 30))) for _ in range(800)]
    for t in words:
        assert count(t)[0] == len(hf.encode("▁" + t.replace(" ", "▁")).ids), t


def brute_best(v, word):
    """(score, pieces) by trying every split, the tokenizer's ties: an earlier start wins."""
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            part = word[s:e]
            step = (v.scores[part], 1) if part in v.scores else (v.least - 10, len(part.encode())) if e - s == 1 else None
            if step and best[s] and (best[e] is None or best[s][0] + step[0] > best[e][0]):
                best[e] = (best[s][0] + step[0], best[s][1] + step[1])
    return best[-1]


def test_counts_against_brute_force_and_edges(spark):
    v, count = pieces.load(PIECES), token_counts.counter(PIECES)
    for w in ("the", "retitioning", "日本", "zzzz", "aaaaaaa", "Über", "\x00"):
        score, n = brute_best(v, "▁" + w)
        assert count(w) == (n, score)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, score int")
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, PIECES).collect()}
    assert out[0] == out[1] == 0 and len(out) == len(ODD) and all(out[i] > 0 for i in range(2, len(ODD)))


def test_models_that_normalise_are_refused(monkeypatch):
    real = sentencepiece.SentencePieceProcessor

    class Folding(real):
        def encode(self, text, *a, **k):
            return super().encode(text.lower() if isinstance(text, str) else text, *a, **k)

    pieces.load.cache_clear()
    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="normalises"):
        pieces.load(PIECES)
    monkeypatch.undo()
    pieces.load.cache_clear()
    assert len(pieces.load(PIECES).names) == 32_000


def test_codec_long_segments_and_models_without_byte_pieces(monkeypatch):
    import dataclasses

    v = pieces.load(PIECES)
    whole = pcodec.Codec(v)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdeinrst") for _ in range(6000))
    monkeypatch.setattr(pcodec, "SPAN", 2048)
    monkeypatch.setattr(pcodec, "INDEX_BYTES", 1024)
    parted = pcodec.Codec(v)
    assert parted.encode(long).tolist() == whole.encode(long).tolist() and parted.encode("ab " * 900).tolist() == whole.encode("ab " * 900).tolist()
    monkeypatch.undo()
    bare = pcodec.Codec(dataclasses.replace(v, byte_ids=None))
    assert bare.encode("a \ue123\ue124é\ue125 b").tolist().count(v.unknown) == 2


def test_codec_equals_the_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = pcodec.codec(PIECES)
    rng = random.Random(3)
    every = texts[:60] + [t for t in ODD if t is not None] + ["".join(rng.choice("ab c▁éñß日🙂\n\t.,<0x41>  ") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t, ids in zip(every, codec.encode_all(every), strict=True):
        assert ids.tolist() == sp.encode(t), t
        assert codec.decode(ids.tolist()) == t.replace("▁", " ") == sp.decode(sp.encode(t))


def test_codec_small_memory_and_edges(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(pcodec, "CACHE_WORDS", 3)
    monkeypatch.setattr(pcodec, "INDEX_BYTES", 16)
    small = pcodec.Codec(pieces.load(PIECES))
    many = ["one two three four five six", "six five " * 9, "abcdefgh" * 80]
    assert [x.tolist() for x in small.encode_all(many)] == [sp.encode(t) for t in many]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(ODD)], "doc_id long, text string, ids array<int>")
    rows = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pcodec.decode(pcodec.encode(df, PIECES), PIECES).collect()}
    assert rows == {i: (sp.encode(t or ""), (t or "").replace("▁", " ")) for i, t in enumerate(ODD)}
    assert pcodec.op9_sentencepiece(spark, SF).count() == 200 and pcodec.encode(df.limit(0), PIECES).count() == 0


def test_op9_digests(spark, tables):
    import zlib

    import numpy as np

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"], r["decoded_sha256"]) for r in pcodec.op9_sentencepiece(spark, SF).collect()}
    for i, t in tables.sql("SELECT doc_id, text FROM documents").fetchall():
        ids = sp.encode(t)
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest())
