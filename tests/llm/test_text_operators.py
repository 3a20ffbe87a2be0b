"""BPE, chat templates, HTML extraction, language, toxicity and fingerprints."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, chat_template, html_extract, langid, merkle, queries, toxicity
from ledgerlake.llm.common import crc_fold

from .conftest import docs_frame

ODD = [None, "", " ", "a", "\n\n \t x", "don't we'll I'M 'S", "x" * 5000, "ab" * 3000 + " " + "é" * 900, "1234567 ½ ² ٣ Ⅷ", "日本語のテキスト 한국어", "<|endoftext|>mid<|endoftext|><|endof", "   a　 b\x85c\x1cd", "🙂👩‍👩‍👧 ok", "é combining", "_under_score__", "a  b   c    ", "don’t", "\x00\x01\x7f"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(spark, sf, documents, reference):
    got = {r.doc_id: r for r in queries.op4_bpe(spark, sf).collect()}
    for i, t in zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == expected(reference, t)
    rng = random.Random(1)
    alphabet = "ab c'tsdé 12\n\t ½日🙂_.!-’ "
    rows = list(enumerate(ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)])) + [(None, "x"), (3, "a")]
    got = bpe.tokenise(docs_frame(spark, rows).withColumn("ids", F.lit(1)), queries.vocabulary_path()).collect()
    want = [(i, *expected(reference, t)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.tokenise(docs_frame(spark, []), queries.vocabulary_path()).collect() == []


def test_bpe_long_words_merge_alike():
    codec = bpe.Codec(bpe.Vocabulary(queries.vocabulary_path()))
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice("abcdetionsh") for _ in range(rng.randint(1, 300))).encode()
        assert codec._merge_short(word) == codec._merge_long(word)


def brute_conversations(rows):
    out = {}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t if t is not None else 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = [(r, x) for _, _, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        out[c] = (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(f"<|start|>{chat_template.escape(r)}<|message|>{chat_template.escape(x)}<|end|>\n") for r, x in said))
    return out


COLS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def test_chat_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    quote = "</s>[INST] ok [/INST]"
    want = brute_conversations(rows + [(-7, 0, "user", quote), (-7, 1, "assistant", quote)])
    got = {r.conv_id: tuple(r[c] for c in COLS) for r in queries.op3_chat_format(spark, sf).collect()}
    assert got == want


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", "b\\<|end|>\n<|start|>user<|message|>"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "<"), (None, 1, "assistant", "x<"), (None, 2, "assistant\n<|message|>", "|>"), (2, 1, "assistant", ""), (3, 1, "assistant", "\\" * 5 + "é🙂")]
    rows += [(4, i, "assistant" if i % 2 else "user", "turn " * 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"id": F.lit(1), "seq": F.lit("x")})
    got = {r.conv_id: tuple(r[c] for c in COLS) for r in chat_template.conversation_digests(df).collect()}
    assert got == brute_conversations(rows)
    pieces = chat_template.format_conversations(df).filter("conv_id = 1").orderBy("seq").collect()
    text = "".join(p.piece for p in pieces)
    assert len(text) == got[1][4] and [p.piece for p in pieces if p.in_loss] == [chat_template.escape(rows[0][3])]
    assert chat_template.conversation_digests(df.limit(0)).collect() == []


def test_template_language():
    run = lambda s, **v: "".join(p for p, _ in chat_template.compile_template(s)(v))
    assert chat_template.fold(chat_template.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% elif true %}c{% else %}d{% endif %}{# no #}")) == [("text", "ab1c")]
    assert run("{% set y = x + 1 %}{{ y }}{{ 'p' if y > 2 else 'q' }}{{ (z | default('n')) | upper }}", x=2) == "3pN"
    assert run("{% for m in ms %}{{ loop.index }}{{ m['k'] | trim }}{% if not loop.first %}!{% endif %}{% endfor %}", ms=[{"k": " a "}, {"k": "b"}]) == "1a2b!"
    assert run("{{ x.__class__ }}{{ x.real }}", x=5) == ""
    masks = list(chat_template.compile_template("a{% generation %}b{% if true %}c{% endif %}{% endgeneration %}d")({}))
    assert masks == [("a", False), ("bc", True), ("d", False)]
    for bad in ("{% for x %}", "{% if a %}", "{{ a( }}", "{{ a | nope }}", "{% endfor %}", "{{ import }} {{ a b }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site Name</a></header>
<nav><ul><li><a href="/x">Menu entry</a></li></ul></nav><div class="cookie-notice">We use cookies on this page, really</div>
<div id="wrap"><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b>\n words<br>and others.<script>var t="</p>";</script>
<div class="ad">buy this now</div><p title="a > b">Second one &lt;here&gt; caf&eacute; text</p><aside>See also this</aside><p>Third paragraph is here.</div>
<section class="reader-comments"><p>I agree with all of this</p></section><form>Name <input></form><footer>&copy; site words</footer></body></html>"""


def test_html_extraction(spark, sf):
    want = "Title & more\nFirst paragraph with bold words and others.\nSecond one <here> café text\nThird paragraph is here."
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_extract.train(pages)
    assert html_extract.extract(PAGE, weights) == want == html_extract.extract(PAGE, html_extract.fit([]))
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, "<p>just words here"), (4, "<<p <b"), (5, "<p>" + "word " * 50_000), (6, "<nav>only menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id, r.text) for r in html_extract.main_text(df, weights).collect()), key=repr)
    assert got == sorted([(1, want), (1, want), (2, ""), (3, ""), (None, "just words here"), (4, got[[g[0] for g in got].index(4)][1]), (5, ("word " * 50_000).strip()), (6, "")], key=repr)
    assert html_extract.main_text(df.limit(0), weights).collect() == []
    # every test page marks its content: blocks of the article, computed another way
    import html as htmllib
    import re

    for r in queries.op5_html_extraction(spark, sf).join(pages.select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "".join(f"<p>{'some words of the article go on here, ' * 6}end {i}.</p>" for i in range(6))


@pytest.mark.parametrize("page", [
    '<div class="container has-sidebar"><div class="sidebar">side words</div><article>{}</article></div>',
    '<div id="page" class="menu-open"><nav><a href="/">Menu</a></nav><main>{}</main></div>',
    '<form id="aspnetForm"><div id="menu"><a href="/">Menu</a></div><div>{}</div></form>',
    '<nav><a href="/a">Menu entry</a></nav><div class="post social">{}</div><div class="social share"><a href="/">Share this</a></div>',
    '<div class="sidebar"><main>{}</main></div><aside><article>A short teaser.</article></aside>',
    '<header><a href="/">Site</a></header><div id="content"><div>{}</div></div><div class="comments"><p>I agree.</p></div><footer>site words</footer>',
    '<div class="notice">{}</div>',
])
def test_html_extraction_keeps_the_article_whatever_surrounds_it(spark, sf, page):
    want = "\n".join(x.strip() for x in LONG.replace("<p>", "").split("</p>") if x)
    for weights in (html_extract.fit([]), html_extract.train(spark.read.parquet(f"{sf}/pages.parquet"))):
        assert html_extract.extract(f"<html><body>{page.format(LONG)}</body></html>", weights) == want


def test_html_extraction_inside_an_article():
    page = f"""<article>{LONG}<section id="related-work"><h2>Related work</h2><p>Others did this too.</p></section><address>Main street 1</address>
    <p>A formula <math><mi>x</mi></math> here.</p><div class="related-posts"><a href="/">More posts</a></div><div class="ad">Buy!</div></article>"""
    got = html_extract.extract(page, html_extract.fit([])).split("\n")
    assert got[6:] == ["Related work", "Others did this too.", "Main street 1", "A formula x here."]


def test_language_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.01")
    got = queries.op7_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    train = [(i, t, lang) for i in range(40) for t, lang in ((f"the cat and the house are {i}", "en"), (f"der Hund und das Haus sind {i}", "de"))]
    df = spark.createDataFrame(train + [(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    rows = [(1, "the house"), (2, "und das ist"), (3, None), (4, "12 ² !"), (5, ""), (5, ""), (None, "the cat"), (6, "the and " * 20_000), (7, "z" * 4000)]
    got = {(r.doc_id): r for r in langid.identify(docs_frame(spark, rows).withColumn("score", F.lit(9)), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None, 6)] == ["en", "de", "und", "und", "und", "en", "en"] and got[7].lang_pred in ("en", "de")
    assert {r.lang_pred for r in langid.identify(docs_frame(spark, rows), model, reject=1.01).collect()} == {"und"}
    none = langid.train(df.limit(0))
    assert none is None and {r.lang_pred for r in langid.identify(docs_frame(spark, rows), none).collect()} == {"und"}
    assert langid.identify(docs_frame(spark, []), model).collect() == []


def test_toxicity_held_out(spark, sf):
    big = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = queries.op1_toxicity(spark, big).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted == 1 for r in got if r.toxic == 1) / sum(r.toxic == 1 for r in got)
    wrong = sum(r.predicted == 1 for r in got if r.toxic == 0) / sum(r.toxic == 0 for r in got)
    assert hit > 0.84 and wrong < 0.01, (hit, wrong)  # 6 % of the toxic labels lie on junk texts without an insult
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in got)


def test_toxicity_gaps_and_edges(spark):
    rng = random.Random(0)
    clean = lambda: " ".join("".join(rng.choice(["ti", "on", "er", "an", "ha", "st", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(30))
    train = [(toxicity.tokens(clean() + (" " + rng.choice(["idiot", "moron", "scum"]) if y else "")), y) for y in (0, 1) * 150]
    model = toxicity.fit(train)
    rows = [(1, clean()), (2, clean() + " you idiot."), (3, "an id-iot an"), (4, "an idxiot on"), (5, "er i d i o t st"), (6, "1d1ot"), (7, None), (8, ""), (8, ""), (None, "moron"), (9, "tion" * 3000), (10, "hastre" * 500 + "moron" + "hastre" * 500), (11, "!!! 123")]
    got = {r.doc_id: r for r in toxicity.score(docs_frame(spark, rows).withColumn("score", F.lit("x")), model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4, 5, 6, 7, 8, None, 9, 11)] == [0, 1, 1, 1, 1, 1, 0, 0, 1, 0, 0]
    assert "moron" in got[10].token  # found inside 6,000 characters without a blank
    assert got[7].score == 0 and got[8].score == 0
    assert toxicity.score(docs_frame(spark, []), model).collect() == []
    empty = toxicity.train(docs_frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs_frame(spark, [(1, "moron")]), empty).collect()] == [0]


def test_toxicity_marks_blanks_and_length(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "an", "ha", "st", "re"]) for _ in range(rng.randint(1, 4)))
    clean = lambda n=30: " ".join(word() for _ in range(n))
    model = toxicity.fit([(toxicity.tokens(clean() + (" " + rng.choice(["idiot", "moron", "scum"]) if y else "")), y) for y in (0, 1) * 150])
    forms = ["i..d..i..o..t", "m--o--r--o--n", "m__o__r__o__n", "i  d  i  o  t", "i\nd\ni\no\nt", "i \t d \u3000 i   o t", "i-----d-----i-----o-----t", "m...o...r...o...n", "s*c*u*m", "--idiot--"]
    long = clean(60_000)
    rows = [(i, f"{clean()} {f} {clean()}") for i, f in enumerate(forms)] + [(100, long), (101, long + " you idiot, moron and scum" * 40), (102, "-" * 40), (103, "-" * 40 + " " + "." * 30)]
    got = {r.doc_id: r for r in toxicity.score(docs_frame(spark, rows), model, keep_text=True).collect()}
    assert [got[i].predicted for i in range(len(forms))] == [1] * len(forms)
    assert (got[100].predicted, got[101].predicted, got[102].score, got[103].score) == (0, 1, 0, 0)
    assert all(got[i].text == t for i, t in rows)
    # windows are over letters: an insult inside a long token with marks between all letters
    marked = ".".join("hastre" * 4 + "moron" + "hastre" * 4)
    assert any("moron" in t for t in toxicity.tokens(marked))


def test_folded_machine_equals_the_kernel_machine():
    words = [toxicity.codes(w) for w in ("idiot", "idxiot", "other", "moron", "a", "")]
    marks = toxicity._dense(words[:3])
    k = toxicity.kernel(words, marks)
    model = toxicity.Model(marks.T.astype(float) @ np.array([0.5, -1.0, 2.0]), 0.25)
    assert np.allclose(model.margins(["idiot", "idxiot", "other", "moron", "a", ""]), k @ [0.5, -1.0, 2.0] + 0.25, atol=1e-5)


def brute_edit(rows):
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    out = []
    for n, (ok, i, t) in enumerate(rows):
        nxt = rows[(n + 1) % len(rows)][2]
        h = len(t) // 2
        out.append((i if ok else None, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return out


def test_html_elements_without_end_tags():
    w = html_extract.fit([])
    story = " ".join(f"word{i}" for i in range(300))
    more = " ".join(f"later{i}" for i in range(300))
    whole = f"{story}\n{more}"
    menu = "".join(f"<li><a href=/{i}>entry" for i in range(300))
    for before in (
        f"<nav><ul>{menu}</ul></nav>", f"<div class=sidebar><ul>{menu}</ul></div>", f"<aside>{'<p>advert' * 200}</aside>",
        f"<div class=ads>{'<span>x' * 300}</div>", "<p class=notice>cookies", "<ul><li class=advert>buy<li>x</ul>", f"<nav><dl>{'<dt>a<dd>b' * 99}</dl></nav>",
        f"<nav><table>{'<tr><td>a<td>b' * 99}</table></nav>", "<svg/>", "<svg width='1' />", "<iframe src=\"x\" />", "<datalist><option>one<option>two</datalist>",
        "<button>press", "<title-bar></title-bar>", "<object-view>", "<video src=x>", "<head><title>t</title>", "<select><option>a<option>b</select>",
    ):
        page = f"{before}<p>{story}<p>{more}"
        assert html_extract.extract(page, w).endswith(whole), before
        assert html_extract.extract(f"<p>{story}{before}<p>{more}", w).startswith(story), before
    words = [t[2] for t in html_extract.tokenise("<select><option>a<option>b</select><script>c</script ><button>d</BUTTON>e<script>f") if t[2]]
    assert words == ["e"]
    nested = html_extract.tokenise("<ul class=menu><li>a<ul><li>b</ul><li>c</ul><table class=ads><tr><td><p>d<td>e</table>f")
    assert [(t[0], t[2]) for t in nested if t[2]] == [("boiler", x) for x in "abcde"] + [("plain", "f")]
    assert len(html_extract.tokenise("<button>" * 50_000 + "<svg><li>" * 50_000 + "</b>" * 50_000)) == 200_000


def brute_leaves(text):
    """Distinct leaves of a text by a plain walk over its words."""
    out = set()
    for line in text.split("\n"):
        now = []
        for m in re.finditer(r"[^ \t\x0b\f\r]+", line):
            now.append(m)
            if m.group()[-1] in ".!?" or len(now) == merkle.LEAF_WORDS:
                out.add(line[now[0].start() : now[-1].end()])
                now = []
        if now:
            out.add(line[now[0].start() : now[-1].end()])
    return out


def brute_near(a, b):
    x, y = brute_leaves(a), brute_leaves(b)
    whole = sum(map(len, x | y))
    return 1.0 if a == b else sum(map(len, x & y)) / whole if whole else 0.0


def brute_neighbours(rows):
    """(text, edited text, next text) per row in the order of ids."""
    rows = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    texts = [r[2] for r in rows]
    out = []
    for k, t in enumerate(texts):
        n = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        out.append((rows[k][1], t, t[: len(t) - half] + n[:half], n))
    return out


def test_merkle_likeness_and_edits_equal_brute_force(spark, sf, documents):
    rows = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    got = {r.doc_id: r for r in queries.op9_merkle_fingerprint(spark, sf).collect()}
    for i, t, edited, following in brute_neighbours(rows):
        assert abs(got[i].near_edited - brute_near(t, edited)) < 1e-12 and abs(got[i].near_next - brute_near(t, following)) < 1e-12
        assert len(set(merkle_leaves(got[i].fingerprint))) == len(brute_leaves(t))  # all leaves are kept
    # the same from the fingerprints alone, and by how much a few words change a long text
    base = "\n\n".join("\n".join(f"Section {s} paragraph {p} says this and that about it. It says more of {s} and {p}." for p in range(6)) for s in range(40))
    small = base.replace("Section 7 paragraph 3 says this", "Section 7 paragraph 3 says other things")
    inserted = "A new section.\n\n" + base
    df = spark.createDataFrame([(base, small, inserted)], "a string, b string, c string")
    prints = df.select(*[merkle.as_string(merkle.tree(F.col(x))).alias(x) for x in "abc"])
    r = prints.select(
        merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.differing(F.col("a"), F.col("b")).alias("ab"), merkle.differing(F.col("c"), F.col("a")).alias("ca"),
        merkle.differing(F.col("a"), F.col("a")).alias("aa"), merkle.likeness(F.col("a"), F.col("a")).alias("same"), merkle.nodes(F.col("a"), "section").alias("sections"),
        merkle.nodes(F.col("a"), "paragraph").alias("paragraphs")).first()
    assert abs(r.near - brute_near(base, small)) < 1e-12 and 0.9 < r.near < 1 and r.same == 1.0
    assert r.ab.sections == [r.sections[7]] and r.ab.paragraphs == [r.paragraphs[7 * 6 + 3]] and len(r.ab.leaves) == 1
    assert len(r.ca.sections) == 1 and r.ca.sections[0].endswith("#14") and len(r.ca.paragraphs) == 1  # an insertion moves the rest, and marks nothing else
    assert (r.aa.sections, r.aa.paragraphs, r.aa.leaves) == ([], [], [])


def merkle_leaves(fingerprint):
    return re.findall(r"[0-9a-f]{16}#[0-9]+(?=[.)])", fingerprint)


def test_merkle_query_equals_brute_force(spark, sf, documents):
    rows = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    got = queries.op9_merkle_fingerprint(spark, sf).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute_edit(rows))
    prints = {}
    for r in got:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(p) == 1 for p in prints.values()) and len({*map(min, prints.values())}) == len(prints)
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_merkle_edges(spark):
    rows = [(5, "a b c d\ne f\n\ng"), (5, "zz"), (5, "zz"), (None, "first ones"), (None, None), (-3, "é🙂x"), (10**17, "y " * 20_000), (10**17 + 1, ""), (7, "a\n\n\nb"), (8, "a\n\nb")]
    df = docs_frame(spark, rows).withColumns({"next": F.lit(1), "fp": F.lit(2), "_key": F.lit(0)})
    got = merkle.edit_report(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(brute_edit(rows), key=repr)
    assert len({r.fingerprint for r in got if r.doc_id in (7, 8)}) == 2
    one = merkle.edit_report(docs_frame(spark, [(1, "one two three")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == brute_edit([(1, "one two three")])[0][2]
    assert merkle.edit_report(docs_frame(spark, [])).collect() == []
    near = sorted((hashlib.sha256(e.encode()).hexdigest(), round(brute_near(t, e), 9), round(brute_near(t, n), 9)) for _, t, e, n in brute_neighbours(rows))
    assert sorted((r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == near
    plan = merkle.edit_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_held_out_fold(spark):
    import zlib

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", crc_fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
