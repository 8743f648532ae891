import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, html, langid, pii, quality, queries


def brute_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_quality_measures_against_brute_force(make_docs, rng):
    texts = [None, "", " \n\t ", "a b c d e f g h", "a " * 500, "x\n" * 30] + [
        " ".join(rng.choice("abc") + rng.choice(["", "#", "\n"]) for _ in range(rng.randint(1, 90)))
        for _ in range(60)]
    rows = quality.apply_rules(make_docs(texts, extra=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        w = brute_words(text)
        seen, covered = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i:i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered |= {i + k for i in at for k in range(8)}
        lines = [x for x in text.split("\n") if brute_words(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.apply_rules(make_docs([])).count() == 0


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, "bad" if k < 40 else "good" if k < 80 else None,
             good if k >= 38 else "too short") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    kept = {r.doc_id: r.kept for r in quality.apply_rules(docs).collect()}
    assert not kept[38] and not kept[39]
    assert all(kept[k] for k in range(40, 90))


def test_few_documents_do_not_judge_a_host(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"h{k % 10}", good) for k in range(500)] + [(900, "tiny", "short"), (901, "tiny", good)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    kept = {r.doc_id: r.kept for r in quality.apply_rules(docs).collect()}
    assert kept[901] and not kept[900]


EVENTS = "conv_id bigint, msg bigint, seq bigint, kind string, role string, text string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "he"),
        (1, 2, 4, "delta", None, "lo"), (1, 2, 3, "delta", None, "l"),
        (1, 1, 5, "edit", None, "hi there"), (1, 2, 6, "regenerate", None, "he"),
        (1, 2, 7, "delta", None, "y"), (2, 1, 1, None, None, None)]
    turns = chat.fold(spark.createDataFrame(log, EVENTS)).orderBy("conv_id", "seq").collect()
    assert [(t.conv_id, t.role, t.text) for t in turns] == [
        (1, "user", "hi there"), (1, "assistant", "hey"), (2, "", "")]


def test_transcripts_read_back_exactly(spark, rng):
    bits = ["</s>", "[INST]", "<|turn|>", "<|end|>", "\n", "\\", "<", "[", "a", "é😀", "<s", "|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(k // 100, k % 100, "assistant" if k % 2 else rng.choice(["user", "a\nb", "<s>", ""]), t)
            for k, t in enumerate(texts)] + [(9, 0, "user", None), (9, 0, "user", None)]
    events = chat.from_messages(spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seg", F.lit(1)))
    rendered = chat.render(chat.fold(events))
    out = rendered.select("conv_id", chat.read_back(
        F.array_join(F.col("segments.text"), "")).alias("t"),
        chat.masked_text(F.col("segments")).alias("loss")).collect()
    for r in out:
        want = [(role, text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.t] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
    assert chat.digests(chat.render(chat.fold(events.limit(0)))).count() == 0


def test_language_of_held_out_documents(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    total, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert total > 200 and right >= 0.95 * total


def test_language_cases(make_docs):
    en, fr = "the cat and the dog of the house ", "le chat et le chien de la maison "
    texts = [en * 5, fr * 5] * 30 + [None, "", "123 !?", en, fr, en + fr, "字" * 5]
    langs = ["en", "fr"] * 30 + [None] * 7
    out = {r.doc_id: r for r in langid.identify(make_docs(texts, langs=langs, extra=True)).collect()}
    assert len(out) == len(texts)
    assert [out[60 + k].lang_pred for k in range(5)] == ["und", "und", "und", "en", "fr"]
    assert out[60].score == 0 and all(0 <= r.score <= 1 for r in out.values())
    unlearned = langid.identify(make_docs([en], langs=[None])).first()
    assert (unlearned.lang_pred, unlearned.score) == ("und", 0.0)
    assert langid.identify(make_docs([])).count() == 0


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_plain_spans_against_plain_patterns(rng):
    bits = ["a", "b1", "@", "@", ".", ".", "-", "+", " ", "_", "12", "255", "4111111111111111",
            "(", ")", "é", "."]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        assert pii.plain_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("text, kind, source", [
    ("é to john (at) example [dot] com now", "email", "john (at) example [dot] com"),
    ("ask john at example dot co dot uk today", "email", "john at example dot co dot uk"),
    ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus four nine one five one two three four five six", "phone",
     "plus four nine one five one two three four five six"),
    ("host ４２.１.２.３ up", "ip", "４２.１.２.３"),
    ("pay four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
])
def test_disguises_are_found_at_their_source(text, kind, source):
    plain, found = pii.spans(text)
    assert not plain and [(k, text[a:b]) for k, a, b in found] == [(kind, source)]


@pytest.mark.parametrize("text, plain, source", [
    ("x jоhn@example.com y", "hn@example.com", "jоhn@example.com"),
    ("x jo\u200bhn@example.com y", "hn@example.com", "jo\u200bhn@example.com"),
    ("x john@example.cоm y", "john@example.c", "john@example.cоm"),
    ("x john@mail.example dot com y", "john@mail.example", "john@mail.example dot com"),
    ("x john@example.co [dot] uk y", "john@example.co", "john@example.co [dot] uk"),
    ("x john@mail.example dot museum y", "john@mail.example", "john@mail.example dot museum"),
])
def test_disguises_around_a_plain_fragment(text, plain, source):
    base, found = pii.spans(text)
    assert [text[a:b] for _, a, b in base] == [plain]
    assert {text[a:b] for _, a, b in found} == {plain, source}
    assert pii.mask(text) == "x <EMAIL> y"


@pytest.mark.parametrize("kind, hidden", [
    ("phone", "+\u0664\u0669 \u0661\u0665\u0661 \u0662\u0663\u0664\u0665\u0666\u0667\u0668"),
    ("phone", "+\U0001d7d2\U0001d7d7 151 2345678"),
    ("card", "\u096a111 1111 1111 111\u0967"),
    ("ip", "\u06f1\u06f0.0.0.\u06f7"),
    ("phone", "four nine one five one\ntwo three four five six"),
    ("phone", "plus four nine one,\r\nfive one two three four five six"),
])
def test_digits_of_other_scripts_and_over_line_ends(kind, hidden):
    text = f"tel {hidden} now"
    base, found = pii.spans(text)
    start = text.index(hidden)
    assert (kind, start, start + len(hidden)) in found
    assert (kind, start, start + len(hidden)) not in base
    assert pii.mask(text) == f"tel <{kind.upper()}> now"


def test_worded_addresses_may_end_in_any_letters():
    for end in ("museum", "pl", "online"):
        text = f"ask john at example dot {end} today"
        assert [text[a:b] for _, a, b in pii.spans(text)[1]] == [f"john at example dot {end}"]
    for text in ("a@b.com is plain, jоhn is not", "mail a@b.com dot the rest"):
        assert [text[a:b] for _, a, b in pii.spans(text)[1]] == ["a@b.com"]


@pytest.mark.parametrize("text", [
    "we met at noon by the dot", "look at this dot pattern", "un un un un un un un un un",
    "at home (at last)", "", "\u0661\u0662 \u0645\u0646 \u0662\u0660\u0662\u0664",
    "one\ntwo\nthree", "one two buckle my shoe", "v1.2.3 of 2020-10-10"])
def test_ordinary_text_has_no_spans(text):
    assert pii.spans(text) == ([], [])


def test_detection_and_masking_of_tables(make_docs):
    texts = [None, "", "a@b.co", "a@b.co", "x" * 100_000 + " 1.2.3.4", "+1 (988) 555-2485"]
    docs = make_docs(texts, extra=True)
    out = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert [out[k].spans for k in range(4)] == ["", "", "email:0:6", "email:0:6"]
    assert out[4].spans == "ip:100001:100008" and out[5].n_phone == 1
    masked = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert masked[0].text is None and masked[2].text == "<EMAIL>" and masked[5].text == "<PHONE>"
    assert masked[2].score == "x" and pii.redact(docs).columns == docs.columns
    assert pii.detect(make_docs([])).count() == 0


P = "The cat is on the mat and it was for the dog that it had been to the house of. " * 4


def test_pages_with_and_without_a_marked_article():
    page = f"""<html><head><title>t</title><style>p</style></head><body><header><h1>Site</h1>
    </header><div id="cookie-notice">{P}</div><div class="content"><h2>A heading</h2><p>{P}</p>
    <p>Short &amp; sweet.</p><p>{P}<br>&nbsp;more</p></div><div class="comments"><p>{P}</p></div>
    <div class="sidebar"><a href=x>the link of it</a></div><footer>&copy; me</footer></body>"""
    text = P.strip()
    assert html.main_text(page) == "\n\n".join(
        ["A heading", text, "Short & sweet.", text + " more"])
    marked = "<nav><a>x</a></nav><article><h1>T</h1><p>one<p>two<script>var a='</p>'</script>" \
             "<aside>no</aside><p>3 &lt; 4</article><p>after</p><foot"
    assert html.main_text(marked) == "T\n\none\n\ntwo\n\n3 < 4"


@pytest.mark.parametrize("wrap", [
    "<div class='layout has-sidebar'><article>{}</article></div>",
    "<main class='no-sidebar'>{}</main>",
    "<article class='post with-comments'>{}</article>",
    "<div class='layout sidebar-right'><article>{}</article></div>",
    "<main><h1></h1><div class='side-by-side'><article>{}</article></div></main>",
    "<article class='post social-ready'>{}</article>",
    "<div class='header-fixed'><div class='content'>{}</div></div>",
])
def test_words_on_a_layout_do_not_hide_its_text(wrap):
    nav = "<nav><a href=x>a link</a></nav>"
    rest = f"<div class='comments'><article class='comment'><p>{P}</p></article></div><footer>f</footer>"
    for page in (wrap.format(f"<p>{P}</p><p>{P}</p>"), nav + wrap.format(f"<p>{P}</p><p>{P}</p>") + rest):
        assert html.main_text(page) == "\n\n".join([P.strip()] * 2), page
    inner = wrap.format(f"<p>{P}</p><div class='share'><p>{P}</p></div>")
    assert html.main_text(inner) == P.strip()


def test_furniture_words_still_hide_what_stands_beside_the_text():
    comment = f"<div class='comments'><article><p>{P}</p></article></div>"
    assert html.main_text(f"<div><p>{P}</p><p>{P}</p></div>" + comment) == "\n\n".join([P.strip()] * 2)
    teaser = f"<aside><article>{P}</article></aside><div class='related'><article>more</article></div>"
    assert html.main_text(f"<main><p>{P}</p>{teaser}</main>") == P.strip()
    assert html.main_text(f"<article><p>one</p></article><div class='sidebar'>{P}</div>") == "one"


def test_pages_as_a_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", f"<main><p>{P}</main>"),
            (4, "u", f"<main><p>{P}</main>"), (5, "u", "<div>" * 3000 + "x"), (None, "u", "a <b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS n_chars", "3 AS __id")
    out = html.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in out.collect()) == [0, 0, 0, 0, 0, len(P) - 1, len(P) - 1]
    assert html.extract(pages.limit(0)).count() == 0


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
